"""Token counts: an exact histogram of encoded lengths and what its suffix sums answer.

Each document is encoded once and only its length is kept. Documents are counted by length
in the map tasks; from then on the work is on distinct lengths. With, for each length L, the
documents and tokens of length L or more, every question about a context limit C is a
difference: the total is the whole sum, ``truncated(C) = tokens(length <= C) + C * documents
(length > C)``, and a quantile is the first length whose running count reaches the rank.

Suffix sums run in two steps, blocks of neighbouring lengths and then lengths inside a
block, so that no task holds all lengths.

Defined results: a null or empty text has length 0 and is counted; repeated rows and ids
count each; an empty table gives an empty histogram; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reachlens.llm.tokens import encoder, small_batches

_BLOCK = 1024


def encoded_lengths(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """One row per document with its number of tokens."""
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(tokenizer) as own:
            for batch in small_batches(batches):
                _, bounds = own.encode(batch.column(0))
                yield pa.record_batch([pa.array(bounds[1:] - bounds[:-1], pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(lengths, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens, n_docs``: documents of each length."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """For every length as a context limit: documents and tokens at it and above, tokens left
    after truncation, and the share of documents that fit."""
    cells = counts.withColumn("block", F.col("n_tokens") - F.col("n_tokens") % _BLOCK)
    blocks = cells.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.expr("n_docs * n_tokens")).alias("t"))
    # One row per 1,024 lengths: a window over the whole of it is small.
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(everything).alias("total_docs"), F.sum("t").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.join(blocks, "block").select(
        "n_tokens", "n_docs", "total_docs", "total_tokens",
        (F.col("d_above") + F.sum("n_docs").over(inside)).alias("docs_at_least"),
        (F.col("t_above") + F.sum(F.expr("n_docs * n_tokens")).over(inside)).alias("tokens_at_least"),
    )
    longer = F.col("docs_at_least") - F.col("n_docs")
    return summed.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "total_docs", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("total_docs") - longer) / F.col("total_docs")).alias("share_within"),
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``context_limit``, documents longer than it, and tokens left when texts are cut to it;
    any limit, also one that no document has as its length."""
    wanted = F.explode(F.array(*[F.lit(int(c)).cast("long") for c in limits]))
    per_limit = sums.select("*", wanted.alias("context_limit"))
    over = F.col("n_tokens") > F.col("context_limit")
    return per_limit.groupBy("context_limit").agg(
        F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_longer"),
        F.sum(F.col("n_docs") * F.least("n_tokens", "context_limit")).alias("truncated_tokens"),
        F.max("total_tokens").alias("total_tokens"),
    )


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``share, n_tokens``: the shortest length within which that share of documents lies."""
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in shares]))
    return sums.select("n_tokens", "share_within", wanted.alias("share")).groupBy("share").agg(
        F.min(F.expr("CASE WHEN share_within >= share THEN n_tokens END")).alias("n_tokens"))
