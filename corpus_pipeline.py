"""The training-data pipeline: quality rules, near-duplicate join, benchmark decontamination,
mixing to target weights, token output. Counted as part of the ``llm`` subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from reachlens.llm import decontamination, mixing, ngram_jaccard, quality_rules, token_output
from reachlens.llm.names import free_names
from reachlens.session import on_workers
from reachlens.sources.shared import new_path, written

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_jaccard.kept_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, each as often as the mix takes it (not at all, once or twice)."""
    members, size, taken = free_names(docs.columns, "_members", "_size", "taken")
    sized = docs.withColumn(members, F.array("source")).withColumn(size, F.expr(mixing.size_sql()))
    mixed, _ = mixing.mixed(sized, members, size, taken_col=taken)
    return mixing.repeated(mixed, size, docs.columns, taken)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids in files; from those, a row per document with its place and checksum."""
    path = new_path(spark, "token-ids")
    token_output.write(docs, public_tokenizers.path(TOKENIZER), path)
    return token_output.digests(token_output.read(spark, path))


def _step(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    return lambda spark, docs, sf_dir: function(on_workers(spark), docs, sf_dir)


STAGES = [(f.__name__, _step(f)) for f in (quality, near_duplicates, decontaminate, mix, token_ids)]

# Similarity classes, edit distances and token ids are beyond SQL; tests hold run() against
# a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
