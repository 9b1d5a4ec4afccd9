"""Token-ID / binary output: Parquet lists of ids that can be read column- and page-wise.

Documents are ordered by id over all files (range partitions, sorted inside). ``ids`` is a
list of 32-bit ids, dictionary-encoded: a vocabulary of 50,000 fits the dictionary page, so
an id takes 16 bits. The narrow columns ``doc_id``, ``n_tokens`` and ``start_in_part`` are
delta-encoded (writer version 2). Row groups and pages are small and carry page indexes, so
a reader of some documents, or of the metadata alone, skips the rest.

Defined results: a null text is empty and encodes to the end id alone; null ids come first;
rows with one id are ordered by a hash of their text and then the text; an empty table gives
files without rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reachlens.llm.tokens import encoder, small_batches

SCHEMA = "doc_id long, n_tokens long, part int, start_in_part long, ids array<int>"

LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#start_in_part": "false",
    "compression": "zstd",
}


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id``, and write one file per range of ids."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        with encoder(tokenizer) as own:
            for batch in small_batches(batches):
                ids, bounds = own.encode(batch.column("text"))
                rows = batch.num_rows
                ended = np.insert(ids, bounds[1:], end_id).astype(np.int32)
                bounds = bounds + np.arange(rows + 1)
                yield pa.record_batch([
                    batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(np.full(rows, part, np.int32)), pa.array(start + bounds[:-1]),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ended)),
                ], ["doc_id", "n_tokens", "part", "start_in_part", "ids"])
                start += int(bounds[-1])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    (
        narrow.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
        .mapInArrow(encode, SCHEMA).write.options(**LAYOUT).parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored documents with ``start``, the ids of all documents before."""
    stored = spark.read.schema(SCHEMA).parquet(path)
    # One row per file: the sums over it are small, and so is the broadcast.
    sizes = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return stored.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("start_in_part")).drop("base")


def digests(stored: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens`` and the CRC-32 of the ids as little-endian 32-bit integers."""
    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds, flat = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4")
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.record_batch([
                batch.column("doc_id"), batch.column("start"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.int64()),
            ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.select("doc_id", "start", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
