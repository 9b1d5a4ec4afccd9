"""Appends to, and new versions of, the stored tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reachlens.sources.shared import written

_VERSION = "version="
_BATCH = "batch="
_BUCKET = "_bucket"
IDEA_BUCKETS = 64


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    return base.getFileSystem(spark._jsc.hadoopConfiguration()), base


def _names(spark: SparkSession, root: str) -> list[str]:
    """What lies directly in a folder, nothing if there is none."""
    files, base = _folder(spark, root)
    return [status.getPath().getName() for status in files.listStatus(base)] if files.exists(base) else []


def _finished(spark: SparkSession, path: str) -> bool:
    files, mark = _folder(spark, f"{path}/_SUCCESS")
    return files.exists(mark)


def append_ideas(ideas: DataFrame, path: str) -> None:
    """Add idea rows, those of an account lying together.

    Sorted files let a read of one account skip row groups by their statistics. A
    folder per account would do so too but would mean as many folders as accounts. A
    large account still uses several tasks: adaptive execution splits an over-full
    rebalance partition.
    """
    clustered = ideas.hint("rebalance", "page_id").sortWithinPartitions("page_id", "date")
    clustered.write.mode("append").parquet(path)


def append_clips(clips: DataFrame, path: str) -> DataFrame:
    """Add clip rows and return them as stored, so the generated ids are final."""
    stored = written(clips, "clips")
    stored.write.mode("append").parquet(path)
    return stored


def write_snapshot(posts: DataFrame, path: str) -> None:
    """Add one day's posts, partitioned by load day for later pruning."""
    posts.hint("rebalance", "insert_date").write.mode("append").partitionBy("insert_date").parquet(path)


def _versions(spark: SparkSession, root: str, finished: bool = True) -> list[int]:
    """Numbers of the finished versions, or of all; unfinished ones lack the success mark."""
    found = [n for n in _names(spark, root) if n.startswith(_VERSION) and (not finished or _finished(spark, f"{root}/{n}"))]
    return sorted(int(n[len(_VERSION):]) for n in found)


def write_version(df: DataFrame, root: str) -> str:
    """Store ``df`` as the next version of the table under ``root``.

    Deletes and updates rewrite into a new folder and never over the files being
    read; readers keep the previous version until the write has succeeded. A second
    writer that chose the same number fails and leaves the first one's files alone; a
    number that an unfinished write left behind is not used again.
    """
    spark = df.sparkSession
    taken = _versions(spark, root, finished=False)
    path = f"{root}/{_VERSION}{(taken[-1] + 1) if taken else 1:06d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_version(spark: SparkSession, root: str) -> DataFrame:
    """The newest finished version."""
    done = _versions(spark, root)
    if not done:
        raise FileNotFoundError(f"no finished version under {root}")
    return spark.read.parquet(f"{root}/{_VERSION}{done[-1]:06d}")


# --- appends that can be repeated -----------------------------------------------------------


def append_batch(rows: DataFrame, path: str, batch: str) -> bool:
    """Add ``rows`` as the batch of that name, once; False if it is already there.

    A batch is a folder, finished when its success mark exists. A repeated append finds the
    mark and writes nothing; what a broken-off one left behind is replaced. Names are the
    caller's (a load's date and source, say) and hold no ``/`` or ``=``.
    """
    if not batch or set(batch) & set("/="):
        raise ValueError(f"{batch!r} cannot name a batch")
    folder = f"{path}/{_BATCH}{batch}"
    if _finished(rows.sparkSession, folder):
        return False
    rows.write.mode("overwrite").parquet(folder)
    return True


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all finished batches."""
    done = [f"{path}/{n}" for n in sorted(_names(spark, path)) if n.startswith(_BATCH) and _finished(spark, f"{path}/{n}")]
    if not done:
        raise FileNotFoundError(f"no finished batch under {path}")
    return spark.read.parquet(*done)


# --- a table rewritten bucket by bucket ---------------------------------------------------


def bucket_of(page_id: Column, buckets: int = IDEA_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(page_id), F.lit(buckets)).cast("int")


def write_bucketed(rows: DataFrame, root: str, buckets: int = IDEA_BUCKETS) -> None:
    """Store ``rows`` in a fixed number of folders by a hash of ``page_id``: few however many
    accounts there are. A crowded bucket is written by several tasks."""
    rows.withColumn(_BUCKET, bucket_of(F.col("page_id"), buckets)).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(root)


def read_bucketed(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).drop(_BUCKET)


def rewrite_touched(
    spark: SparkSession, root: str, keys: DataFrame, on: Sequence[str], change: Callable[[DataFrame], DataFrame],
) -> list[int]:
    """Apply ``change`` to the buckets that hold a row with the values ``on`` of ``keys``;
    their numbers are returned. Files of all other buckets stay as they are.

    Which buckets those are is found from the key columns alone. ``change`` gets their rows
    and must leave rows without such a key, and the ``page_id`` of all, as they are. New rows are
    stored in the shared folder first, so a broken-off replacement can be repeated from
    there; then their folders are overwritten. Readers of a touched bucket should not run
    meanwhile; a table that must never be seen half-way is kept as versions instead.
    """
    stored = spark.read.parquet(root)
    kind = stored.schema
    hit = stored.select(*on, _BUCKET).join(keys.select(*on), list(on), "left_semi").select(_BUCKET).distinct()
    touched = sorted(r[0] for r in hit.collect())  # no more than there are buckets
    if not touched:
        return []
    rows = stored.filter(F.col(_BUCKET).isin(touched))
    numbers = rows.select("page_id", _BUCKET).dropDuplicates(["page_id"]).withColumnRenamed("page_id", "_page")
    changed = change(rows.drop(_BUCKET))
    placed = changed.join(numbers, F.col("page_id").eqNullSafe(F.col("_page")), "left").select(*[f.name for f in kind])
    staged = written(placed, "rewritten")
    staged.hint("rebalance", _BUCKET).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(_BUCKET).parquet(root)
    left = {r[0] for r in staged.select(_BUCKET).distinct().collect()}
    for bucket in set(touched) - left:  # nothing remains of these
        files, base = _folder(spark, f"{root}/{_BUCKET}={bucket}")
        files.delete(base, True)
    return touched


# --- tables laid out for their join ---------------------------------------------------------


def dealt(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows in the tasks of their buckets; those without a key stay in the tasks that hold them.

    Rows that a window or aggregation has just partitioned by ``key`` alone, into as many
    partitions, are not moved again: Spark drops a repartition that changes nothing.
    """
    keyed = rows.filter(F.col(key).isNotNull()).repartition(buckets, key)
    return keyed.unionByName(rows.filter(F.col(key).isNull()))


def write_keyed(rows: DataFrame, name: str, key: str, path: str, buckets: int | None = None, nulls: bool = True) -> DataFrame:
    """Store ``rows`` as the catalog table ``name``, bucketed by ``key`` and sorted in each bucket.

    Two such tables with as many buckets join on their keys without an exchange. ``buckets``
    follows the size of the table, as a bucket must fit a task; by default it is the session's
    number of shuffle partitions. ``nulls=False`` says that no row lacks its key. Files are
    packed with zstd: they are written once, read often, and mostly long texts.
    """
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = dealt(rows, key, buckets) if nulls else rows.repartition(buckets, key)
    placed.write.bucketBy(buckets, key).sortBy(key).format("parquet").options(path=path, compression="zstd").saveAsTable(name)
    return spark.table(name)
