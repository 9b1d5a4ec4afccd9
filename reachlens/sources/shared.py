"""The folder all executors can reach, used for written intermediate tables."""

from __future__ import annotations

import hashlib
import uuid
from types import TracebackType
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

_SETTINGS = ("spark.checkpoint.dir", "spark.sql.warehouse.dir")


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """``folder`` if given, else ``spark.checkpoint.dir``, else the session's warehouse.

    The order is the same for every master. All executors must reach the folder, so a
    warehouse on the driver's own disk is refused where executors run elsewhere. Its owner
    empties it when no frame of the session reads from it any more (an expiry rule
    on the store, or the removal of the job's folder), as nothing here can know that.
    """
    for name in _SETTINGS:
        if folder:
            break
        folder = spark.conf.get(name, None) or spark.sparkContext.getConf().get(name, None)
        if folder and name != _SETTINGS[0]:
            check_reachable(spark, folder, spark.sparkContext.master)
    return folder.rstrip("/")


def check_reachable(spark: SparkSession, folder: str, master: str) -> None:
    """Refuse a local folder unless everything runs in one process."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    scheme = path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    if scheme == "file" and master != "local" and not master.startswith("local["):
        raise ValueError(f"executors do not share {folder}: set spark.checkpoint.dir to a folder that all of them reach")


def new_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark, folder)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and continue from the stored copy.

    Used where several queries share one expensive frame, or where a value such as a
    generated id must not be computed again when a lost task is repeated.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Memo:
    """Stored results that are found again by key as long as their inputs are unchanged.

    The key of a result is made of the caller's text (the query's own, with its arguments), the
    names and types of its columns, a hash of its plan, and name, length and time of every file it
    reads. A result whose files have changed is therefore computed anew. Frames that read
    anything but files are refused, as nothing tells whether that has changed. ``folder`` may
    be shared by sessions; the one that owns it closes the memo, which removes all it holds,
    when no frame is read from it any more.

        with Memo(spark) as memo:
            daily = memo.frame(df, "SELECT ... for 2024-01-31")
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.path = folder.rstrip("/") if folder else new_path(spark, "memo")

    def frame(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` as stored under its key, written first where it is not there."""
        path = f"{self.path}/{self.key(df, text)}"
        base = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        store = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
            df.write.mode("overwrite").parquet(path)  # over what a broken-off write left
        return self.spark.read.schema(df.schema).parquet(path)

    def key(self, df: DataFrame, text: str) -> str:
        parts = [text, df.schema.json(), str(df.semanticHash()), *map(str, self._inputs(df))]
        return hashlib.sha256("\0".join(parts).encode()).hexdigest()

    def _inputs(self, df: DataFrame) -> list:
        """Number of input files and sums over hashes of name, length and time, by a Spark job.
        Spark's file index has the names already; no file is opened."""
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        kinds = {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())}
        if kinds - {"LogicalRelation"}:
            raise ValueError(f"only frames over files can be kept by key, not {', '.join(sorted(kinds))}")
        names = [unquote(name) for name in df.inputFiles()]
        if not names:
            return [0]
        listed = self.spark.read.format("binaryFile").load(names).select("path", "length", "modificationTime")
        hashes = [F.xxhash64(F.lit(seed), "path", "length", "modificationTime") for seed in range(2)]
        return list(listed.agg(F.count("*"), *[F.sum(h.cast("decimal(38,0)")) for h in hashes]).first())

    def close(self) -> None:
        base = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        base.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(base, True)

    def __enter__(self) -> Memo:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.close()
