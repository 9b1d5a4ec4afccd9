"""Media files of an object store or folder as a table, and the way to put them there."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from reachlens.fixed_values import PUBLIC_URL_BASE
from reachlens.functions.files import public_url
from reachlens.session import on_workers

_OBJECT = "name string, length long"
_BATCH_ROWS = 10_000


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or uri, and the folder as it knows it."""
    store, path = fs.FileSystem.from_uri(folder)
    return store, path.rstrip("/")


def children(store: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    return store.get_file_info(fs.FileSelector(path, recursive=False))


@dataclass
class Prefix(InputPartition):
    """What one task lists: a folder with all below it, or only the files directly in it."""

    path: str
    deep: bool


class MediaReader(DataSourceReader):
    def __init__(self, folder: str, depth: int):
        self.folder, self.depth = folder, depth

    def partitions(self) -> list[Prefix]:
        store, root = opened(self.folder)
        level, parts = [root], []
        for _ in range(self.depth):
            parts += [Prefix(path, False) for path in level]
            level = [i.path for path in level for i in children(store, path) if i.type == fs.FileType.Directory]
        return parts + [Prefix(path, True) for path in level]

    def read(self, partition: Prefix) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.folder)
        waiting, rows = [partition.path], []
        while waiting:
            for info in children(store, waiting.pop()):
                if info.type == fs.FileType.File:
                    rows.append((info.path.removeprefix(root).lstrip("/"), info.size))
                elif partition.deep:
                    waiting.append(info.path)
                if len(rows) == _BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)


def _batch(rows: list[tuple[str, int]]) -> pa.RecordBatch:
    names, lengths = zip(*rows) if rows else ((), ())
    return pa.record_batch([pa.array(names, pa.string()), pa.array(lengths, pa.int64())], ["name", "length"])


class MediaSource(DataSource):
    """Objects below the folder ``path``; the folders of the first ``depth`` levels are listed
    before the job starts and those below them by its tasks, one each."""

    @classmethod
    def name(cls) -> str:
        return "media_objects"

    def schema(self) -> str:
        return _OBJECT

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"], int(self.options.get("depth", 1)))


def list_media(
    spark: SparkSession, folder: str, bucket: str, base: str = PUBLIC_URL_BASE, depth: int = 1, quoted: bool = False
) -> DataFrame:
    """name, url and length of every object, sub-folders and hidden-looking names included.

    A name is the object's path below ``folder``. No file is opened. Every folder ``depth``
    levels down is listed by a task of its own, level by level, so neither the driver nor a task holds
    more names than one folder has; a store whose folders are flatter than that has an
    inventory stored as a table (``media_listing`` in ``sources.schemas``), which every function
    that takes a listing reads as well. The gallery shows addresses as the store's client quotes
    them (``quoted``), the post pages plain ones. An absent folder is an error, an empty one has no rows.
    """
    on_workers(spark).dataSource.register(MediaSource)
    listed = spark.read.format(MediaSource.name()).option("depth", depth).load(folder)
    return listed.select("name", public_url(bucket, F.col("name"), base, quoted).alias("url"), "length")


def put_media(objects: DataFrame, folder: str) -> DataFrame:
    """Store each row's ``content`` as the object ``name`` below ``folder``; name and length of each.

    Tasks store what they hold, so bytes never pass through the driver. The rows returned must
    be used (written, say) for the objects to be stored. A repeated task stores the same objects again;
    of rows with one name any is kept. Names or contents that are null, and names that leave the folder, are errors.
    """
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        for batch in batches:
            rows = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                if not name or content is None or ".." in name.split("/") or name.startswith("/"):
                    raise ValueError(f"{name!r} cannot be stored")
                if "/" in name:
                    store.create_dir(f"{root}/{name.rsplit('/', 1)[0]}", recursive=True)
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
                rows.append((name, len(content)))
            yield _batch(rows)

    narrow = objects.select("name", F.col("content").cast("binary").alias("content"))
    on_workers(objects.sparkSession)
    return narrow.mapInArrow(put, _OBJECT)
