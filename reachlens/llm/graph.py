"""Connected components of an edge table, and grouping inside sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reachlens.sources.shared import written


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each node's component, for edges ``a, b`` (long).

    Alternating large-star and small-star rounds: every node passes its smallest neighbour
    on, first to larger neighbours, then to all smaller ones. Rounds grow with the logarithm
    of the component size; each is written, which also cuts the lineage. The crowded nodes
    are the roots, and what is joined to them is split by the skew join.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        neighbours = both(current)
        least = neighbours.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = neighbours.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Every row now points down; a node hands its smaller neighbours to the least of them.
        down = large.filter("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                                           F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").filter("a <> b").distinct()
        )
        current = written(small, "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each key as one table, from batches in which equal keys follow each other."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(c[start] for c in columns)
            if kept and key != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(start, end - start))
            last = key
    if kept:
        yield pa.Table.from_batches(kept)
