"""Places of rows in ordered groups of any size, and whole groups from sorted batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from reachlens.sources.shared import written


def _changes(columns: Sequence[pa.Array], before: Sequence[object]) -> np.ndarray:
    """Where a row differs from the one above in any of the (integer, maybe null) columns."""
    new = np.zeros(len(columns[0]), bool)
    for column, last in zip(columns, before):
        null = column.is_null().to_numpy(zero_copy_only=False)
        value = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
        new[1:] |= (value[1:] != value[:-1]) | (null[1:] != null[:-1])
        new[0] |= column[0].as_py() != last
    return new


def numbered(rows: DataFrame, group: str, order: Sequence[Column], cuts: Sequence[Column], kept: Sequence[str]) -> DataFrame:
    """``group``, ``kept`` and ``place``, the rank (from 1) of each row in its group.

    Rows are dealt out in ranges of the group and ``cuts``, so that a group that holds a third
    of all rows lies in many partitions; ``cuts`` must not contradict ``order``. Each task
    counts inside its range; what earlier ranges hold of a group is added from one row per
    range and group. Rows that ``order`` does not tell apart must be equal in ``kept``.
    """
    kind = rows.select(group, *kept).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, rank = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _changes([batch.column(0)], [last])
            index = np.arange(1, batch.num_rows + 1)
            start = np.maximum.accumulate(np.where(new, index - 1, -rank))
            ranks = index - start
            last, rank = batch.column(0)[batch.num_rows - 1].as_py(), int(ranks[-1])
            yield pa.record_batch([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(ranks)], [*batch.schema.names, "_part", "_rank"])

    dealt = rows.repartitionByRange(F.col(group).asc_nulls_first(), *cuts).sortWithinPartitions(F.col(group).asc_nulls_first(), *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind) + ", _part int, _rank long"
    # Written, as a second run might cut the ranges elsewhere.
    stored = written(dealt.select(group, *kept).mapInArrow(count, schema), "ordered")
    sizes = stored.groupBy(F.col(group).alias("_group"), "_part").agg(F.max("_rank").alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Only groups that go on from one range into the next have such rows: at most one per range.
    before = sizes.withColumn("_before", F.sum("_n").over(earlier)).filter("_before > 0").select("_group", F.col("_part").alias("_at"), "_before")
    here = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at"))
    return stored.join(before, here, "left").select(group, *kept, (F.col("_rank") + F.coalesce("_before", F.lit(0))).alias("place"))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], least: int = 1 << 17) -> Iterator[pa.Table]:
    """Tables of at least ``least`` rows (the last may have fewer) that cut no group, from
    batches in which equal keys follow each other. Holds one group more than that."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        columns = [batch.column(k) for k in keys]
        before = [held[-2].column(k)[held[-2].num_rows - 1].as_py() for k in keys] if len(held) > 1 else [c[0].as_py() for c in columns]
        new = np.flatnonzero(_changes(columns, before))
        if len(new) and (new[-1] or len(held) > 1):
            cut = int(new[-1])
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)
