"""Building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def choice(name: str, allowed: Sequence[str]) -> Column:
    """The column a caller picked at run time, refused if it is not on offer."""
    if name not in allowed:
        raise ValueError(f"{name!r} is not one of {', '.join(allowed)}")
    return F.col(name)


def first_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int = 1
) -> DataFrame:
    """The first ``k`` rows of each group.

    Spark keeps only ``k`` rows per group in every map task before the shuffle, so a
    group holding most of the table still sends little to its one reducer.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def row_digest(df: DataFrame) -> Column:
    """A value to order rows by when nothing else tells them apart."""
    return F.xxhash64(*[F.col(c) for c in sorted(df.columns)])


def tie_order(df: DataFrame, ties: Sequence[str] = ()) -> list[Column]:
    """Order among rows that are equal in what a pick goes by: the named columns, nulls
    first, then a digest of all columns of ``df``. Which columns the caller goes on with
    plays no part, so any choice of columns comes from the same row."""
    return [*[F.col(c).asc_nulls_first() for c in ties], row_digest(df)]


def left_join_unique(
    left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]
) -> DataFrame:
    """LEFT JOIN to a side that has one row per key, ready for skewed left keys.

    ``right`` usually comes out of a per-key aggregation and is then already
    partitioned by the key. Joined as it is, its shuffle would lie below that
    aggregation, where adaptive execution cannot split a skewed partition. The hash
    added to the condition asks for a fresh shuffle of both sides directly under the
    join; the right one is the small, unique side. A partition that one left key
    fills is then cut into several tasks while running. Key columns of ``right`` are
    dropped from the result.
    """
    left_keys = [l for l, _ in on]
    keyed = right.select(
        *[F.col(r).alias(f"_k{i}") for i, (_, r) in enumerate(on)],
        F.xxhash64(*[r for _, r in on]).alias("_kh"),
        *[c for c in right.columns if c not in {r for _, r in on}],
    )
    condition = F.xxhash64(*left_keys) == F.col("_kh")
    for i, name in enumerate(left_keys):
        condition = condition & (F.col(name) == F.col(f"_k{i}"))
    joined = left.join(keyed, condition, "left")
    return joined.drop("_kh", *[f"_k{i}" for i in range(len(on))])


def one_per_day(account_daily: DataFrame, *metrics: str) -> DataFrame:
    """One row per account and day. Exact repeats collapse; if a day was loaded twice
    with different figures the larger one is kept."""
    return (
        account_daily.filter(F.col("date").isNotNull())
        .groupBy("page_id", "date")
        .agg(*[F.max(m).alias(m) for m in metrics])
    )
