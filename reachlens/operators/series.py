"""Daily series of an account: post counts, gap filling, markers, extents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reachlens.fixed_values import DAILY_COUNT_DAYS, SERIES_HEADINGS
from reachlens.functions.dates import AsOf, days_before
from reachlens.operators.common import one_per_day

SERIES_METRICS = tuple(SERIES_HEADINGS)


def posts_per_day(posts: DataFrame) -> DataFrame:
    """Posts of each account on each day it posted."""
    return posts.groupBy("page_id", F.to_date("created_time").alias("date")).agg(
        F.count(F.lit(1)).alias("post_count")
    )


def daily_counts(
    posts: DataFrame, account_daily: DataFrame, as_of: AsOf, days: int = DAILY_COUNT_DAYS
) -> DataFrame:
    """Account days with the number of posts made on them.

    Counted are the ``days`` days that end yesterday: a day among them without posts
    gets 0, an account day outside them gets null.
    """
    first, last = days_before(as_of, days), days_before(as_of, 1)
    counts = posts_per_day(posts.filter(F.to_date("created_time").between(first, last)))
    inside = F.col("date").between(first, last)
    return account_daily.dropDuplicates().join(counts, ["page_id", "date"], "left").withColumn(
        "post_count", F.when(inside, F.coalesce("post_count", F.lit(0)))
    )


def fill_gaps(account_daily: DataFrame, metric: str, fill: str | None = "ffill") -> DataFrame:
    """One row per account for every day between its first and last day.

    Each known day is stretched to the day before the next known one, so neither a
    calendar table nor a join is needed. ``fill="ffill"`` carries the last known value
    forward, ``None`` leaves new days null.
    """
    if metric not in SERIES_METRICS:
        raise ValueError(f"{metric!r} is not one of {', '.join(SERIES_METRICS)}")
    if fill not in ("ffill", None):
        raise ValueError("fill must be 'ffill' or None")
    by_day = Window.partitionBy("page_id").orderBy("date")
    carried = F.last(metric, ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    next_day = F.coalesce(F.lead("date").over(by_day), F.date_add("date", 1))
    known = one_per_day(account_daily, metric).select(
        "page_id", F.col("date").alias("_known"), F.col(metric).alias("_value"),
        carried.alias("_carried"), F.sequence("date", F.date_sub(next_day, 1)).alias("_days"),
    )
    days = known.withColumn("date", F.explode("_days"))
    value = F.col("_carried") if fill else F.when(F.col("date") == F.col("_known"), F.col("_value"))
    return days.select("page_id", "date", value.alias(metric))


def series_extent(series: DataFrame, metric: str) -> DataFrame:
    """First and last day, smallest and largest value of each account's series."""
    return series.groupBy("page_id").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min(metric).alias(f"min_{metric}"), F.max(metric).alias(f"max_{metric}"),
    )


def with_headings(series: DataFrame) -> DataFrame:
    """Metric columns under the names they are shown by."""
    return series.withColumnsRenamed(SERIES_HEADINGS)


def post_days(posts: DataFrame) -> DataFrame:
    """Days on which an account posted."""
    return posts.select("page_id", F.to_date("created_time").alias("date")).distinct()


def post_markers(posts: DataFrame, account_daily: DataFrame) -> DataFrame:
    """Posting days on or after the account's first recorded day.

    Posts shrink to distinct days before the join, so a busy account brings days, not
    posts, to its task.
    """
    first = account_daily.groupBy("page_id").agg(F.min("date").alias("_first"))
    return post_days(posts).join(first, "page_id").filter("date >= _first").drop("_first")
