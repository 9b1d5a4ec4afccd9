"""Scans. Filters are plain predicates, so they reach the Parquet reader."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from reachlens.functions.dates import AsOf, days_before
from reachlens.sources.schemas import TABLES, conform


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One account table stored as Parquet under ``root``, checked against its schema."""
    return conform(spark.read.parquet(f"{root}/{name}"), TABLES[name])


def run_query(spark: SparkSession, sql: str, args: dict[str, Any] | None = None) -> DataFrame:
    """A parameterised query over registered views."""
    return spark.sql(sql, args=args or {})


def one_page(df: DataFrame, page_id: int) -> DataFrame:
    """The rows of a single account."""
    return df.filter(F.col("page_id") == F.lit(page_id).cast("bigint"))


def registered_pages(df: DataFrame, registry: DataFrame) -> DataFrame:
    """The rows of every account listed in ``registry`` (a page_id column)."""
    return df.join(registry.select("page_id"), "page_id", "left_semi")


def snapshot(df: DataFrame, as_of: AsOf, days_back: int = 1) -> DataFrame:
    """Rows loaded ``days_back`` days before ``as_of``, by default yesterday's load.

    ``insert_date`` is the partition column of the stored table: as a date it prunes
    directories, as a timestamp the comparison is turned into a pushed-down range.
    Where yesterday is meant in an account's own zone, pass ``dates.local_day(...)``.
    """
    return df.filter(F.to_date("insert_date") == days_before(as_of, days_back))
