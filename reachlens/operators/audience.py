"""Follower demographics and advertising figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from reachlens.fixed_values import CLICKS_PER_FOLLOW
from reachlens.functions.numbers import float_ratio, money
from reachlens.functions.text import contains_ignoring_case, currency_sql, plain_number_sql, thousands_sql
from reachlens.operators.common import left_join_unique
from reachlens.operators.kpi import for_accounts


def followers_by_value(demographics: DataFrame, breakdown: str | None = None) -> DataFrame:
    """Followers per account, breakdown and value; rows without a value are left out."""
    rows = demographics.filter(F.col("breakdown").isNotNull() & F.col("value").isNotNull())
    if breakdown is not None:
        rows = rows.filter(F.col("breakdown") == breakdown)
    return rows.groupBy("page_id", "breakdown", "value").agg(
        F.coalesce(F.sum("followers"), F.lit(0)).alias("followers")
    )


def demographic_share(demographics: DataFrame, breakdown: str | None = None) -> DataFrame:
    """Each value's percentage of its breakdown, null where the breakdown sums to 0.

    The totals are a small aggregate joined back; a window per breakdown would bring
    all values of the largest one into a single task.
    """
    counts = followers_by_value(demographics, breakdown)
    totals = counts.groupBy("page_id", "breakdown").agg(F.sum("followers").alias("_total"))
    keys = [("page_id", "page_id"), ("breakdown", "breakdown")]
    joined = left_join_unique(counts, totals, keys)
    share = F.try_divide(F.col("followers") * F.lit(100.0), F.col("_total"))
    return joined.select("page_id", "breakdown", "value", "followers", share.alias("percent"))


def breakdown_list(demographics: DataFrame) -> DataFrame:
    """The breakdowns each account can choose from."""
    return demographics.select("page_id", "breakdown").distinct()


def ad_totals(
    ads: DataFrame, name_contains: str = "Post", by: Sequence[str] = ("page_id",), accounts: DataFrame | None = None,
) -> DataFrame:
    """Spend, reach, follows bought and their price over the ads whose name matches.

    A group none of whose ads match shows zeros and no price, and so does an account that
    has no ads at all but is among ``accounts``.
    """
    def total(column, value):
        return F.sum(F.when(contains_ignoring_case(F.col("ad_name"), name_contains), value)).alias(column)

    sums = ads.groupBy(*by).agg(total("spend", money(F.col("spend"))), total("reach", F.col("reach")), total("clicks", F.col("clicks")))
    totals = for_accounts(sums, accounts).withColumn("spend", F.col("spend").cast("double")).na.fill(0, ["spend", "reach", "clicks"])
    follows = F.col("clicks") / F.lit(float(CLICKS_PER_FOLLOW))
    return totals.select(
        *by, "spend", "reach", follows.alias("boosted_follows"),
        float_ratio(F.col("spend"), follows).alias("cost_per_follow"),
    )


def ad_scorecards(totals: DataFrame, by: Sequence[str] = ("page_id",)) -> DataFrame:
    """Ad totals as display text."""
    return totals.selectExpr(
        *by, f"concat('$', {plain_number_sql('spend')}) AS ad_spend",
        f"{thousands_sql('reach')} AS reach",
        f"{plain_number_sql('boosted_follows')} AS boosted_follows",
        f"{currency_sql('cost_per_follow')} AS cost_per_follow",
    )
