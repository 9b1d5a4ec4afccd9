"""Period and all-time figures of each account."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from reachlens.fixed_values import KPI_FRAME_DAYS, KPI_LABELS, KPI_RATIOS, NO_DIFFERENCE
from reachlens.functions.dates import AsOf, day_sql, moment_sql, to_day, to_moment
from reachlens.functions.numbers import pct_diff_sql, safe_ratio_sql
from reachlens.functions.text import (
    plain_number_sql, sign_class_sql, signed_percent_sql, thousands_sql, two_decimals_sql,
)
from reachlens.operators.common import one_per_day

METRICS = tuple(name for name, _ in KPI_LABELS)
SIDES = ("cur", "prev")


def _windows(as_of: AsOf, n: int, mode: str) -> tuple[list[str], list[str]]:
    """Predicates (current, previous) for post times and for account days.

    ``reference`` windows are closed on both ends. The previous one stops a day before
    the current one starts, so it is shorter and the posts of the day between count in
    neither. ``balanced`` windows are half open and equally long.
    """
    frame, one_day = dt.timedelta(n), dt.timedelta(1)
    now, today = to_moment(as_of), to_day(as_of)
    if mode == "reference":
        posts = [(now - frame, now), (now - 2 * frame, now - frame - one_day)]
        account = [(today - frame, today), (today - 2 * frame, today - frame - one_day)]
        low = ">="
    elif mode == "balanced":
        posts = [(now - frame, now), (now - 2 * frame, now - frame)]
        account = [(today - frame, today), (today - 2 * frame, today - frame)]
        low = ">"
    else:
        raise ValueError("mode must be 'reference' or 'balanced'")

    def inside(column, literal, bounds):
        return [f"({column} {low} {literal(a)} AND {column} <= {literal(b)})" for a, b in bounds]

    return inside("created_time", moment_sql, posts), inside("date", day_sql, account)


def period_kpis(
    posts: DataFrame, account_daily: DataFrame, as_of: AsOf,
    frame_days: int = KPI_FRAME_DAYS, mode: str = "reference", accounts: DataFrame | None = None,
) -> DataFrame:
    """Current and previous period of each account on one row: ``cur_*`` and ``prev_*``.

    One conditional aggregation per table; both meet on page_id after they have
    shrunk to a row per account. With ``accounts`` each of its page_ids has a row, idle
    ones zeros; without, accounts with rows in neither window are not listed.
    """
    in_posts, in_account = _windows(as_of, frame_days, mode)
    totals = []
    for side, inside in zip(SIDES, in_posts):
        totals.append(f"count_if({inside}) AS {side}_total_posts")
        for name, column in (("reach", "reach"), ("likes", "like_count"), ("comments", "comments_count")):
            totals.append(f"coalesce(sum({column}) FILTER (WHERE {inside}), 0) AS {side}_total_{name}")
    gains = [
        f"coalesce(sum(follower_count) FILTER (WHERE {inside}), 0) AS {side}_followers_gained"
        for side, inside in zip(SIDES, in_account)
    ]
    per_page = _grouped(posts.filter(" OR ".join(in_posts)), totals)
    gained = _grouped(account_daily.filter(" OR ".join(in_account)).dropDuplicates(), gains)
    both = for_accounts(per_page.join(gained, "page_id", "full"), accounts)
    both = both.na.fill(0, [c for c in both.columns if c != "page_id"])
    return both.selectExpr("page_id", *[
        f"{_value(side, name)} AS {side}_{name}" for side in SIDES for name in METRICS
    ])


def kpi_history(posts: DataFrame, account_daily: DataFrame, until: AsOf, frame_days: int = KPI_FRAME_DAYS) -> DataFrame:
    """``period_kpis`` (reference windows) of every day, taken as of its midnight, from the first
    day an account has a row on until ``until``; a row per account and day ``as_of``.

    Totals per account and day are made first, days without rows among them; one pass of range
    frames over the days then gives both periods of each. Windows are closed, so posts of the very
    midnight a window ends on count: they are kept as totals of their own.
    """
    sums = {"posts": "1", "reach": "reach", "likes": "like_count", "comments": "comments_count"}
    day, last = "CAST(created_time AS DATE)", day_sql(to_day(until))
    sharp = f"created_time = CAST({day} AS TIMESTAMP_NTZ)"
    dated = posts.filter(f"created_time IS NOT NULL AND {day} <= {last}").withColumn("day", F.expr(day))
    totals = dated.groupBy("page_id", "day").agg(
        *[F.expr(f"sum({x}) AS {name}") for name, x in sums.items()], *[F.expr(f"sum({x}) FILTER (WHERE {sharp}) AS sharp_{name}") for name, x in sums.items()])
    gains = account_daily.filter(f"date IS NOT NULL AND date <= {last}").dropDuplicates().groupBy("page_id", F.col("date").alias("day")).agg(
        F.sum("follower_count").alias("gained"))
    known = totals.unionByName(gains, allowMissingColumns=True)
    first = known.groupBy("page_id").agg(F.min("day").alias("first"))
    spine = first.select("page_id", F.explode(F.expr(f"sequence(first, {last})")).alias("day"))
    names = [*sums, *[f"sharp_{name}" for name in sums], "gained"]
    per_day = known.unionByName(spine, allowMissingColumns=True).groupBy("page_id", "day").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    by_day, n = Window.partitionBy("page_id").orderBy(F.unix_date("day")), frame_days

    def over(column: str, low: int, high: int) -> Column:
        return F.coalesce(F.sum(column).over(by_day.rangeBetween(low, high)), F.lit(0))

    figures = []
    for side, low, high in (("cur", -n, 0), ("prev", -2 * n, -n - 1)):
        for name in sums:
            figures.append((over(name, low, high - 1) + over(f"sharp_{name}", high, high)).alias(f"{side}_total_{name}"))
        figures.append(over("gained", low, high).alias(f"{side}_followers_gained"))
    both = per_day.select("page_id", F.col("day").alias("as_of"), *figures)
    return both.selectExpr("page_id", "as_of", *[f"{_value(side, name)} AS {side}_{name}" for side in SIDES for name in METRICS])


def for_accounts(figures: DataFrame, accounts: DataFrame | None) -> DataFrame:
    """A row for each ``page_id`` of ``accounts``, whether or not it has figures."""
    if accounts is None:
        return figures
    return accounts.select("page_id").distinct().join(figures, "page_id", "left")


def _grouped(rows: DataFrame, figures: list[str]) -> DataFrame:
    return rows.groupBy("page_id").agg(*[F.expr(figure) for figure in figures])


def _value(side: str, name: str) -> str:
    if name not in KPI_RATIOS:
        return f"{side}_{name}"
    top, bottom = KPI_RATIOS[name]
    return safe_ratio_sql(f"{side}_{top}", f"{side}_{bottom}")


def with_differences(kpis: DataFrame) -> DataFrame:
    """Percent change of every metric as ``diff_*``."""
    return kpis.selectExpr("*", *[
        f"{pct_diff_sql(f'cur_{name}', f'prev_{name}')} AS diff_{name}" for name in METRICS
    ])


def _value_text(name: str) -> str:
    if name not in KPI_RATIOS:
        return thousands_sql(f"cur_{name}")
    return f"CASE WHEN cur_{KPI_RATIOS[name][1]} > 0 THEN {plain_number_sql(f'cur_{name}')} ELSE '0' END"


def static_summary(kpis_with_differences: DataFrame) -> DataFrame:
    """One text per account: a line for each metric with its change."""
    lines = [
        f"concat('{label}: ', {_value_text(name)}, ' (', "
        f"coalesce({signed_percent_sql(f'diff_{name}')}, '{NO_DIFFERENCE}'), ' from the previous period)')"
        for name, label in KPI_LABELS
    ]
    return kpis_with_differences.selectExpr("page_id", f"concat_ws('\\n', {', '.join(lines)}) AS summary")


def change_rows(kpis_with_differences: DataFrame) -> DataFrame:
    """Long form: one row per account and metric with its change and change style."""
    entries = ", ".join(
        f"'{label}', CAST(cur_{name} AS DOUBLE), CAST(prev_{name} AS DOUBLE), diff_{name}"
        for name, label in KPI_LABELS
    )
    stacked = f"stack({len(KPI_LABELS)}, {entries}) AS (metric, current, previous, difference)"
    rows = kpis_with_differences.selectExpr("page_id", stacked)
    return rows.selectExpr("*", f"{sign_class_sql('difference')} AS style")


_CARDS = (
    ("new_follows", "followers_gained", thousands_sql),
    ("posts", "total_posts", thousands_sql),
    ("avg_reach", "average_reach", two_decimals_sql),
    ("avg_likes", "average_likes", two_decimals_sql),
)


def period_scorecards(kpis_with_differences: DataFrame) -> DataFrame:
    """The four weekly cards as display text, with change text and style."""
    columns = []
    for card, name, shown in _CARDS:
        diff = f"diff_{name}"
        columns += [
            f"{shown(f'cur_{name}')} AS {card}", f"{signed_percent_sql(diff)} AS {card}_change",
            f"{sign_class_sql(diff)} AS {card}_style",
        ]
    return kpis_with_differences.selectExpr("page_id", *columns)


def alltime_kpis(posts: DataFrame, account_daily: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Followers on the newest account day, number of posts, mean reach and likes.

    An account without posts, or without account days, shows 0 for those figures; one
    without either is listed if it is among ``accounts``.
    """
    followers = _grouped(one_per_day(account_daily, "total_followers"), [
        "max_by(total_followers, date) AS total_followers", "true AS _tracked",
    ])
    per_page = _grouped(posts, [
        "count(*) AS total_posts", "try_divide(sum(reach), count(reach)) AS avg_reach",
        "try_divide(sum(like_count), count(like_count)) AS avg_likes", "true AS _posted",
    ])
    return for_accounts(per_page.join(followers, "page_id", "full"), accounts).selectExpr(
        "page_id", "CASE WHEN _tracked THEN total_followers ELSE 0 END AS total_followers",
        "coalesce(total_posts, 0) AS total_posts", "CASE WHEN _posted THEN avg_reach ELSE 0D END AS avg_reach",
        "CASE WHEN _posted THEN avg_likes ELSE 0D END AS avg_likes",
    )


def alltime_scorecards(kpis: DataFrame) -> DataFrame:
    """The four all-time cards as display text."""
    return kpis.selectExpr(
        "page_id", f"{thousands_sql('total_followers')} AS followers", f"{thousands_sql('total_posts')} AS posts",
        f"{two_decimals_sql('avg_reach')} AS avg_reach", f"{two_decimals_sql('avg_likes', False)} AS avg_likes",
    )
