"""Scans, KPIs, series, audience."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as t
from checks.sql import STYLE, change, fixed2, grouped, plain, signed
from reachlens.fixed_values import KPI_LABELS, KPI_RATIOS
from reachlens.functions.dates import iso_date, month_start, parse_time, yesterday_in_zone
from reachlens.functions.numbers import to_number
from reachlens.operators import audience, cards, engagement, kpi, series
from reachlens.sources.tables import registered_pages, run_query, snapshot

QUERIES, SQL = {}, {}


def check(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# --- scans -----------------------------------------------------------------------


@check("tenant_scan", t.with_sql("posts") + "SELECT * FROM posts WHERE page_id IN (SELECT c_custkey FROM customer)")
def tenant_scan(spark, d):
    registry = t.table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"))
    return registered_pages(t.posts(spark, d), registry)


@check("query_scan", "SELECT event_type, count(*) AS events FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1")
def query_scan(spark, d):
    t.table(spark, d, "events").createOrReplaceTempView("events_view")
    return run_query(
        spark, "SELECT event_type, count(*) AS events FROM events_view WHERE ts >= CAST(:start AS TIMESTAMP_NTZ) GROUP BY 1",
        {"start": "2024-01-15"},
    )


@check("snapshot_scan", t.with_sql("posts") + "SELECT * FROM posts WHERE insert_date = DATE '2024-01-30'")
def snapshot_scan(spark, d):
    return snapshot(t.posts(spark, d), t.AS_OF)


@check("zone_yesterday", """
SELECT event_id, CAST(ts - INTERVAL 8 HOURS AS DATE) - 1 AS yesterday, strftime(ts, '%Y-%m-%d') AS iso_day,
  strptime(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S') AS reparsed, DATE '2024-01-01' AS month_start
FROM events""")
def zone_yesterday(spark, d):
    ts = F.col("ts")
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return t.table(spark, d, "events").select(
        "event_id", yesterday_in_zone(ts).alias("yesterday"), iso_date(ts).alias("iso_day"),
        parse_time(text).alias("reparsed"), month_start(t.AS_OF).alias("month_start"),
    )


# --- KPIs ------------------------------------------------------------------------

_CUR_POST = "created_time BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-31'"
_PREV_POST = "created_time BETWEEN TIMESTAMP '2024-01-17' AND TIMESTAMP '2024-01-23'"
_CUR_DAY = "date BETWEEN DATE '2024-01-24' AND DATE '2024-01-31'"
_PREV_DAY = "date BETWEEN DATE '2024-01-17' AND DATE '2024-01-23'"
_BALANCED = (
    "created_time > TIMESTAMP '2024-01-24' AND created_time <= TIMESTAMP '2024-01-31'",
    "created_time > TIMESTAMP '2024-01-17' AND created_time <= TIMESTAMP '2024-01-24'",
    "date > DATE '2024-01-24' AND date <= DATE '2024-01-31'",
    "date > DATE '2024-01-17' AND date <= DATE '2024-01-24'",
)


def _kpi_sql(cur_post: str, prev_post: str, cur_day: str, prev_day: str) -> str:
    posts, account, out = [], [], ["page_id"]
    for side, in_post, in_day in (("cur", cur_post, cur_day), ("prev", prev_post, prev_day)):
        posts.append(f"count(*) FILTER ({in_post}) AS {side}_total_posts")
        for name, column in (("reach", "reach"), ("likes", "like_count"), ("comments", "comments_count")):
            posts.append(f"CAST(coalesce(sum({column}) FILTER ({in_post}), 0) AS BIGINT) AS {side}_total_{name}")
        account.append(f"CAST(coalesce(sum(follower_count) FILTER ({in_day}), 0) AS BIGINT) AS {side}_followers_gained")
        for name, _ in KPI_LABELS:
            if name in KPI_RATIOS:
                top, bottom = KPI_RATIOS[name]
                top, bottom = f"coalesce({side}_{top}, 0)", f"coalesce({side}_{bottom}, 0)"
                out.append(f"CASE WHEN {bottom} > 0 THEN CAST({top} AS DOUBLE) / {bottom} ELSE 0.0::DOUBLE END AS {side}_{name}")
            else:
                out.append(f"coalesce({side}_{name}, 0) AS {side}_{name}")
    return (
        f"SELECT {', '.join(out)} FROM (SELECT page_id, {', '.join(posts)} FROM posts "
        f"WHERE ({cur_post}) OR ({prev_post}) GROUP BY 1) p FULL JOIN (SELECT page_id, {', '.join(account)} "
        f"FROM (SELECT DISTINCT * FROM account) WHERE ({cur_day}) OR ({prev_day}) GROUP BY 1) a USING (page_id)"
    )


_KPIS = _kpi_sql(_CUR_POST, _PREV_POST, _CUR_DAY, _PREV_DAY)
_DIFFS = ", ".join(f"{change(f'cur_{m}', f'prev_{m}')} AS diff_{m}" for m, _ in KPI_LABELS)
_WITH_DIFFS = f"{t.with_sql('account')}, k AS ({_KPIS}), kd AS (SELECT *, {_DIFFS} FROM k) "


def kpis(spark, d):
    return kpi.with_differences(kpi.period_kpis(t.posts(spark, d), t.account_daily(spark, d), t.AS_OF))


def _accounts(spark, d):
    """Every customer is an account, with or without rows elsewhere."""
    return t.table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"))


@check("period_kpis_all_accounts", t.with_sql("account") + f""", k AS ({_KPIS}), accounts AS (SELECT c_custkey AS page_id FROM customer)
SELECT page_id, {', '.join(f"coalesce({side}_{m}, 0) AS {side}_{m}" for side in ('cur', 'prev') for m, _ in KPI_LABELS)}
FROM accounts LEFT JOIN k USING (page_id)""")
def period_kpis_all_accounts(spark, d):
    return kpi.period_kpis(t.posts(spark, d), t.account_daily(spark, d), t.AS_OF, accounts=_accounts(spark, d))


@check("period_kpis", t.with_sql("account") + _KPIS)
def period_kpis(spark, d):
    return kpi.period_kpis(t.posts(spark, d), t.account_daily(spark, d), t.AS_OF)


@check("period_kpis_balanced", t.with_sql("account") + _kpi_sql(*_BALANCED))
def period_kpis_balanced(spark, d):
    return kpi.period_kpis(t.posts(spark, d), t.account_daily(spark, d), t.AS_OF, mode="balanced")


_HISTORY_SIDES = ", ".join(f"""
  coalesce((SELECT count(*) FROM posts p WHERE p.page_id = s.page_id AND p.created_time BETWEEN as_of - {a} AND as_of - {b}), 0) AS {side}_total_posts,
  coalesce((SELECT CAST(sum(follower_count) AS BIGINT) FROM account c WHERE c.page_id = s.page_id AND c.date BETWEEN as_of - {a} AND as_of - {b}), 0) AS {side}_followers_gained,
  """ + ", ".join(f"coalesce((SELECT CAST(sum({c}) AS BIGINT) FROM posts p WHERE p.page_id = s.page_id AND p.created_time BETWEEN as_of - {a} AND as_of - {b}), 0) AS {side}_total_{m}"
                for m, c in (("reach", "reach"), ("likes", "like_count"), ("comments", "comments_count")))
  for side, a, b in (("cur", 7, 0), ("prev", 14, 8)))


@check("kpi_history", t.with_sql("account") + f""", spine AS (SELECT page_id, CAST(unnest(generate_series(first, DATE '{t.AS_OF}', INTERVAL 1 DAY)) AS DATE) AS as_of
FROM (SELECT page_id, min(d) AS first FROM (SELECT page_id, CAST(created_time AS DATE) AS d FROM posts UNION ALL SELECT page_id, date FROM account)
  WHERE d <= DATE '{t.AS_OF}' GROUP BY 1)),
k AS (SELECT page_id, as_of, {_HISTORY_SIDES} FROM spine s)
SELECT page_id, as_of, {', '.join(
    f"CASE WHEN {s}_{KPI_RATIOS[m][1]} > 0 THEN CAST({s}_{KPI_RATIOS[m][0]} AS DOUBLE) / {s}_{KPI_RATIOS[m][1]} ELSE 0.0::DOUBLE END AS {s}_{m}" if m in KPI_RATIOS else f"{s}_{m}"
    for s in ('cur', 'prev') for m, _ in KPI_LABELS)} FROM k""")
def kpi_history(spark, d):
    return kpi.kpi_history(t.posts(spark, d), t.account_daily(spark, d), t.AS_OF)


QUERIES["kpi_differences"] = kpis
SQL["kpi_differences"] = _WITH_DIFFS + "SELECT * FROM kd"


@check("pct_diff", _WITH_DIFFS + " UNION ALL ".join(
    f"SELECT page_id, '{label}' AS metric, CAST(cur_{m} AS DOUBLE) AS current, CAST(prev_{m} AS DOUBLE) AS previous, "
    f"diff_{m} AS difference, {STYLE.format(f'diff_{m}')} AS style FROM kd" for m, label in KPI_LABELS))
def pct_diff(spark, d):
    return kpi.change_rows(kpis(spark, d))


def _summary_value(m: str) -> str:
    if m not in KPI_RATIOS:
        return grouped(f"cur_{m}")
    return f"CASE WHEN cur_{KPI_RATIOS[m][1]} > 0 THEN {plain(f'cur_{m}')} ELSE '0' END"


_LINES = ", ".join(
    f"'{label}: ' || {_summary_value(m)} || ' (' || coalesce({signed(f'diff_{m}')}, 'N/A') || ' from the previous period)'"
    for m, label in KPI_LABELS
)
SUMMARY_CTE = _WITH_DIFFS + f", summaries AS (SELECT page_id, concat_ws(chr(10), {_LINES}) AS summary FROM kd) "


@check("static_summary", SUMMARY_CTE + "SELECT * FROM summaries")
def static_summary(spark, d):
    return kpi.static_summary(kpis(spark, d))


_CARDS = (("new_follows", "followers_gained", 0), ("posts", "total_posts", 0),
          ("avg_reach", "average_reach", 2), ("avg_likes", "average_likes", 2))


@check("period_scorecards", _WITH_DIFFS + "SELECT page_id, " + ", ".join(
    f"{fixed2(f'cur_{m}') if dec else grouped(f'cur_{m}')} AS {card}, {signed(f'diff_{m}')} AS {card}_change, "
    f"{STYLE.format(f'diff_{m}')} AS {card}_style" for card, m, dec in _CARDS) + " FROM kd")
def period_scorecards(spark, d):
    return kpi.period_scorecards(kpis(spark, d))


_ALLTIME = t.with_sql("account") + """, k AS (
SELECT page_id, CASE WHEN a.page_id IS NULL THEN 0 ELSE total_followers END AS total_followers,
  coalesce(total_posts, 0) AS total_posts, CASE WHEN p.page_id IS NULL THEN 0 ELSE avg_reach END AS avg_reach,
  CASE WHEN p.page_id IS NULL THEN 0 ELSE avg_likes END AS avg_likes
FROM (SELECT page_id, count(*) AS total_posts, avg(reach) AS avg_reach, avg(like_count) AS avg_likes FROM posts GROUP BY 1) p
FULL JOIN (SELECT page_id, arg_max(total_followers, date) AS total_followers FROM account GROUP BY 1) a USING (page_id)) """


@check("alltime_kpis", _ALLTIME + "SELECT * FROM k")
def alltime_kpis(spark, d):
    return kpi.alltime_kpis(t.posts(spark, d), t.account_daily(spark, d))


@check("alltime_kpis_all_accounts", _ALLTIME + """, accounts AS (SELECT c_custkey AS page_id FROM customer)
SELECT page_id, CASE WHEN k.page_id IS NULL THEN 0 ELSE total_followers END AS total_followers, coalesce(total_posts, 0) AS total_posts,
  CASE WHEN k.page_id IS NULL THEN 0 ELSE avg_reach END AS avg_reach, CASE WHEN k.page_id IS NULL THEN 0 ELSE avg_likes END AS avg_likes
FROM accounts LEFT JOIN k USING (page_id)""")
def alltime_kpis_all_accounts(spark, d):
    return kpi.alltime_kpis(t.posts(spark, d), t.account_daily(spark, d), _accounts(spark, d))


@check("alltime_scorecards", _ALLTIME + f"""SELECT page_id, {grouped('total_followers')} AS followers,
{grouped('total_posts')} AS posts, {fixed2('avg_reach')} AS avg_reach, {fixed2('avg_likes', False)} AS avg_likes FROM k""")
def alltime_scorecards(spark, d):
    return kpi.alltime_scorecards(alltime_kpis(spark, d))


# --- series ----------------------------------------------------------------------


@check("daily_counts", t.with_sql("account") + """
SELECT a.*, CASE WHEN a.date BETWEEN DATE '2023-12-31' AND DATE '2024-01-30' THEN coalesce(n, 0) END AS post_count
FROM (SELECT DISTINCT * FROM account) a LEFT JOIN (
  SELECT page_id, CAST(created_time AS DATE) AS date, count(*) AS n FROM posts GROUP BY 1, 2) c
ON a.page_id = c.page_id AND a.date = c.date""")
def daily_counts(spark, d):
    return series.daily_counts(t.posts(spark, d), t.account_daily(spark, d), t.AS_OF)


_FILLED = t.with_sql("account") + """, span AS (
  SELECT page_id, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM account GROUP BY page_id),
filled AS (SELECT page_id, date, last_value({m} IGNORE NULLS) OVER (
  PARTITION BY page_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {m}, {m} AS raw
  FROM span LEFT JOIN account USING (page_id, date)) """


@check("gap_fill", _FILLED.format(m="total_followers") + "SELECT page_id, date, total_followers FROM filled")
def gap_fill(spark, d):
    return series.fill_gaps(t.account_daily(spark, d), "total_followers")


@check("gap_days", _FILLED.format(m="impressions") + "SELECT page_id, date, raw AS impressions FROM filled")
def gap_days(spark, d):
    return series.fill_gaps(t.account_daily(spark, d), "impressions", fill=None)


@check("series_extent", _FILLED.format(m="reach") + """
SELECT page_id, min(date) AS first_date, max(date) AS last_date, min(reach) AS min_reach, max(reach) AS max_reach
FROM filled GROUP BY 1""")
def series_extent(spark, d):
    return series.series_extent(series.fill_gaps(t.account_daily(spark, d), "reach"), "reach")


@check("post_markers", """
SELECT DISTINCT o_custkey AS page_id, CAST(o_orderdate AS DATE) AS date FROM orders
JOIN (SELECT l_suppkey AS page_id, min(CAST(l_shipdate AS DATE)) AS first FROM lineitem GROUP BY 1) f
ON o_custkey = f.page_id WHERE CAST(o_orderdate AS DATE) >= first""")
def post_markers(spark, d):
    orders = t.table(spark, d, "orders").select(
        F.col("o_custkey").alias("page_id"), F.col("o_orderdate").alias("created_time")
    )
    days = t.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("page_id"), F.to_date("l_shipdate").alias("date")
    )
    return series.post_markers(orders, days)


@check("calendar_events", t.with_sql("posts") + """
SELECT page_id, post_id, 'Past Post: ' || substr(caption, 1, 10) AS title, strftime(created_time, '%Y-%m-%d') AS start,
  strftime(created_time, '%Y-%m-%d') AS "end", '#FF6C6C' AS color FROM posts""")
def calendar_events(spark, d):
    return cards.calendar_events(t.posts(spark, d))


@check("headed_series", t.with_sql("account") + """SELECT page_id, date, total_followers AS "Total Followers",
follower_count AS "Followers Gained", reach AS "Reach", impressions AS "Impressions" FROM account""")
def headed_series(spark, d):
    return series.with_headings(t.account_daily(spark, d))


@check("post_days", t.with_sql("posts") + "SELECT DISTINCT page_id, CAST(created_time AS DATE) AS date FROM posts")
def post_days(spark, d):
    return series.post_days(t.posts(spark, d))


@check("numeric_coercion", """SELECT o_orderkey, TRY_CAST(
CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderpriority END AS DOUBLE) AS number FROM orders""")
def numeric_coercion(spark, d):
    rows = t.table(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS STRING) ELSE o_orderpriority END AS text")
    return rows.select("o_orderkey", to_number(F.col("text")).alias("number"))


# --- audience --------------------------------------------------------------------


@check("demographic_share", t.with_sql("demographics") + """
SELECT page_id, breakdown, value, CAST(sum(followers) AS BIGINT) AS followers,
  sum(followers) * 100.0::DOUBLE / sum(sum(followers)) OVER (PARTITION BY page_id, breakdown) AS percent
FROM demographics GROUP BY 1, 2, 3""")
def demographic_share(spark, d):
    return audience.demographic_share(t.demographics(spark, d))


@check("breakdown_list", t.with_sql("demographics") + "SELECT DISTINCT page_id, breakdown FROM demographics")
def breakdown_list(spark, d):
    return audience.breakdown_list(t.demographics(spark, d))


_ADS = t.with_sql("ads") + """, totals AS (
SELECT page_id, spend, reach, clicks / 5.0::DOUBLE AS boosted_follows,
  CASE WHEN clicks <> 0 THEN spend / (clicks / 5.0::DOUBLE) END AS cost_per_follow FROM (
  SELECT page_id, CAST(coalesce(sum(CAST(spend AS DECIMAL(28, 9))) FILTER (hit), 0) AS DOUBLE) AS spend,
    CAST(coalesce(sum(reach) FILTER (hit), 0) AS BIGINT) AS reach, CAST(coalesce(sum(clicks) FILTER (hit), 0) AS BIGINT) AS clicks
  FROM (SELECT *, contains(lower(ad_name), 'ring') AS hit FROM ads) GROUP BY 1)) """


@check("ad_totals", _ADS + "SELECT * FROM totals")
def ad_totals(spark, d):
    return audience.ad_totals(t.ads(spark, d), "RING")


@check("ad_totals_all_accounts", _ADS + """, accounts AS (SELECT c_custkey AS page_id FROM customer)
SELECT page_id, coalesce(spend, 0) AS spend, coalesce(reach, 0) AS reach, coalesce(boosted_follows, 0) AS boosted_follows,
  cost_per_follow FROM accounts LEFT JOIN totals USING (page_id)""")
def ad_totals_all_accounts(spark, d):
    return audience.ad_totals(t.ads(spark, d), "RING", accounts=_accounts(spark, d))


@check("ad_scorecards", _ADS + f"""SELECT page_id, '$' || {plain('spend')} AS ad_spend, {grouped('reach')} AS reach,
{plain('boosted_follows')} AS boosted_follows, '$' || {fixed2('cost_per_follow')} AS cost_per_follow FROM totals""")
def ad_scorecards(spark, d):
    return audience.ad_scorecards(audience.ad_totals(t.ads(spark, d), "RING"))


@check("like_rate", t.with_sql("posts") + """
SELECT post_id, CASE WHEN reach <> 0 OR like_count > 0 THEN
  round_even(CAST(like_count AS DOUBLE) / reach * 100.0::DOUBLE, 2) END AS like_rate, CAST(created_time AS DATE) AS post_date FROM posts""")
def like_rate(spark, d):
    return engagement.with_like_rate(t.posts(spark, d)).select("post_id", "like_rate", "post_date")
