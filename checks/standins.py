"""Account tables derived from the test tables, in Spark and in SQL.

The test data has no social-media tables. Every stand-in reads a whole test table and
maps each of its rows; ``SQL`` holds the same mapping as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reachlens.sources.schemas import POST_ANALYSIS, POSTS, conform

AS_OF = "2024-01-31"

SQL: dict[str, str] = {}

# Declared, so that opening a table does not first read a file for its schema.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def with_sql(*names: str) -> str:
    """WITH clause for the named stand-ins and those they build on."""
    wanted: list[str] = []
    for name in names:
        for dependency in {"account": ["posts"]}.get(name, []):
            if dependency not in wanted:
                wanted.append(dependency)
        if name not in wanted:
            wanted.append(name)
    return "WITH " + ", ".join(f"{name} AS ({SQL[name]})" for name in wanted) + " "


CAPTION = "concat(o_orderpriority, ' offer for all who order before the end of the week, no. ', o_orderkey)"


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """events: one row is one post of the account user_id."""
    rows = table(spark, folder, "events").selectExpr("*", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k")
    return conform(rows.selectExpr(
        "user_id AS page_id", "CAST(event_id AS STRING) AS post_id", "CAST(ts AS DATE) AS insert_date",
        "ts AS created_time", "concat(event_type, ' ', props) AS caption", "CAST(round(value * 100) AS BIGINT) AS reach",
        "k AS like_count", "k % 10 AS comments_count", "k % 7 AS saved", "k % 5 AS shares",
        "CASE WHEN event_type IN ('view', 'click') THEN 'VIDEO' ELSE 'IMAGE' END AS media_type",
        "concat('https://media.example.com/', event_id) AS source",
    ), POSTS)


SQL["posts"] = """
SELECT user_id AS page_id, CAST(event_id AS VARCHAR) AS post_id, CAST(ts AS DATE) AS insert_date,
  ts AS created_time, event_type || ' ' || props AS caption, CAST(round(value * 100) AS BIGINT) AS reach,
  k AS like_count, k % 10 AS comments_count, k % 7 AS saved, k % 5 AS shares,
  CASE WHEN event_type IN ('view', 'click') THEN 'VIDEO' ELSE 'IMAGE' END AS media_type,
  'https://media.example.com/' || CAST(event_id AS VARCHAR) AS source
FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events)"""


def account_daily(spark: SparkSession, folder: str) -> DataFrame:
    """events rolled up per account and day; days without events are real gaps."""
    rows = posts(spark, folder).selectExpr(
        "page_id", "CAST(created_time AS DATE) AS date", "comments_count AS follower_count",
        "CAST(post_id AS BIGINT) AS total_followers", "reach", "reach + like_count AS impressions",
    )
    return rows.groupBy("page_id", "date").agg(
        F.sum("follower_count").alias("follower_count"), F.max("total_followers").alias("total_followers"),
        F.sum("reach").alias("reach"), F.sum("impressions").alias("impressions"),
    )


SQL["account"] = """
SELECT page_id, CAST(created_time AS DATE) AS date, CAST(sum(comments_count) AS BIGINT) AS follower_count,
  max(CAST(post_id AS BIGINT)) AS total_followers, CAST(sum(reach) AS BIGINT) AS reach,
  CAST(sum(reach + like_count) AS BIGINT) AS impressions
FROM posts GROUP BY 1, 2"""


def analysis(spark: SparkSession, folder: str) -> DataFrame:
    """documents with their labels: one analysed video per document."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return conform(docs.selectExpr(
        "CAST(NULL AS BIGINT) AS page_id", "CAST(doc_id AS STRING) AS video_id",
        "TIMESTAMP_NTZ '2024-01-01' AS created_time",
        *[f"n_chars AS {c}" for c in ("reach", "like_count", "comments_count", "shares", "saved")],
        "lang AS main_theme", "concat(lang, '_', source) AS most_common_word", "source AS main_focus",
        "CASE toxic WHEN 1 THEN 'dark' WHEN 0 THEN 'light' END AS color_scheme",
        "concat(n_chars % 24, ':00') AS time_of_day", "'9 AM' AS time_bucket", "'Monday' AS weekday",
        "CAST(n_chars % 60 AS DOUBLE) AS video_len", "n_chars % 12 AS shot_count",
        "(n_chars % 40) / 4 AS avg_shot_len", "(n_chars % 80) / 4 AS longest_shot", "n_chars % 9 AS object_count",
        "CAST(quality AS BIGINT) AS face_count", "concat(source, ',', lang) AS labels_extracted",
        "source AS background_imagery", "CAST(NULL AS STRING) AS text_from_video", "n_chars AS caption_length",
        "concat('#', lang) AS hashtags", "1L AS hashtag_count",
        "CASE quality WHEN 1 THEN 'follow' WHEN 0 THEN 'visit' END AS call_to_action",
        "n_chars / 24 AS words_per_frame", "text AS raw_speech", "text AS processed_speech",
        "CAST(length(text) AS BIGINT) AS speech_length", "n_chars / 7 AS speech_rate",
        "CASE quality WHEN 1 THEN 'music' END AS sound_type", "CAST(n_chars % 120 AS DOUBLE) AS bpm", "'calm' AS mood",
        "CASE WHEN n_chars % 2 = 0 THEN 'positive' ELSE 'negative' END AS sentiment",
        "(n_chars % 21 - 10) / 10 AS polarity", "(n_chars % 11) / 10 AS subjectivity", "'warm' AS tone",
        "n_chars % 50 AS common_word_count", "n_chars % 6 AS theme_repetition",
    ), POST_ANALYSIS)


SQL["analysis"] = """
SELECT CAST(d.doc_id AS VARCHAR) AS video_id, lang AS main_theme, lang || '_' || source AS most_common_word,
  source AS main_focus, CASE toxic WHEN 1 THEN 'dark' WHEN 0 THEN 'light' END AS color_scheme,
  CAST(n_chars % 24 AS VARCHAR) || ':00' AS time_of_day, '9 AM' AS time_bucket, 'Monday' AS weekday,
  CAST(n_chars % 60 AS DOUBLE) AS video_len, n_chars % 12 AS shot_count, (n_chars % 40) / 4.0::DOUBLE AS avg_shot_len,
  (n_chars % 80) / 4.0::DOUBLE AS longest_shot, n_chars % 9 AS object_count, CAST(quality AS BIGINT) AS face_count,
  source || ',' || lang AS labels_extracted, source AS background_imagery, CAST(NULL AS VARCHAR) AS text_from_video,
  n_chars AS caption_length, '#' || lang AS hashtags, CAST(1 AS BIGINT) AS hashtag_count,
  CASE quality WHEN 1 THEN 'follow' WHEN 0 THEN 'visit' END AS call_to_action,
  n_chars / 24.0::DOUBLE AS words_per_frame, text AS raw_speech, text AS processed_speech,
  CAST(length(text) AS BIGINT) AS speech_length, round_even(n_chars / 7.0::DOUBLE, 2) AS speech_rate,
  CASE quality WHEN 1 THEN 'music' END AS sound_type, CAST(n_chars % 120 AS DOUBLE) AS bpm, 'calm' AS mood,
  CASE WHEN n_chars % 2 = 0 THEN 'positive' ELSE 'negative' END AS sentiment,
  (n_chars % 21 - 10) / 10.0::DOUBLE AS polarity, (n_chars % 11) / 10.0::DOUBLE AS subjectivity, 'warm' AS tone,
  n_chars % 50 AS common_word_count, n_chars % 6 AS theme_repetition
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def sold_posts(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem: one row is one showing of the post l_partkey on account l_suppkey."""
    return table(spark, folder, "lineitem").selectExpr(
        "l_suppkey AS page_id", "CAST(l_partkey AS STRING) AS post_id", "l_shipdate AS created_time",
        "CAST(round(l_extendedprice * 100) AS BIGINT) AS reach", "CAST(l_quantity AS BIGINT) AS like_count",
        "l_discount AS polarity", "l_quantity AS video_len", "l_returnflag AS call_to_action",
    )


SQL["sold_posts"] = """
SELECT l_suppkey AS page_id, CAST(l_partkey AS VARCHAR) AS post_id, l_shipdate AS created_time,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS reach, CAST(l_quantity AS BIGINT) AS like_count,
  l_discount AS polarity, l_quantity AS video_len, l_returnflag AS call_to_action
FROM lineitem"""


def part_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """part: one analysed video per part."""
    return table(spark, folder, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS video_id", "CAST(NULL AS TIMESTAMP_NTZ) AS created_time", "p_type AS main_theme",
        "p_brand AS main_focus", "p_size AS shot_count", "p_size % 9 AS object_count",
    )


SQL["part_analysis"] = """
SELECT CAST(p_partkey AS VARCHAR) AS video_id, p_type AS main_theme, p_brand AS main_focus,
  p_size AS shot_count, p_size % 9 AS object_count
FROM part"""


def demographics(spark: SparkSession, folder: str) -> DataFrame:
    """customers by region and nation; segments with names of one length form an account."""
    region = table(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    nation = table(spark, folder, "nation").join(region, "n_regionkey").withColumnRenamed("n_nationkey", "c_nationkey")
    return table(spark, folder, "customer").join(nation, "c_nationkey").selectExpr(
        "CAST(length(c_mktsegment) AS BIGINT) AS page_id", "r_name AS breakdown", "n_name AS value",
        "c_custkey % 100 + 1 AS followers",
    )


SQL["demographics"] = """
SELECT CAST(length(c_mktsegment) AS BIGINT) AS page_id, r_name AS breakdown, n_name AS value,
  c_custkey % 100 + 1 AS followers
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def ads(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with its part name: one row is one ad of the account l_suppkey."""
    parts = table(spark, folder, "part").selectExpr("p_partkey AS l_partkey", "p_name")
    return table(spark, folder, "lineitem").join(parts, "l_partkey").selectExpr(
        "l_suppkey AS page_id", "p_name AS ad_name", "l_extendedprice AS spend", "l_partkey AS reach",
        "CAST(l_quantity AS BIGINT) AS clicks",
    )


SQL["ads"] = """
SELECT l_suppkey AS page_id, p_name AS ad_name, l_extendedprice AS spend, l_partkey AS reach,
  CAST(l_quantity AS BIGINT) AS clicks
FROM lineitem JOIN part ON l_partkey = p_partkey"""


def ideas(spark: SparkSession, folder: str) -> DataFrame:
    """orders: one row is one planned post of the account o_custkey."""
    return table(spark, folder, "orders").selectExpr(
        "o_custkey AS page_id", "date_format(o_orderdate, 'yyyy-MM-dd') AS date",
        "concat('Order ', o_orderkey) AS post_summary", f"{CAPTION} AS caption",
        "CASE o_orderstatus WHEN 'F' THEN 'Reel' WHEN 'O' THEN 'Story' ELSE 'Static Post' END AS post_type",
        "concat(o_orderpriority, ',', o_orderstatus) AS themes", "o_orderpriority AS tone", "'User' AS source",
    )


SQL["ideas"] = """
SELECT o_custkey AS page_id, strftime(o_orderdate, '%Y-%m-%d') AS date,
  'Order ' || CAST(o_orderkey AS VARCHAR) AS post_summary,
  o_orderpriority || ' offer for all who order before the end of the week, no. ' || CAST(o_orderkey AS VARCHAR) AS caption,
  CASE o_orderstatus WHEN 'F' THEN 'Reel' WHEN 'O' THEN 'Story' ELSE 'Static Post' END AS post_type,
  o_orderpriority || ',' || o_orderstatus AS themes, o_orderpriority AS tone, 'User' AS source
FROM orders"""


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """documents as dated notes of an account per text source."""
    return table(spark, folder, "documents").selectExpr(
        "CAST(substring(source, 4) AS BIGINT) AS page_id",
        f"date_sub(DATE '{AS_OF}', CAST(n_chars % 700 AS INT)) AS update_date", "doc_id", "lang", "text",
    )


SQL["notes"] = f"""
SELECT CAST(substr(source, 4) AS BIGINT) AS page_id,
  DATE '{AS_OF}' - CAST(n_chars % 700 AS INTEGER) AS update_date, doc_id, lang, text
FROM documents"""


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """pages: one row is one stored file, named after the last part of its path."""
    return table(spark, folder, "pages").selectExpr(
        r"concat(regexp_extract(url, r'([0-9]+)[^0-9/]*[^/]*/?$', 1), "
        "CASE WHEN url LIKE '%.net/%' THEN '.mov' ELSE '.mp4' END) AS name",
        "url", "CASE WHEN url LIKE 'http:%' THEN 'image/png' ELSE 'video/mp4' END AS mime", "page_id AS file_no",
    )


SQL["listing"] = r"""
SELECT regexp_extract(url, '([0-9]+)[^0-9/]*[^/]*/?$', 1) || '.' ||
    CASE WHEN url LIKE '%.net/%' THEN 'mov' ELSE 'mp4' END AS name,
  url, CASE WHEN url LIKE 'http:%' THEN 'image/png' ELSE 'video/mp4' END AS mime, page_id AS file_no
FROM pages"""


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """events: one row is one model reply, an object wrapped in other text. The
    replies to one kind of event break off in the middle."""
    body = """concat('{"post_summary": "', event_type, '",\\n "caption": "c', event_id,
        '", "post_type": "Reel", "themes": ["', event_type, '","b"], "tone": "t", "extra": ', props)"""
    whole = f"concat('Here it is:\\n```json\\n', {body}, '}}\\n```')"
    return table(spark, folder, "events").selectExpr(
        "user_id AS page_id", f"CASE WHEN event_type = 'error' THEN {body} ELSE {whole} END AS reply", "event_id AS reply_no"
    )


SQL["replies"] = r"""
SELECT user_id AS page_id, event_id AS reply_no,
  CASE WHEN event_type = 'error' THEN body ELSE 'Here it is:' || chr(10) || '```json' || chr(10) || body || '}' || chr(10) || '```' END AS reply
FROM (SELECT *, '{"post_summary": "' || event_type || '",' || chr(10) || ' "caption": "c' || CAST(event_id AS VARCHAR)
  || '", "post_type": "Reel", "themes": ["' || event_type || '","b"], "tone": "t", "extra": ' || props AS body FROM events)"""
