"""Posts with analysis: joins, means, rankings, projections, terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as t
from checks.sql import BUCKETS, DAYS, bucket
from reachlens.fixed_values import STOP_WORDS
from reachlens.operators import cards, engagement, terms
from reachlens.sources.shared import Memo, new_path, written

QUERIES, SQL = {}, {}


def check(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


_RATE = """CASE WHEN reach <> 0 OR like_count > 0 THEN round_even(CAST(like_count AS DOUBLE) / reach * 100.0::DOUBLE, 2) END
AS like_rate, CAST(created_time AS DATE) AS post_date"""
_ANALYSIS_COLUMNS = (
    "a.video_id, main_theme, most_common_word, main_focus, color_scheme, time_of_day, a.time_bucket, a.weekday, video_len, shot_count, "
    "avg_shot_len, longest_shot, object_count, face_count, labels_extracted, background_imagery, text_from_video, "
    "caption_length, hashtags, hashtag_count, call_to_action, words_per_frame, raw_speech, processed_speech, "
    "speech_length, speech_rate, sound_type, bpm, mood, sentiment, polarity, subjectivity, tone, common_word_count, "
    "theme_repetition"
)
_JOINED = t.with_sql("posts", "analysis") + f""", joined AS (
SELECT p.*, {_RATE}, {_ANALYSIS_COLUMNS} FROM posts p LEFT JOIN analysis a ON p.post_id = a.video_id) """


def joined(spark, d, *columns):
    posts = engagement.with_like_rate(t.posts(spark, d))
    return engagement.join_analysis(posts, t.analysis(spark, d), columns or None)


@check("posts_left_analysis", _JOINED + "SELECT * FROM joined")
def posts_left_analysis(spark, d):
    return joined(spark, d)


@check("posts_left_analysis_bucketed", SQL["posts_left_analysis"])
def posts_left_analysis_bucketed(spark, d):
    """The same join from tables stored by id: picked once, nothing moved afterwards."""
    posts, current = stored_for_join(spark, d)
    return engagement.join_stored(engagement.with_like_rate(posts), current)


def stored_for_join(spark, d, buckets=None):
    folder = new_path(spark, "by-id")
    names = [folder.rsplit("/", 1)[1].replace("-", "_") + part for part in ("_posts", "_analysis")]
    return engagement.store_for_join(t.posts(spark, d), t.analysis(spark, d), *names, folder, buckets)


@check("posts_all_analyses", t.with_sql("sold_posts") + """
SELECT p_partkey AS page_id, id AS post_id, post_id AS video_id, s.created_time, reach, like_count, polarity, video_len, call_to_action
FROM (SELECT p_partkey, CAST(p_partkey + 100 AS VARCHAR) AS id FROM part) LEFT JOIN sold_posts s ON id = post_id""")
def posts_all_analyses(spark, d):
    """Every repeated right-hand row is kept, as a plain merge would."""
    parts = t.table(spark, d, "part").select(
        F.col("p_partkey").alias("page_id"), (F.col("p_partkey") + 100).cast("string").alias("post_id")
    )
    sold = t.sold_posts(spark, d).drop("page_id").withColumnRenamed("post_id", "video_id")
    # Analysis columns named like post columns would be dropped, so they travel renamed.
    sides = sold.withColumnsRenamed({"created_time": "sold_at", "reach": "sold_reach", "like_count": "sold_likes"})
    out = engagement.join_analysis(parts, sides, repeats="all")
    return out.withColumnsRenamed({"sold_at": "created_time", "sold_reach": "reach", "sold_likes": "like_count"})


@check("posts_newest_analysis", t.with_sql("sold_posts") + """, newest AS (SELECT * FROM (SELECT *, row_number() OVER (
PARTITION BY post_id ORDER BY CAST(created_time AS DATE) DESC NULLS LAST, like_count NULLS FIRST, reach NULLS FIRST) AS rn
FROM sold_posts) WHERE rn = 1)
SELECT p_partkey AS page_id, id AS post_id, n.reach AS sold_reach, n.like_count AS sold_likes
FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id FROM part) LEFT JOIN newest n ON id = post_id""")
def posts_newest_analysis(spark, d):
    """Parts sold many times: the newest day counts, and its rows tie."""
    parts = t.table(spark, d, "part").select(
        F.col("p_partkey").alias("page_id"), F.col("p_partkey").cast("string").alias("post_id")
    )
    sold = t.sold_posts(spark, d).select(
        F.col("post_id").alias("video_id"), F.to_date("created_time").alias("created_time"),
        F.col("reach").alias("sold_reach"), F.col("like_count").alias("sold_likes"),
    )
    return engagement.join_analysis(parts, sold, ["sold_reach", "sold_likes"], ties=["sold_likes", "sold_reach"]).drop("video_id")


# --- filters and rankings ------------------------------------------------------------


@check("recent_30d", t.with_sql("posts") + "SELECT * FROM posts WHERE CAST(created_time AS DATE) >= DATE '2024-01-16'")
def recent_30d(spark, d):
    return engagement.recent(t.posts(spark, d), "2024-02-15", "30d")


@check("recent_182d", t.with_sql("sold_posts") + """
SELECT * FROM sold_posts WHERE CAST(created_time AS DATE) >= DATE '2001-12-01' - 182""")
def recent_182d(spark, d):
    return engagement.recent(t.sold_posts(spark, d), "2001-12-01", "6m")


_TOP = """SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (
PARTITION BY page_id ORDER BY {0} DESC NULLS LAST, post_id) AS rn FROM {1}) WHERE rn <= {2}"""


@check("topk_per_page", t.with_sql("posts") + _TOP.format("reach", "posts", 10))
def topk_per_page(spark, d):
    return engagement.top_posts(t.posts(spark, d), "reach")


for _metric in ("like_count", "like_rate", "comments_count"):
    def _top(spark, d, metric=_metric):
        return engagement.top_posts(engagement.with_like_rate(t.posts(spark, d)), metric)

    QUERIES[f"topk_{_metric}"] = _top
    SQL[f"topk_{_metric}"] = (
        t.with_sql("posts") + f", rated AS (SELECT *, {_RATE} FROM posts) " + _TOP.format(_metric, "rated", 10)
    )


@check("topk_overall", t.with_sql("posts") + "SELECT * FROM posts ORDER BY reach DESC NULLS LAST, post_id LIMIT 10")
def topk_overall(spark, d):
    return engagement.top_posts(t.posts(spark, d), "reach", per_page=False)


@check("latest_25", t.with_sql("posts") + _TOP.format("created_time", "posts", 25))
def latest_25(spark, d):
    return engagement.newest_posts(t.posts(spark, d))


# --- means ---------------------------------------------------------------------------


@check("time_bucket_mean", t.with_sql("posts") + f"""
SELECT page_id, position, time_bucket, mean_reach FROM (SELECT DISTINCT page_id FROM posts) p CROSS JOIN {BUCKETS} b
LEFT JOIN (SELECT page_id, {bucket('created_time')} AS time_bucket, avg(reach) AS mean_reach FROM posts GROUP BY 1, 2) m
USING (page_id, time_bucket)""")
def time_bucket_mean(spark, d):
    return engagement.timing_means(engagement.with_timing(t.posts(spark, d)), "time_bucket", "reach", ("page_id",))


@check("weekday_mean", t.with_sql("posts") + f"""
SELECT position, weekday, mean_like_count FROM {DAYS} b
LEFT JOIN (SELECT dayname(created_time) AS weekday, avg(like_count) AS mean_like_count FROM posts GROUP BY 1) m
USING (weekday)""")
def weekday_mean(spark, d):
    return engagement.timing_means(engagement.with_timing(t.posts(spark, d)), "weekday", "like_count")


@check("analysed_time_bucket_mean", t.with_sql("posts", "analysis") + f"""
SELECT position, time_bucket, mean_reach FROM {BUCKETS} b LEFT JOIN (
  SELECT {bucket('p.created_time')} AS time_bucket, avg(p.reach) AS mean_reach
  FROM posts p JOIN analysis a ON p.post_id = a.video_id WHERE call_to_action IS NOT NULL GROUP BY 1) m
USING (time_bucket)""")
def analysed_time_bucket_mean(spark, d):
    """Posts, analysis, like rate, bucket, dense mean: the whole path of the timing chart."""
    rows = engagement.with_timing(joined(spark, d, "call_to_action")).filter(F.col("call_to_action").isNotNull())
    return engagement.timing_means(rows, "time_bucket", "reach")


def _mean_sql(key: str, source: str = "sold_posts", likes: bool = True, where: str = "") -> str:
    more = ", avg(like_count) AS mean_like_count" if likes else ""
    return f"SELECT {key}, avg(reach) AS mean_reach{more} FROM {source} WHERE {key} IS NOT NULL {where} GROUP BY 1"


_SOLD = t.with_sql("sold_posts")
_SOLD_PARTS = t.with_sql("sold_posts", "part_analysis")
_SOLD_JOIN = "(SELECT s.*, a.* EXCLUDE video_id FROM sold_posts s LEFT JOIN part_analysis a ON post_id = video_id)"


@check("mean_two_metrics", _SOLD + _mean_sql("video_len"))
def mean_two_metrics(spark, d):
    return engagement.video_structure_means(t.sold_posts(spark, d), "video_len")


@check("mean_by_call_to_action", _SOLD + _mean_sql("call_to_action"))
def mean_by_call_to_action(spark, d):
    return engagement.mean_by(t.sold_posts(spark, d), "call_to_action")


@check("mean_complete_rows", _JOINED + """SELECT shot_count, avg(reach) AS mean_reach, avg(like_count) AS mean_like_count
FROM joined WHERE color_scheme IS NOT NULL AND call_to_action IS NOT NULL AND sound_type IS NOT NULL GROUP BY 1""")
def mean_complete_rows(spark, d):
    rows = joined(spark, d).drop("text_from_video")
    return engagement.video_structure_means(rows, "shot_count", complete_rows=True)


@check("mean_by_theme_desc", _SOLD_PARTS + _mean_sql("main_theme", _SOLD_JOIN, False))
def mean_by_theme_desc(spark, d):
    means = engagement.mean_by_attribute(t.sold_posts(spark, d), t.part_analysis(spark, d), "main_theme", ["reach"], ties=["shot_count"])
    return engagement.ordered_means(means, "mean_reach", ascending=False)


@check("mean_by_focus_asc", _SOLD_PARTS + _mean_sql("main_focus", _SOLD_JOIN, False))
def mean_by_focus_asc(spark, d):
    means = engagement.mean_by_attribute(t.sold_posts(spark, d), t.part_analysis(spark, d), "main_focus", ["reach"])
    return engagement.ordered_means(means, "mean_reach")


@check("mean_by_object_count", _SOLD_PARTS + _mean_sql("object_count", _SOLD_JOIN))
def mean_by_object_count(spark, d):
    return engagement.mean_by_attribute(t.sold_posts(spark, d), t.part_analysis(spark, d), "object_count")


@check("mean_by_key", _SOLD_PARTS + _mean_sql("shot_count", _SOLD_JOIN, False))
def mean_by_key(spark, d):
    rows = engagement.join_analysis(t.sold_posts(spark, d), t.part_analysis(spark, d), ["shot_count"])
    return engagement.ordered_means(engagement.mean_by(rows, "shot_count", ["reach"]), "shot_count")


@check("mean_by_polarity", _SOLD + _mean_sql("polarity", likes=False))
def mean_by_polarity(spark, d):
    return engagement.ordered_means(engagement.mean_by(t.sold_posts(spark, d), "polarity", ["reach"]), "polarity")


# --- projections ---------------------------------------------------------------------


@check("engagement_points", _JOINED + "SELECT post_id, caption_length, reach FROM joined")
def engagement_points(spark, d):
    return engagement.engagement_points(joined(spark, d, "caption_length"), "caption_length")


@check("polarity_points", _JOINED + "SELECT post_id, polarity, like_count FROM joined")
def polarity_points(spark, d):
    return engagement.engagement_points(joined(spark, d, "polarity"), "polarity", "like_count")


@check("subjectivity_points", _JOINED + "SELECT post_id, subjectivity, reach FROM joined")
def subjectivity_points(spark, d):
    return engagement.engagement_points(joined(spark, d, "subjectivity"), "subjectivity")


@check("word_points", _JOINED + "SELECT post_id, common_word_count, most_common_word, reach, theme_repetition FROM joined")
def word_points(spark, d):
    return engagement.word_points(
        joined(spark, d, "common_word_count", "most_common_word", "theme_repetition")
    )


@check("post_cards", _JOINED + """
SELECT post_id, post_date, caption, reach, like_count, like_rate, comments_count, saved, main_theme, most_common_word,
  main_focus, color_scheme, time_bucket, weekday, speech_length, speech_rate,
  CASE media_type WHEN 'IMAGE' THEN 'image' WHEN 'VIDEO' THEN 'video' END AS media_kind, source FROM joined""")
def post_cards(spark, d):
    return cards.post_cards(joined(
        spark, d, "main_theme", "most_common_word", "main_focus", "color_scheme", "time_bucket", "weekday",
        "speech_length", "speech_rate",
    ))


_DETAIL = ", ".join(
    f"{c} AS {group}_{c}" for group, names in {
        "video": "video_len shot_count avg_shot_len longest_shot object_count face_count",
        "object": "labels_extracted background_imagery main_focus text_from_video",
        "text": "caption_length hashtags hashtag_count call_to_action words_per_frame",
        "sound": "raw_speech speech_length speech_rate sound_type bpm mood",
        "tone": "sentiment polarity subjectivity tone",
    }.items() for c in names.split()
)


@check("post_detail", _JOINED + f"""
SELECT post_id, post_date, weekday, time_of_day, main_theme, caption, reach, like_count, like_rate, comments_count, saved,
{_DETAIL} FROM joined""")
def post_detail(spark, d):
    return cards.post_details(joined(spark, d))


# --- terms ---------------------------------------------------------------------------

_STOP = ", ".join("'" + w + "'" for w in STOP_WORDS)
_TERMS = f"""WITH words AS (
SELECT source AS page_id, unnest(regexp_extract_all(lower(coalesce(text, '') || ' ' || lang),
  '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_'']*')) AS term FROM documents),
counts AS (SELECT page_id, term, count(*) AS occurrences FROM words WHERE term NOT IN ({_STOP}) GROUP BY 1, 2) """


def _term_counts(spark, d):
    texts = t.table(spark, d, "documents").select(
        F.col("source").alias("page_id"), F.col("text").alias("processed_speech"), F.col("lang").alias("caption")
    )
    return terms.term_counts(texts)


@check("term_counts", _TERMS + "SELECT * FROM counts")
def term_counts(spark, d):
    return _term_counts(spark, d)


@check("term_freq", _TERMS + """SELECT page_id, term, occurrences FROM (SELECT *, row_number() OVER (
PARTITION BY page_id ORDER BY occurrences DESC, term) AS rn FROM counts) WHERE rn <= 200""")
def term_freq(spark, d):
    return terms.cloud_terms(_term_counts(spark, d))


_PHRASES = rf"""WITH posts AS (SELECT source AS page_id, row_number() OVER () AS r, coalesce(text, '') || ' ' || coalesce(lang, '') AS text FROM documents),
found AS (SELECT page_id, r, list_filter(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_'']*'),
  lambda w: CASE WHEN lower(w) LIKE '%''s' THEN left(w, length(w) - 2) ELSE w END), lambda w: NOT regexp_full_match(w, '\p{{Nd}}+')) AS words FROM posts),
placed AS (SELECT page_id, words, unnest(range(1, len(words) + 1)) AS i FROM found),
both_words AS (SELECT page_id, words[i] AS w1, words[i + 1] AS w2 FROM placed),
kept AS (SELECT page_id, '' AS head, lower(w1) AS key, w1 AS spelled FROM both_words WHERE lower(w1) NOT IN ({_STOP})
  UNION ALL SELECT page_id, lower(w1), lower(w2), w1 || ' ' || w2 FROM both_words
  WHERE w2 IS NOT NULL AND lower(w1) NOT IN ({_STOP}) AND lower(w2) NOT IN ({_STOP})),
stems AS (SELECT *, CASE WHEN regexp_matches(key, '(^|[^s])s$') THEN left(key, length(key) - 1) ELSE key END AS stem FROM kept),
groups AS (SELECT *, bool_or(key = stem) OVER (PARTITION BY page_id, head, stem) AS has FROM stems),
variants AS (SELECT page_id, head, stem, CASE WHEN has AND key <> stem THEN left(spelled, length(spelled) - 1) ELSE spelled END AS v, count(*) AS n
  FROM groups GROUP BY ALL),
fused AS (SELECT page_id, head, stem, CAST(sum(n) AS BIGINT) AS n, first(v ORDER BY n DESC, v) AS term FROM variants GROUP BY ALL),
words AS (SELECT * FROM fused WHERE head = ''),
totals AS (SELECT page_id, sum(n) AS total FROM words GROUP BY 1),
pairs AS (SELECT p.page_id, p.term, p.stem, p.n, CASE WHEN regexp_matches(p.head, '(^|[^s])s$') THEN left(p.head, length(p.head) - 1) ELSE p.head END AS lead
  FROM fused p WHERE head <> ''),
counted AS (SELECT p.*, CAST(p.n AS DOUBLE) AS c12, CAST(a.n AS DOUBLE) AS c1, CAST(b.n AS DOUBLE) AS c2, CAST(total AS DOUBLE) AS t FROM pairs p
  JOIN words a ON a.page_id = p.page_id AND a.stem = p.lead JOIN words b ON b.page_id = p.page_id AND b.stem = p.stem
  JOIN totals s ON s.page_id = p.page_id),
likely AS (SELECT *, CASE WHEN t <= c1 OR t <= c2 THEN 0 ELSE 2 * (
    ln(greatest(c12 / c1, 1e-10)) * c12 + ln(greatest(1 - c12 / c1, 1e-10)) * (c1 - c12)
    + ln(greatest((c2 - c12) / (t - c1), 1e-10)) * (c2 - c12) + ln(greatest(1 - (c2 - c12) / (t - c1), 1e-10)) * (t - c1 - c2 + c12)
    - ln(greatest(c2 / t, 1e-10)) * c2 - ln(greatest(1 - c2 / t, 1e-10)) * (t - c2)) END AS score FROM counted),
phrases AS (SELECT * FROM likely WHERE score > 30),
inside AS (SELECT page_id, stem, CAST(sum(n) AS BIGINT) AS inside FROM (SELECT page_id, lead AS stem, n FROM phrases
  UNION ALL SELECT page_id, stem, n FROM phrases) GROUP BY 1, 2)
SELECT page_id, term, n - coalesce(inside, 0) AS occurrences FROM words LEFT JOIN inside USING (page_id, stem) WHERE n > coalesce(inside, 0)
UNION ALL SELECT page_id, term, n FROM phrases"""


@check("term_phrases", _PHRASES)
def term_phrases(spark, d):
    texts = t.table(spark, d, "documents").select(
        F.col("source").alias("page_id"), F.col("text").alias("processed_speech"), F.col("lang").alias("caption"))
    return terms.phrase_counts(texts)


# --- the shared stored frame -----------------------------------------------------------


@check("persist_roundtrip", _JOINED + "SELECT * FROM joined")
def persist_roundtrip(spark, d):
    return written(joined(spark, d), "joined-posts")


@check("memo_roundtrip", _JOINED + "SELECT * FROM joined")
def memo_roundtrip(spark, d):
    """Kept by key: the second call finds what the first one has stored."""
    posts, current = stored_for_join(spark, d)
    memo = Memo(spark)
    for _ in range(2):
        kept = memo.frame(engagement.join_stored(engagement.with_like_rate(posts), current), "joined posts")
    return kept
