"""Idea schedule, context texts, prompts, replies, media, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as t
from checks.overview_queries import SUMMARY_CTE, kpis
from checks.sql import template
from reachlens import fixed_values as fv
from reachlens.functions import files
from reachlens.functions.text import bullets, piece_at, title_label
from reachlens.operators.common import first_rows
from reachlens.operators import cards, conversation, ideas, kpi, media
from reachlens.sources import sinks
from reachlens.sources.listing import list_media, put_media
from reachlens.sources.schemas import POST_IDEAS
from reachlens.sources.shared import new_path, written

QUERIES, SQL = {}, {}


def check(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


_IDEAS = t.with_sql("ideas")
_NOTES = t.with_sql("notes")
_COLUMNS = "page_id, date, post_summary, caption, post_type, themes, tone, source"

# --- lookups ---------------------------------------------------------------------------


@check("idea_schedule", _IDEAS + f"SELECT {_COLUMNS} FROM ideas")
def idea_schedule(spark, d):
    return ideas.idea_schedule(t.ideas(spark, d))


@check("idea_labels", _IDEAS + """SELECT page_id, date, caption,
date || ', ' || post_type || ': ' || substr(caption, 1, 50) || '...' AS label FROM ideas""")
def idea_labels(spark, d):
    return cards.idea_labels(t.ideas(spark, d))


# Several notes of an account may have one date; the least doc_id settles it.


def _pick_sql(order: str) -> str:
    return f"""SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (
PARTITION BY page_id ORDER BY update_date {order}, doc_id) AS rn FROM notes) WHERE rn = 1"""


@check("latest_row", _NOTES + _pick_sql("DESC"))
def latest_row(spark, d):
    return ideas.one_row_per_page(t.notes(spark, d), "update_date", "latest", ["doc_id"])


@check("oldest_row", _NOTES + _pick_sql("ASC"))
def oldest_row(spark, d):
    return ideas.one_row_per_page(t.notes(spark, d), "update_date", "oldest", ["doc_id"])


_PIECES = r"""list_filter(list_transform(string_split({0}, '{1}'),
lambda x: regexp_replace(regexp_replace(x, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')), lambda x: x <> '')"""


@check("latest_summary", _NOTES + f"""SELECT page_id, update_date AS date, coalesce(b[1], '') AS bullet_1,
coalesce(b[2], '') AS bullet_2 FROM (SELECT *, {_PIECES.format("'•' || replace(text, chr(10), '•')", '•')} AS b
FROM ({_pick_sql('DESC')}))""")
def latest_summary(spark, d):
    rows = t.notes(spark, d).select(
        "page_id", "doc_id", F.col("update_date").alias("date"),
        F.concat(F.lit("•"), F.replace("text", F.lit("\n"), F.lit("•"))).alias("summary"),
    )
    return ideas.latest_summary(rows, ["doc_id"])


@check("bullets", f"""SELECT doc_id, coalesce(b[1], '') AS first, coalesce(b[2], '') AS second, CAST(len(b) AS INTEGER) AS pieces
FROM (SELECT doc_id, {_PIECES.format('text', '@')} AS b FROM (
SELECT doc_id, replace(text, chr(10), '@') AS text FROM documents))""")
def bullet_pieces(spark, d):
    text = F.replace("text", F.lit("\n"), F.lit("@"))
    rows = t.table(spark, d, "documents").select("doc_id", bullets(text, "@").alias("b"))
    return rows.select(
        "doc_id", piece_at(F.col("b"), 0).alias("first"), piece_at(F.col("b"), 1).alias("second"), F.size("b").alias("pieces")
    )


_RANKED = "SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY date, caption) AS rn FROM ideas"


@check("oldest_5_list", _IDEAS + f"""SELECT page_id, string_agg(CAST(rn AS VARCHAR) || '. ' || post_summary, chr(10) ORDER BY rn)
AS past_ideas FROM ({_RANKED}) WHERE rn <= 5 GROUP BY 1""")
def oldest_5_list(spark, d):
    return ideas.numbered_ideas(t.ideas(spark, d))


@check("oldest_5_theme_list", _IDEAS + f"""SELECT page_id,
string_agg(CAST(rn AS VARCHAR) || '. ' || themes || ' (' || post_type || ')', chr(10) ORDER BY rn) AS past_ideas
FROM ({_RANKED}) WHERE rn <= 5 GROUP BY 1""")
def oldest_5_theme_list(spark, d):
    return ideas.numbered_ideas(t.ideas(spark, d), ideas.theme_line())


@check("shown_ideas", _IDEAS + f"SELECT {_COLUMNS} FROM ({_RANKED}) WHERE rn <= 3")
def shown_ideas(spark, d):
    return ideas.shown_ideas(t.ideas(spark, d))


@check("descriptions", _NOTES + "SELECT page_id, min(lang || ' ' || text) AS description FROM notes GROUP BY 1")
def descriptions(spark, d):
    return ideas.descriptions(_business(spark, d))


def _business(spark, d):
    return t.notes(spark, d).select("page_id", F.concat("lang", F.lit(" "), "text").alias("description"))


@check("next_slot", _IDEAS + """SELECT page_id, coalesce(max(CAST(date AS DATE)), DATE '2024-01-31') + 3 AS next_date
FROM (SELECT l_partkey AS page_id FROM lineitem UNION SELECT page_id FROM ideas) LEFT JOIN ideas USING (page_id) GROUP BY 1""")
def next_slot(spark, d):
    pages = t.table(spark, d, "lineitem").select(F.col("l_partkey").alias("page_id"))
    return ideas.next_slots(t.ideas(spark, d), t.AS_OF, pages)


@check("next_slot_overall", _IDEAS + "SELECT max(CAST(date AS DATE)) + 3 AS next_date FROM ideas")
def next_slot_overall(spark, d):
    return ideas.next_slot_overall(t.ideas(spark, d), t.AS_OF)


# --- context and prompts --------------------------------------------------------------

_CONTEXT = t.with_sql("ideas", "notes") + f""", pages AS (SELECT c_custkey AS page_id, c_name AS strategy,
  CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS user_context FROM customer),
lists AS (SELECT page_id, string_agg(CAST(rn AS VARCHAR) || '. ' || post_summary, chr(10) ORDER BY rn) AS past_ideas
  FROM ({_RANKED}) WHERE rn <= 5 GROUP BY 1),
oldest AS ({_pick_sql('ASC')}),
context AS (SELECT page_id, strategy, user_context, coalesce(past_ideas, 'No past posts found.') AS past_ideas,
  coalesce('Post structure: ' || lang || '. Post ideas: ' || text || '.', 'No inspiration data found.') AS inspiration,
  coalesce(lang, 'No past post ideas found.') AS past_concepts, coalesce(text, 'No account insights found.') AS insights
  FROM pages LEFT JOIN lists USING (page_id) LEFT JOIN oldest USING (page_id)) """


def _context(spark, d):
    pages = t.table(spark, d, "customer").select(
        F.col("c_custkey").alias("page_id"), F.col("c_name").alias("strategy"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise("").alias("user_context"),
    )
    dated = t.notes(spark, d)
    inspiration = dated.select("page_id", "doc_id", "update_date", F.col("lang").alias("post_structure"), F.col("text").alias("post_ideas"))
    concepts = dated.select("page_id", "doc_id", "update_date", F.col("lang").alias("past_ideas"))
    insights = dated.select("page_id", "doc_id", "update_date", F.col("text").alias("notes"))
    return ideas.account_context(pages, t.ideas(spark, d), inspiration, concepts, insights, ties=["doc_id"])


@check("account_context", _CONTEXT + "SELECT * FROM context")
def account_context(spark, d):
    return _context(spark, d)


_PROMPT = template(
    fv.IDEA_PROMPT_CONTEXT, strategy="strategy", past_concepts="past_concepts", inspiration="inspiration",
    past_ideas="past_ideas", insights="insights",
)
_USER = template(fv.IDEA_PROMPT_USER, user_context="user_context")


@check("idea_prompt", _CONTEXT + f"""SELECT page_id, {_PROMPT} || CASE WHEN length(user_context) > 0 THEN {_USER} ELSE '' END
|| {template(fv.IDEA_PROMPT_REQUEST)} AS prompt FROM context""")
def idea_prompt(spark, d):
    return ideas.idea_prompts(_context(spark, d), user_context="user_context")


def _feedback(spark, d):
    """Tweak requests: orders of the account itself; finished orders leave it blank."""
    return t.ideas(spark, d).select(
        "page_id", "caption", F.when(F.col("post_type") == "Reel", "  ").otherwise(F.col("tone")).alias("feedback")
    )


@check("tweak_prompt", _IDEAS + f"""SELECT page_id, caption, {template(
    fv.TWEAK_PROMPT, post_summary='post_summary', caption='caption', post_type='post_type', themes='themes', tone='tone',
    feedback='tone')} AS prompt FROM ideas WHERE post_type <> 'Reel'""")
def tweak_prompt(spark, d):
    return ideas.tweak_prompts(t.ideas(spark, d), _feedback(spark, d))


@check("perf_prompt", SUMMARY_CTE + f""", notes AS ({t.SQL['notes']}),
business AS (SELECT page_id, min(lang || ' ' || text) AS description FROM notes GROUP BY 1)
SELECT page_id, {template(fv.PERFORMANCE_PROMPT, description="coalesce(description, 'None')", summary='summary')} AS prompt
FROM summaries LEFT JOIN business USING (page_id)""")
def perf_prompt(spark, d):
    return ideas.performance_prompts(kpi.static_summary(kpis(spark, d)), _business(spark, d))


# --- replies ----------------------------------------------------------------------------

_PARSED = t.with_sql("replies") + r""", objects AS (
SELECT *, regexp_extract(reply, '(?s)\{.*\}') AS object FROM replies),
parsed AS (SELECT page_id, reply_no, object->>'post_summary' AS post_summary, object->>'caption' AS caption,
  object->>'post_type' AS post_type, object->>'themes' AS themes, object->>'tone' AS tone
  FROM (SELECT *, CASE WHEN json_valid(object) THEN object ELSE '{}' END AS checked FROM objects) WHERE json_valid(object)) """


@check("json_reply_parse", _PARSED.replace("object->>", "checked->>") + "SELECT * FROM parsed")
def json_reply_parse(spark, d):
    return ideas.parsed_replies(t.replies(spark, d))


@check("reply_rejects", _PARSED + """SELECT page_id, reply_no, reply,
CASE WHEN object = '' THEN 'no object' ELSE 'invalid JSON' END AS reason FROM objects WHERE object = '' OR NOT json_valid(object)""")
def reply_rejects(spark, d):
    return ideas.rejected_replies(t.replies(spark, d))


@check("reply_ideas", _PARSED.replace("object->>", "checked->>") + f""", ideas AS ({t.SQL['ideas']}),
slots AS (SELECT page_id, max(CAST(date AS DATE)) + 3 AS next_date FROM ideas GROUP BY 1)
SELECT page_id, strftime(coalesce(next_date, DATE '2024-01-31' + 3), '%Y-%m-%d') AS date, post_summary, caption, post_type,
replace(themes, '","', '", "') AS themes, tone, 'ChatGPT' AS source
FROM parsed LEFT JOIN slots USING (page_id)""")
def reply_ideas(spark, d):
    slots = ideas.next_slots(t.ideas(spark, d), t.AS_OF)
    return ideas.reply_ideas(t.replies(spark, d), slots, t.AS_OF)


@check("manual_ideas", _IDEAS + """SELECT page_id, date, post_summary, caption, post_type,
'["' || replace(themes, ',', '", "') || '"]' AS themes, tone, 'User' AS source FROM ideas""")
def manual_ideas(spark, d):
    return ideas.manual_ideas(t.ideas(spark, d))


# --- deletes and updates -------------------------------------------------------------------

_DELETED = "SELECT l_suppkey AS page_id, caption FROM lineitem JOIN captions ON l_orderkey = o_orderkey"
_CAPTIONS = f""", captions AS (SELECT o_orderkey,
  o_orderpriority || ' offer for all who order before the end of the week, no. ' || CAST(o_orderkey AS VARCHAR) AS caption
  FROM orders) """


def _deleted(spark, d):
    """Deletions asked for: captions of orders, on the account of each line's supplier."""
    captions = t.table(spark, d, "orders").selectExpr("o_orderkey AS l_orderkey", f"{t.CAPTION} AS caption")
    return t.table(spark, d, "lineitem").join(captions, "l_orderkey").selectExpr("l_suppkey AS page_id", "caption")


@check("ideas_delete", _IDEAS + _CAPTIONS + f"""SELECT {_COLUMNS} FROM ideas i WHERE NOT EXISTS (
SELECT 1 FROM ({_DELETED}) d WHERE d.page_id = i.page_id AND d.caption = i.caption)""")
def ideas_delete(spark, d):
    return ideas.without_captions(t.ideas(spark, d), _deleted(spark, d))


@check("ideas_delete_all_accounts", _IDEAS + _CAPTIONS + f"""SELECT {_COLUMNS} FROM ideas i WHERE NOT EXISTS (
SELECT 1 FROM ({_DELETED}) d WHERE d.caption = i.caption)""")
def ideas_delete_all_accounts(spark, d):
    return ideas.without_captions(t.ideas(spark, d), _deleted(spark, d), scope="all")


@check("ideas_delete_one", """WITH ideas AS (SELECT o_custkey AS page_id, o_orderpriority AS caption, o_orderkey FROM orders)
SELECT * FROM ideas WHERE caption IS NULL OR caption <> '1-URGENT'""")
def ideas_delete_one(spark, d):
    rows = t.table(spark, d, "orders").select(
        F.col("o_custkey").alias("page_id"), F.col("o_orderpriority").alias("caption"), "o_orderkey"
    )
    return ideas.without_caption(rows, "1-URGENT")


@check("ideas_update", _IDEAS + _CAPTIONS + f""", updates AS (SELECT DISTINCT page_id, caption AS previous FROM ({_DELETED}))
SELECT i.page_id, CASE WHEN u.page_id IS NULL THEN date ELSE '2024-01-31' END AS date,
  CASE WHEN u.page_id IS NULL THEN post_summary ELSE 'New' END AS post_summary,
  CASE WHEN u.page_id IS NULL THEN caption ELSE 'Again: ' || caption END AS caption,
  CASE WHEN u.page_id IS NULL THEN post_type ELSE 'Reel' END AS post_type,
  CASE WHEN u.page_id IS NULL THEN themes ELSE 'x,y' END AS themes,
  CASE WHEN u.page_id IS NULL THEN tone ELSE 'calm' END AS tone, source
FROM ideas i LEFT JOIN updates u ON i.page_id = u.page_id AND i.caption = u.previous""")
def ideas_update(spark, d):
    return ideas.with_updates(t.ideas(spark, d), _updates(spark, d), t.AS_OF)


def _updates(spark, d):
    return _deleted(spark, d).select(
        "page_id", F.col("caption").alias("previous_caption"), F.lit("New").alias("post_summary"),
        F.concat(F.lit("Again: "), "caption").alias("caption"), F.lit("Reel").alias("post_type"),
        F.split(F.lit("x,y"), ",").alias("themes"), F.lit("calm").alias("tone"),
    )


def _stored_ideas(spark, d):
    """The ideas as the newest version of a stored table, and its folder."""
    root = new_path(spark, "postideas-versions")
    sinks.write_version(t.ideas(spark, d), root)
    return root, sinks.read_version(spark, root)


@check("ideas_delete_stored", SQL["ideas_delete"])
def ideas_delete_stored(spark, d):
    root, stored = _stored_ideas(spark, d)
    sinks.write_version(ideas.without_captions(stored, _deleted(spark, d)), root)
    return sinks.read_version(spark, root)


@check("ideas_update_stored", SQL["ideas_update"])
def ideas_update_stored(spark, d):
    root, stored = _stored_ideas(spark, d)
    sinks.write_version(ideas.with_updates(stored, _updates(spark, d), t.AS_OF), root)
    return sinks.read_version(spark, root)


def _bucketed_ideas(spark, d):
    root = new_path(spark, "postideas-buckets")
    sinks.write_bucketed(t.ideas(spark, d), root)
    return root


@check("ideas_delete_bucketed", SQL["ideas_delete"])
def ideas_delete_bucketed(spark, d):
    root, deleted = _bucketed_ideas(spark, d), _deleted(spark, d)
    sinks.rewrite_touched(spark, root, deleted, ["page_id", "caption"], lambda rows: ideas.without_captions(rows, deleted))
    return sinks.read_bucketed(spark, root)


@check("ideas_update_bucketed", SQL["ideas_update"])
def ideas_update_bucketed(spark, d):
    root, updates = _bucketed_ideas(spark, d), _updates(spark, d)
    keys = updates.select("page_id", F.col("previous_caption").alias("caption"))
    sinks.rewrite_touched(spark, root, keys, ["page_id", "caption"], lambda rows: ideas.with_updates(rows, updates, t.AS_OF))
    return sinks.read_bucketed(spark, root)


@check("ideas_append_repeated", _IDEAS + f"SELECT {_COLUMNS} FROM ideas UNION ALL SELECT {_COLUMNS} FROM ideas")
def ideas_append_repeated(spark, d):
    """Two batches of all ideas, the second run twice."""
    path = new_path(spark, "postideas-batches")
    for batch in ("monday", "tuesday", "tuesday"):
        sinks.append_batch(t.ideas(spark, d), path, batch)
    return sinks.read_batches(spark, path).select(*_COLUMNS.split(", "))


@check("ideas_append", _IDEAS + f"SELECT {_COLUMNS} FROM ideas UNION ALL SELECT {_COLUMNS} FROM ideas")
def ideas_append(spark, d):
    path = new_path(spark, "postideas")
    for _ in range(2):
        sinks.append_ideas(t.ideas(spark, d), path)
    return spark.read.schema(POST_IDEAS).parquet(path)


# --- media --------------------------------------------------------------------------------

_LISTING = t.with_sql("listing")


@check("media_semi", t.with_sql("listing", "notes") + r"""SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS video_id, lang, text
FROM notes) WHERE video_id IN (SELECT regexp_replace(name, '\.[^.]*$', '') FROM listing)""")
def media_semi(spark, d):
    clips = t.notes(spark, d).select(F.col("doc_id").cast("string").alias("video_id"), "lang", "text")
    return media.listed_analyses(clips, t.listing(spark, d))


@check("media_gallery", t.with_sql("listing", "notes") + r"""SELECT video_id, lang, text, public_url FROM (
SELECT CAST(doc_id AS VARCHAR) AS video_id, lang, text FROM notes) JOIN (
SELECT regexp_replace(name, '\.[^.]*$', '') AS video_id, first(url ORDER BY name DESC, url DESC) AS public_url FROM listing GROUP BY 1)
USING (video_id)""")
def media_gallery(spark, d):
    clips = t.notes(spark, d).select(F.col("doc_id").cast("string").alias("video_id"), "lang", "text")
    return media.gallery(clips, t.listing(spark, d))


@check("media_link", t.with_sql("posts", "listing") + r"""SELECT post_id, video_url FROM posts LEFT JOIN (
SELECT CASE WHEN contains(name, '.') THEN regexp_replace(name, '\.[^.]*$', '') ELSE '' END AS stem,
  first(url ORDER BY name, url) AS video_url FROM listing GROUP BY 1) ON post_id = stem""")
def media_link(spark, d):
    posts = t.posts(spark, d).select("post_id")
    return media.post_media(posts, t.listing(spark, d))


@check("file_names", _LISTING + r"""SELECT file_no, regexp_replace(name, '\.[^.]*$', '') AS stem,
split_part(name, '.', -1) AS ext, 'id-' || CAST(file_no AS VARCHAR) || '.' || split_part(name, '.', -1) AS stored,
'https://storage.googleapis.com/clips/' || name AS public, split_part(mime, '/', 1) AS major,
CASE WHEN mime = 'video/mp4' THEN 'Video File' ELSE 'Image File' END AS label FROM listing""")
def file_names(spark, d):
    name = F.col("name")
    kind = F.concat(files.major_type(F.col("mime")), F.lit("_file"))
    return t.listing(spark, d).select(
        "file_no", files.stem_or_name(name).alias("stem"), files.extension(name).alias("ext"),
        files.renamed(F.concat(F.lit("id-"), F.col("file_no").cast("string")), name).alias("stored"),
        files.public_url("clips", name).alias("public"), files.major_type(F.col("mime")).alias("major"),
        title_label(kind).alias("label"),
    )


@check("clip_append", _LISTING + """SELECT file_no, page_id, context AS inspiration_context, DATE '2024-01-31' AS uploaded_date,
CAST(36 AS INTEGER) AS id_length, split_part(name, '.', -1) AS ext FROM (
SELECT file_no, CAST(length(url) AS BIGINT) AS page_id, CASE WHEN contains(url, '//m.') THEN '' ELSE url || ' ' || CAST(file_no AS VARCHAR) END AS context,
name, mime FROM listing) WHERE mime LIKE 'video/%' AND context <> ''""")
def clip_append(spark, d):
    """Uploads without a reason (mobile links) and images are refused, the rest stored."""
    stored = sinks.append_clips(media.clip_rows(_uploads(spark, d), t.AS_OF), new_path(spark, "clips-table"))
    return _shown_clips(stored)


def _uploads(spark, d):
    return t.listing(spark, d).selectExpr(
        "CAST(length(url) AS BIGINT) AS page_id", "name", "mime",
        "CASE WHEN contains(url, '//m.') THEN '' ELSE concat(url, ' ', file_no) END AS inspiration_context",
    )


def _shown_clips(stored):
    return media.stored_names(stored).select(
        F.substring_index("inspiration_context", " ", -1).cast("bigint").alias("file_no"), "page_id",
        "inspiration_context", "uploaded_date", F.length("video_id").alias("id_length"),
        files.extension(F.col("stored_name")).alias("ext"),
    )


@check("clip_append_repeated", SQL["clip_append"])
def clip_append_repeated(spark, d):
    """The same uploads as one batch, run twice."""
    path = new_path(spark, "clips-batches")
    for _ in range(2):
        sinks.append_batch(media.clip_rows(_uploads(spark, d), t.AS_OF, batch="uploads"), path, "uploads")
    return _shown_clips(sinks.read_batches(spark, path))


@check("media_listing", """SELECT r_name || '/' || n_name || '/' || CAST(s_suppkey AS VARCHAR) || '.mp4' AS name,
'https://storage.googleapis.com/clips/' || replace(r_name, ' ', '%20') || '/' || replace(n_name, ' ', '%20') || '/' || CAST(s_suppkey AS VARCHAR) || '.mp4' AS url,
CAST(strlen(s_name) AS BIGINT) AS length
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def media_listing(spark, d):
    """One object per supplier, put by tasks into folders named after regions and nations, and listed."""
    folder = new_path(spark, "media")
    supplier, nation, region = (t.table(spark, d, n) for n in ("supplier", "nation", "region"))
    placed = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    objects = placed.select(F.concat("r_name", F.lit("/"), "n_name", F.lit("/"), "s_suppkey", F.lit(".mp4")).alias("name"), F.col("s_name").alias("content"))
    written(put_media(objects, folder), "media-put")
    return list_media(spark, folder, "clips", quoted=True).filter("name LIKE '%.mp4'")


# --- conversation ------------------------------------------------------------------------


@check("visible_turns", "SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'")
def visible_turns(spark, d):
    return conversation.visible_turns(t.table(spark, d, "conversations"))
