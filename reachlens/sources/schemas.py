"""Declared schemas of the account tables and the check applied on load."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "time": T.TimestampNTZType(),
    "list": T.ArrayType(T.StringType()),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


POSTS = _schema(
    page_id="long", post_id="string", insert_date="date", created_time="time", caption="string",
    reach="long", like_count="long", comments_count="long", saved="long", shares="long",
    media_type="string", source="string",
)
ACCOUNT_DAILY = _schema(
    page_id="long", date="date", follower_count="long", total_followers="long", reach="long",
    impressions="long",
)
POST_ANALYSIS = _schema(
    page_id="long", video_id="string", created_time="time",
    reach="long", like_count="long", comments_count="long", shares="long", saved="long",
    main_theme="string", most_common_word="string", main_focus="string", color_scheme="string",
    time_of_day="string", time_bucket="string", weekday="string",
    video_len="double", shot_count="long", avg_shot_len="double", longest_shot="double",
    object_count="long", face_count="long",
    labels_extracted="string", background_imagery="string", text_from_video="string",
    caption_length="long", hashtags="string", hashtag_count="long", call_to_action="string",
    words_per_frame="double",
    raw_speech="string", processed_speech="string", speech_length="long", speech_rate="double",
    sound_type="string", bpm="double", mood="string",
    sentiment="string", polarity="double", subjectivity="double", tone="string",
    common_word_count="long", theme_repetition="long",
)
DEMOGRAPHICS = _schema(page_id="long", breakdown="string", value="string", followers="long")
ADS = _schema(page_id="long", ad_name="string", spend="double", reach="long", clicks="long")
ACCOUNT_SUMMARY = _schema(page_id="long", date="date", summary="string")
BUSINESS_CONTEXT = _schema(page_id="long", description="string")
POST_IDEAS = _schema(
    page_id="long", date="string", post_summary="string", caption="string", post_type="string",
    themes="string", tone="string", source="string",
)
INSPIRATION = _schema(page_id="long", update_date="date", post_structure="string", post_ideas="string")
PAST_CONCEPTS = _schema(page_id="long", update_date="date", past_ideas="string")
INSIGHTS = _schema(page_id="long", update_date="date", notes="string")
CLIP_METADATA = _schema(
    page_id="long", video_id="string", inspiration_context="string", uploaded_date="date"
)
CLIP_ANALYSIS = _schema(
    video_id="string", key_themes="string", post_styles="string", notable_patterns="string",
    suggested_future_content="string",
)
MEDIA_LISTING = _schema(name="string", url="string", mime="string")
MODEL_REPLIES = _schema(page_id="long", reply="string")
TWEAKS = _schema(page_id="long", caption="string", feedback="string")
CONVERSATION = _schema(conv_id="long", turn="int", role="string", text="string")

TABLES = {
    "postdata": POSTS,
    "accountdata": ACCOUNT_DAILY,
    "post_analysis": POST_ANALYSIS,
    "demographicdata": DEMOGRAPHICS,
    "ads": ADS,
    "summarytable": ACCOUNT_SUMMARY,
    "businesscontext": BUSINESS_CONTEXT,
    "postideas": POST_IDEAS,
    "accountinspiration": INSPIRATION,
    "accountpastconcepts": PAST_CONCEPTS,
    "accountinsights": INSIGHTS,
    "inspoextractholder": CLIP_METADATA,
    "inspiration_analysis": CLIP_ANALYSIS,
    "media_listing": MEDIA_LISTING,
    "model_replies": MODEL_REPLIES,
    "tweaks": TWEAKS,
    "conversation": CONVERSATION,
}

# Conversions accepted on load: widenings of numbers, and, not lossless, a moment where a day
# is wanted (its date) and a zoned moment where a zoneless one is (its clock time in the session's
# zone). Ids never arrive through a double: page ids exceed 2^53 and would be changed silently.
_ACCEPTED = {
    "bigint": {"bigint", "int", "smallint", "tinyint"},
    "int": {"int", "smallint", "tinyint"},
    "double": {"double", "float", "int", "smallint", "tinyint"},
    "string": {"string"},
    "date": {"date", "timestamp", "timestamp_ntz"},
    "timestamp_ntz": {"timestamp_ntz", "timestamp", "date"},
    "array<string>": {"array<string>"},
}


class SchemaError(ValueError):
    """A table does not have the columns or types its operators need."""


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to ``schema``; fail on absent columns and on types that are not accepted."""
    have = dict(df.dtypes)
    absent = [f.name for f in schema if f.name not in have]
    if absent:
        raise SchemaError(f"missing columns: {', '.join(absent)}")
    lossy = [
        f"{f.name}: {have[f.name]} is not {f.dataType.simpleString()}"
        for f in schema
        if have[f.name] not in _ACCEPTED[f.dataType.simpleString()]
    ]
    if lossy:
        raise SchemaError("; ".join(lossy))
    return df.selectExpr(*[
        f.name if have[f.name] == f.dataType.simpleString()
        else f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}"
        for f in schema
    ])
