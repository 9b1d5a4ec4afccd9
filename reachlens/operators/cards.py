"""Flat projections shown for single posts, calendar entries and ideas."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reachlens.fixed_values import (
    CAPTION_LABEL_CHARS, EVENT_TITLE_CHARS, PAST_EVENT_COLOR, PAST_EVENT_PREFIX,
)
from reachlens.functions.dates import iso_date
from reachlens.operators.engagement import media_kind

_DETAIL_GROUPS = {
    "video": ("video_len", "shot_count", "avg_shot_len", "longest_shot", "object_count", "face_count"),
    "object": ("labels_extracted", "background_imagery", "main_focus", "text_from_video"),
    "text": ("caption_length", "hashtags", "hashtag_count", "call_to_action", "words_per_frame"),
    "sound": ("raw_speech", "speech_length", "speech_rate", "sound_type", "bpm", "mood"),
    "tone": ("sentiment", "polarity", "subjectivity", "tone"),
}
_METRICS = ("reach", "like_count", "like_rate", "comments_count", "saved")


def post_cards(joined: DataFrame) -> DataFrame:
    """Short card: day, caption, metrics, attributes, structure, and how media is shown."""
    return joined.select(
        "post_id", "post_date", "caption", *_METRICS,
        "main_theme", "most_common_word", "main_focus", "color_scheme",
        "time_bucket", "weekday", "speech_length", "speech_rate",
        media_kind(F.col("media_type")).alias("media_kind"), "source",
    )


def post_details(joined: DataFrame) -> DataFrame:
    """Full detail: metrics and every analysis group, names prefixed by the group."""
    groups = [F.col(c).alias(f"{g}_{c}") for g, names in _DETAIL_GROUPS.items() for c in names]
    return joined.select(
        "post_id", "post_date", "weekday", "time_of_day", "main_theme", "caption", *_METRICS, *groups
    )


def calendar_events(posts: DataFrame) -> DataFrame:
    """Past posts as calendar entries."""
    title = F.substring(F.coalesce("caption", F.lit("")), 1, EVENT_TITLE_CHARS)
    day = iso_date(F.col("created_time"))
    return posts.select(
        "page_id", "post_id", F.concat(F.lit(PAST_EVENT_PREFIX), title).alias("title"),
        day.alias("start"), day.alias("end"), F.lit(PAST_EVENT_COLOR).alias("color"),
    )


def idea_labels(ideas: DataFrame) -> DataFrame:
    """Heading of each idea in the schedule: day, type and the start of its caption."""
    start = F.substring("caption", 1, CAPTION_LABEL_CHARS)
    label = F.concat("date", F.lit(", "), "post_type", F.lit(": "), start, F.lit("..."))
    return ideas.select("page_id", "date", "caption", label.alias("label"))
