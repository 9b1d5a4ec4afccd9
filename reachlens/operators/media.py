"""Uploaded clips, their analyses, and media files of posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from reachlens.functions.dates import AsOf, as_date
from reachlens.functions.files import major_type, renamed, stem_or_empty, stem_or_name
from reachlens.operators.common import first_rows, left_join_unique, tie_order


def files_by_stem(listing: DataFrame) -> DataFrame:
    """One url per file stem; of files sharing a stem the one with the last name, then url."""
    stem = stem_or_name(F.col("name")).alias("video_id")
    return listing.groupBy(stem).agg(F.max(F.struct("name", "url"))["url"].alias("public_url"))


def listed_analyses(analysis: DataFrame, listing: DataFrame) -> DataFrame:
    """Analyses whose clip is among the listed files, every row kept."""
    stems = listing.select(stem_or_name(F.col("name")).alias("video_id"))
    return analysis.join(stems, "video_id", "left_semi")


def gallery(analysis: DataFrame, listing: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Each analysed clip with the url of its file, one row per clip: the first by ``ties``
    (see :func:`tie_order`)."""
    per_clip = first_rows(analysis.filter(F.col("video_id").isNotNull()), ["video_id"], tie_order(analysis, ties))
    return per_clip.join(files_by_stem(listing), "video_id")


def post_media(posts: DataFrame, listing: DataFrame) -> DataFrame:
    """Posts with the url of the file named after the post (first name, then url), else null.

    The listing is read once and joined, however many posts there are.
    """
    stem = stem_or_empty(F.col("name")).alias("_stem")
    first_file = listing.groupBy(stem).agg(F.min(F.struct("name", "url"))["url"].alias("video_url"))
    return left_join_unique(posts, first_file, [("post_id", "_stem")])


def accepted_uploads(uploads: DataFrame) -> DataFrame:
    """Video uploads that name their account and say why they were made."""
    is_video = F.coalesce(major_type(F.col("mime")) == "video", F.lit(False))
    return uploads.filter(is_video & (F.col("page_id") != 0) & (F.length("inspiration_context") > 0))


def clip_rows(uploads: DataFrame, as_of: AsOf, batch: str | None = None) -> DataFrame:
    """Metadata rows of accepted uploads, each with a generated id.

    Without ``batch`` the ids are random: write them once (``sinks.append_clips``) before
    naming files after them. With it they follow from the batch's name and the row, equal
    rows being counted, so the same batch gives the same ids whenever it is run.
    """
    accepted = accepted_uploads(uploads)
    if batch is None:
        numbered, made = accepted, F.expr("uuid()")
    else:
        told = [F.col(c).cast("string") for c in ("page_id", "inspiration_context", "name")]
        whole = F.concat_ws("|", F.lit(batch), *[F.concat(F.length(c), F.lit(":"), c) for c in told])
        same = Window.partitionBy("page_id", "inspiration_context", "name").orderBy(F.lit(1))
        numbered = accepted.withColumn("_no", F.row_number().over(same))
        made = F.regexp_replace(F.md5(F.concat_ws("|", whole, "_no")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return numbered.select(
        "page_id", made.alias("video_id"), "inspiration_context", as_date(as_of).alias("uploaded_date"), "name",
    )


def stored_names(clips: DataFrame) -> DataFrame:
    """The name each stored clip's file gets."""
    return clips.withColumn("stored_name", renamed(F.col("video_id"), F.col("name")))
