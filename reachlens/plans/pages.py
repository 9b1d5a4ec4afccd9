"""Each function returns the named frames one page shows, for every account at once.

What several frames of a page share (period figures, posts joined with their analyses) is
written once when the page is asked for; the rest runs when a frame is used. ``tables`` maps
the names of ``sources.schemas.TABLES`` to frames.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from reachlens.functions.dates import AsOf
from reachlens.operators import audience, cards, engagement, ideas, kpi, media, series, terms
from reachlens.sources.shared import written
from reachlens.sources.tables import snapshot

Tables = Mapping[str, DataFrame]
Frames = dict[str, DataFrame]


def account_overview(tables: Tables, as_of: AsOf, metric: str = "total_followers") -> Frames:
    """Cards, summary text, series, markers, calendar, demographics, ads. With a table
    ``accounts`` each of its accounts has figures, idle ones zeros."""
    posts = snapshot(tables["postdata"], as_of)
    account, accounts = tables["accountdata"], tables.get("accounts")
    kpis = written(kpi.with_differences(kpi.period_kpis(posts, account, as_of, accounts=accounts)), "period-kpis")
    alltime = kpi.alltime_kpis(posts, account, accounts)
    filled = series.fill_gaps(account, metric)
    frames = {
        "daily": series.daily_counts(posts, account, as_of),
        "period_kpis": kpis,
        "changes": kpi.change_rows(kpis),
        "summary": kpi.static_summary(kpis),
        "period_cards": kpi.period_scorecards(kpis),
        "alltime_kpis": alltime,
        "alltime_cards": kpi.alltime_scorecards(alltime),
        "series": filled,
        "series_extent": series.series_extent(filled, metric),
        "post_markers": series.post_markers(posts, account),
        "calendar": cards.calendar_events(posts),
        "demographics": audience.demographic_share(tables["demographicdata"]),
        "breakdowns": audience.breakdown_list(tables["demographicdata"]),
    }
    if "ads" in tables:
        frames["ads"] = audience.ad_totals(tables["ads"], accounts=accounts)
    if "summarytable" in tables:
        frames["insight_bullets"] = ideas.latest_summary(tables["summarytable"])
    if "postideas" in tables:
        frames["ideas"] = ideas.shown_ideas(tables["postideas"])
    if "businesscontext" in tables:
        frames["prompts"] = ideas.performance_prompts(frames["summary"], tables["businesscontext"])
    return frames


def analysed_posts(tables: Tables, as_of: AsOf) -> DataFrame:
    """Yesterday's posts with like rate and analysis."""
    posts = engagement.with_like_rate(snapshot(tables["postdata"], as_of))
    return engagement.join_analysis(posts, tables["post_analysis"])


def posts_overview(tables: Tables, as_of: AsOf) -> Frames:
    """Default view, time filters, rankings, cards, and media of the posts.

    All frames read one stored copy of the joined posts, so the join runs once.
    """
    joined = written(analysed_posts(tables, as_of), "posts-overview")
    frames = {
        "newest": engagement.newest_posts(joined),
        "last_30_days": engagement.recent(joined, as_of, "30d"),
        "last_6_months": engagement.recent(joined, as_of, "6m"),
        "cards": cards.post_cards(joined),
        "details": cards.post_details(joined),
    }
    for metric in ("reach", "like_count", "like_rate", "comments_count"):
        frames[f"top_{metric}"] = engagement.top_posts(joined, metric)
    if "media_listing" in tables:
        frames["media"] = media.post_media(frames["newest"], tables["media_listing"])
    return frames


def post_deep_dive(
    tables: Tables, as_of: AsOf, metric: str = "reach", dimension: str = "weekday",
    video_metric: str = "avg_shot_len", frame: str | None = None,
) -> Frames:
    """Timing, structure, caption, wording and tone of posts.

    All frames read one stored copy of the joined posts, so the join runs once.
    """
    joined = engagement.with_timing(analysed_posts(tables, as_of))
    rows = written(joined, "deep-dive")
    if frame is not None:
        rows = engagement.recent(rows, as_of, frame)
    by = ("page_id",)
    return {
        "rows": rows,
        "timing": engagement.timing_means(rows, dimension, metric, by),
        "structure": engagement.video_structure_means(rows, video_metric, by),
        "caption_length": engagement.engagement_points(rows, "caption_length", metric),
        "calls_to_action": engagement.mean_by(rows, "call_to_action", by=by),
        "words": engagement.word_points(rows),
        "terms": terms.cloud_terms(terms.term_counts(rows)),
        "polarity": engagement.engagement_points(rows, "polarity", metric),
        "subjectivity": engagement.engagement_points(rows, "subjectivity", metric),
    }


def report(tables: Tables, as_of: AsOf) -> Frames:
    """The report page: growth, themes, timing, visuals, audience."""
    joined = engagement.with_timing(analysed_posts(tables, as_of))
    rows = written(joined, "report")
    by, reach = ("page_id",), ("reach",)

    def means(key: str, order: str, ascending: bool = True) -> DataFrame:
        return engagement.ordered_means(engagement.mean_by(rows, key, reach, by), order, ascending)

    return {
        "growth": series.fill_gaps(tables["accountdata"], "total_followers"),
        "themes": means("main_theme", "mean_reach", ascending=False),
        "terms": terms.cloud_terms(terms.term_counts(rows)),
        "timing": engagement.timing_means(rows, "time_bucket", "reach", by),
        "focus": means("main_focus", "mean_reach"),
        "video_length": engagement.mean_by(rows, "video_len", by=by),
        "objects": engagement.mean_by(rows, "object_count", by=by),
        "demographics": audience.demographic_share(tables["demographicdata"]),
        "words": engagement.word_points(rows),
        "shots": means("shot_count", "shot_count"),
        "polarity": means("polarity", "polarity"),
    }


def scheduler(tables: Tables, pages: DataFrame, as_of: AsOf, user_context: str | None = None) -> Frames:
    """Schedule, next slots and idea prompts. ``pages`` has page_id, a strategy text
    and, if named, a column with the user's own context."""
    planned = tables["postideas"]
    context = ideas.account_context(
        pages, planned, tables["accountinspiration"], tables["accountpastconcepts"], tables["accountinsights"]
    )
    slots = ideas.next_slots(planned, as_of, pages)
    frames = {
        "schedule": ideas.idea_schedule(planned),
        "labels": cards.idea_labels(planned),
        "slots": slots,
        "context": context,
        "idea_prompts": ideas.idea_prompts(context, user_context=user_context),
    }
    if "tweaks" in tables:
        frames["tweak_prompts"] = ideas.tweak_prompts(planned, tables["tweaks"])
    if "model_replies" in tables:
        frames["new_ideas"] = ideas.reply_ideas(tables["model_replies"], slots, as_of)
    return frames


def inspiration_gallery(tables: Tables) -> Frames:
    """Uploaded clips with their analyses."""
    return {"gallery": media.gallery(tables["inspiration_analysis"], tables["media_listing"])}
