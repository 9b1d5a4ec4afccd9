"""The idea schedule: lookups, prompts, replies, deletes and updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from reachlens import fixed_values as fv
from reachlens.functions.dates import AsOf, as_date, iso_date
from reachlens.functions.replies import REFUSED, read_replies
from reachlens.functions.text import (
    bullets, comma_list, fill, is_filled, join_list, list_to_json, piece_at, split_list,
)
from reachlens.operators.common import first_rows, left_join_unique, row_digest, tie_order

# --- lookups -------------------------------------------------------------------------


def idea_schedule(ideas: DataFrame) -> DataFrame:
    """All ideas of every account, earliest first."""
    return ideas.select(
        "page_id", "date", "post_summary", "caption", "post_type", "themes", "tone", "source"
    ).orderBy("page_id", "date", "caption")


def one_row_per_page(
    df: DataFrame, dated_by: str, pick: str = "oldest", ties: Sequence[str] = ()
) -> DataFrame:
    """The oldest or latest row of each account, undated rows counting as oldest. Rows of
    one day are settled by ``ties`` (see :func:`tie_order`)."""
    if pick not in ("oldest", "latest"):
        raise ValueError("pick must be 'oldest' or 'latest'")
    day = F.col(dated_by)
    order = day.asc_nulls_first() if pick == "oldest" else day.desc_nulls_last()
    return first_rows(df, ["page_id"], [order, *tie_order(df, ties)])


def latest_summary(summaries: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Newest summary of each account as its first two bullets."""
    newest = one_row_per_page(summaries, "date", "latest", ties)
    pieces = newest.select("page_id", "date", bullets(F.col("summary")).alias("_pieces"))
    return pieces.select(
        "page_id", "date", piece_at(F.col("_pieces"), 0).alias("bullet_1"), piece_at(F.col("_pieces"), 1).alias("bullet_2")
    )


def earliest_ideas(ideas: DataFrame, k: int = fv.PAST_IDEAS) -> DataFrame:
    """The ``k`` earliest ideas of each account."""
    order = [F.col("date").asc_nulls_first(), F.col("caption"), row_digest(ideas)]
    return first_rows(ideas, ["page_id"], order, k)


def shown_ideas(ideas: DataFrame, k: int = fv.SHOWN_IDEAS) -> DataFrame:
    """A few ideas of each account. Any would do; the earliest are taken."""
    return earliest_ideas(ideas, k)


def descriptions(business_context: DataFrame) -> DataFrame:
    """One business description per account."""
    return first_rows(business_context, ["page_id"], [F.col("description")]).select("page_id", "description")


def numbered_ideas(ideas: DataFrame, line: Column | None = None, k: int = fv.PAST_IDEAS) -> DataFrame:
    """The ``k`` earliest ideas of each account as one numbered text.

    Only the ``k`` rows that survive the ranking are gathered into a list. ``line`` is
    the text of an entry, by default its summary.
    """
    text = shown(F.col("post_summary")) if line is None else line
    lines = ideas.select("page_id", "date", "caption", text.alias("_text"))
    order = [F.col("date").asc_nulls_first(), F.col("caption"), F.col("_text")]
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(*order))
    ranked = lines.withColumn("_rank", rank).filter(F.col("_rank") <= k)
    entries = F.array_sort(F.collect_list(F.struct("_rank", "_text")))
    numbered = F.transform(entries, lambda e: F.concat(e["_rank"].cast("string"), F.lit(". "), e["_text"]))
    return ranked.groupBy("page_id").agg(F.concat_ws("\n", numbered).alias("past_ideas"))


def theme_line() -> Column:
    """Entry text of the older list: themes with the post type."""
    return F.concat(shown(F.col("themes")), F.lit(" ("), shown(F.col("post_type")), F.lit(")"))


def shown(value: Column) -> Column:
    """A missing value as the page prints it."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def next_slots(ideas: DataFrame, as_of: AsOf, pages: DataFrame | None = None, gap: int = fv.SLOT_GAP_DAYS) -> DataFrame:
    """Day of each account's next post: some days after its last idea, or after today.

    Accounts of ``pages`` without ideas join as undated rows, so one aggregation does.
    """
    dated = ideas.select("page_id", F.col("date").try_cast("date").alias("_day"))
    if pages is not None:
        dated = dated.unionByName(pages.select("page_id", F.lit(None).cast("date").alias("_day")))
    last = F.coalesce(F.max("_day"), as_date(as_of))
    return dated.groupBy("page_id").agg(F.date_add(last, gap).alias("next_date"))


def next_slot_overall(ideas: DataFrame, as_of: AsOf, gap: int = fv.SLOT_GAP_DAYS) -> DataFrame:
    """The next day over all accounts together."""
    last = F.coalesce(F.max(F.col("date").try_cast("date")), as_date(as_of))
    return ideas.agg(F.date_add(last, gap).alias("next_date"))


def account_context(
    pages: DataFrame, ideas: DataFrame, inspiration: DataFrame, past_concepts: DataFrame,
    insights: DataFrame, pick: str = "oldest", ties: Sequence[str] = (),
) -> DataFrame:
    """Four lookups per account on one row, each with its text for "nothing found".
    ``ties`` are columns that all three dated frames have."""
    structure, inspired = shown(F.col("post_structure")), shown(F.col("post_ideas"))
    parts = (
        ("past_ideas", numbered_ideas(ideas), F.col("past_ideas"), fv.NO_PAST_POSTS),
        (
            "inspiration", one_row_per_page(inspiration, "update_date", pick, ties),
            F.concat(F.lit("Post structure: "), structure, F.lit(". Post ideas: "), inspired, F.lit(".")),
            fv.NO_INSPIRATION,
        ),
        (
            "past_concepts", one_row_per_page(past_concepts, "update_date", pick, ties),
            shown(F.col("past_ideas")), fv.NO_PAST_CONCEPTS,
        ),
        ("insights", one_row_per_page(insights, "update_date", pick, ties), shown(F.col("notes")), fv.NO_INSIGHTS),
    )
    context = pages
    for name, rows, text, missing in parts:
        context = context.join(rows.select("page_id", text.alias(name)), "page_id", "left")
        context = context.withColumn(name, F.coalesce(name, F.lit(missing)))
    return context


# --- prompts ---------------------------------------------------------------------------


def performance_prompts(summaries: DataFrame, business_context: DataFrame) -> DataFrame:
    """Business description and performance summary of each account as a prompt."""
    joined = summaries.join(descriptions(business_context), "page_id", "left")
    text = fill(fv.PERFORMANCE_PROMPT, description=shown(F.col("description")), summary=F.col("summary"))
    return joined.select("page_id", text.alias("prompt"))


def idea_prompts(context: DataFrame, strategy: str = "strategy", user_context: str | None = None) -> DataFrame:
    """Prompt for one new idea per account from its context row."""
    start = fill(
        fv.IDEA_PROMPT_CONTEXT, strategy=F.col(strategy), past_concepts=F.col("past_concepts"),
        inspiration=F.col("inspiration"), past_ideas=F.col("past_ideas"), insights=F.col("insights"),
    )
    extra = F.lit("")
    if user_context is not None:
        given = F.coalesce(F.length(user_context) > 0, F.lit(False))
        extra = F.when(given, fill(fv.IDEA_PROMPT_USER, user_context=F.col(user_context))).otherwise(F.lit(""))
    return context.select("page_id", F.concat(start, extra, F.lit(fv.IDEA_PROMPT_REQUEST)).alias("prompt"))


def tweak_prompts(ideas: DataFrame, tweaks: DataFrame) -> DataFrame:
    """Prompt to rework an idea, for each idea that got non-blank feedback."""
    asked = tweaks.filter(is_filled(F.col("feedback"))).select(
        F.col("page_id").alias("_page"), F.col("caption").alias("_caption"), "feedback"
    )
    wanted = (F.col("page_id") == F.col("_page")) & (F.col("caption") == F.col("_caption"))
    joined = ideas.join(asked, wanted)
    values = {name: shown(F.col(name)) for name in fv.IDEA_FIELDS}
    text = fill(fv.TWEAK_PROMPT, feedback=F.col("feedback"), **values)
    return joined.select("page_id", "caption", text.alias("prompt"))


# --- replies ----------------------------------------------------------------------------


def parsed_replies(replies: DataFrame) -> DataFrame:
    """The idea in each reply; replies without a readable JSON object give no row here but
    one in :func:`rejected_replies`."""
    read = read_replies(replies)
    return read.filter(F.col(REFUSED).isNull()).drop("reply", REFUSED)


def rejected_replies(replies: DataFrame) -> DataFrame:
    """The replies that hold no idea, with the reason: no object, or invalid JSON."""
    read = read_replies(replies)
    return read.filter(F.col(REFUSED).isNotNull()).select(*replies.columns, F.col(REFUSED).alias("reason"))


def counted_replies(read: DataFrame, observation: Observation) -> DataFrame:
    """What ``read_replies`` gives, accepted and refused replies being counted on the way."""
    return read.observe(observation, F.count_if(F.col(REFUSED).isNull()).alias("accepted"), F.count_if(F.col(REFUSED).isNotNull()).alias("refused"))


def reply_ideas(
    replies: DataFrame, slots: DataFrame, as_of: AsOf, source: str = fv.GENERATED_SOURCE, ascii_only: bool = True,
) -> DataFrame:
    """Parsed replies as idea rows on the next free day of their account; an account without
    ideas, and so without a slot, gets the day a gap after ``as_of``.

    Lists are kept as JSON text, their items in order and printed as Python prints them; a
    text that merely looks like a list stays as it is.
    """
    read = read_replies(replies, stored=True, ascii_only=ascii_only)
    rows = read.filter(F.col(REFUSED).isNull()).select("page_id", *fv.IDEA_FIELDS)
    dated = left_join_unique(rows, slots.select("page_id", "next_date"), [("page_id", "page_id")])
    day = F.coalesce("next_date", F.date_add(as_date(as_of), fv.SLOT_GAP_DAYS))
    return dated.select("page_id", iso_date(day).alias("date"), *fv.IDEA_FIELDS, F.lit(source).alias("source"))


def manual_ideas(entries: DataFrame, source: str = fv.MANUAL_SOURCE) -> DataFrame:
    """Idea rows typed in by hand; comma-separated themes become JSON list text."""
    return entries.select(
        "page_id", F.col("date").cast("date").cast("string").alias("date"), "post_summary", "caption",
        "post_type", list_to_json(split_list(F.col("themes"))).alias("themes"), "tone",
        F.lit(source).alias("source"),
    )


# --- deletes and updates -------------------------------------------------------------------


def _scope(scope: str) -> tuple[str, ...]:
    """Columns that identify an idea. The pages match on caption alone, across all
    accounts; that is ``scope="all"``."""
    if scope not in ("page", "all"):
        raise ValueError("scope must be 'page' or 'all'")
    return ("page_id", "caption") if scope == "page" else ("caption",)


def without_caption(ideas: DataFrame, caption: str, page_id: int | None = None) -> DataFrame:
    """Ideas left after deleting one caption; ideas without a caption stay."""
    gone = F.col("caption").eqNullSafe(F.lit(caption))
    if page_id is not None:
        gone = gone & F.col("page_id").eqNullSafe(F.lit(page_id).cast("bigint"))
    return ideas.filter(~gone)


def without_captions(ideas: DataFrame, deleted: DataFrame, scope: str = "page") -> DataFrame:
    """Ideas left after deleting a batch of captions.

    ``deleted`` goes straight into the join, which lets adaptive execution split the
    task of a caption that very many ideas share.
    """
    keys = list(_scope(scope))
    return ideas.join(deleted.select(*keys), keys, "left_anti").select(*ideas.columns)


def list_text(value: Column, is_list: bool) -> Column:
    """An array joined by commas; text is taken as it is."""
    return join_list(value) if is_list else value


def with_updates(ideas: DataFrame, updates: DataFrame, as_of: AsOf, scope: str = "page") -> DataFrame:
    """Ideas after a batch of rewrites, each found by its previous caption.

    All rewrites look at the captions as they were before the batch. If several name
    the same idea the one with the smallest ``seq`` counts: it renames the idea, so
    the others no longer find it. Rewritten ideas get the day of ``as_of``.
    """
    keys = list(_scope(scope))
    types = dict(updates.dtypes)
    match = [c if c != "caption" else "previous_caption" for c in keys]
    new_values = [
        list_text(F.col(c), types[c].startswith("array")).alias(f"_new_{c}") for c in fv.IDEA_FIELDS
    ]
    order = [F.col("seq")] if "seq" in updates.columns else []
    first = first_rows(updates, match, [*order, row_digest(updates)])
    changes = first.select(*[F.col(c).alias(f"_by_{c}") for c in match], *new_values, F.lit(True).alias("_hit"))
    joined = left_join_unique(ideas, changes, [(k, f"_by_{m}") for k, m in zip(keys, match)])
    hit = F.coalesce("_hit", F.lit(False))
    columns = []
    for c in ideas.columns:
        if c in fv.IDEA_FIELDS:
            columns.append(F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "date":
            columns.append(F.when(hit, as_date(as_of).cast("string")).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return joined.select(*columns)


def updates_from_replies(replies: DataFrame, fields: Sequence[str] = ("page_id", "previous_caption")) -> DataFrame:
    """Rewrites taken from tweak replies, listed themes and tones joined by commas."""
    listed = {name: comma_list(F.col(name)) for name in ("themes", "tone")}
    return parsed_replies(replies).withColumns(listed).select(*fields, *fv.IDEA_FIELDS)
