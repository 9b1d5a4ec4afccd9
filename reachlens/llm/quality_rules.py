"""Quality rules: measures of a text held against a table of thresholds, in one projection.

Everything is built-in expressions. The rules are data (:class:`Rule`); :func:`verdict`
compiles them into one expression over the counts they are ratios of. No row is shuffled.

Defined results: a null text counts as empty, has no words and fails the base rule; null
and repeated ids and repeated rows are judged row by row; an empty table gives an empty
result; columns besides id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# What separates words, and what counts as a symbol.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = r" \u0009\u000A\u000B\u000C\u000D"
SYMBOLS = "#*$%&|<>"

# Common words of English, German, Spanish and French, judged together: texts mix languages.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was were which with you "
    "auf aus bei das dem den der des die ein eine es für im ist mit nicht sich sie und von zu "
    "al con de del el en la las lo los no para por que se su un una y "
    "à au avec dans du elle est et il le les ne par pour qui sur une"
)


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= measure <= high``; an open side is None. Rules whose
    ``least_words`` a text does not reach do not judge it: ratios of few words say little."""

    measure: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0


# Counts per text, and ratios of two of them; a ratio is null where its base is zero.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_stop_words")

MEASURES = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "word_chars"),
    "capital_ratio": ("n_capitals", "word_chars"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
}

RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", high=0.05),
    Rule("capital_ratio", high=0.50),
    Rule("stop_word_ratio", low=0.03, least_words=100),
    Rule("dup_line_ratio", high=0.50),
)


def with_measures(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``COUNTS`` and ``MEASURES``, their names behind ``prefix``.

    Windows of three words are told apart by a 64-bit hash of the words and sorted within
    the row if any repeats: a text of n words costs n log n, and nothing is exploded. Each step is its
    own projection, so that no lambda computes an array anew for every element.
    """
    text = f"coalesce(`{text_col}`, '')"
    kept = [F.col(f"`{c}`") for c in docs.columns]
    q = {name: f"`{prefix}{name}`" for name in (*COUNTS, "words", "lines", "windows", "again")}

    def step(frame: DataFrame, carried: Sequence[str], **made: str) -> DataFrame:
        return frame.select(*kept, *[F.col(q[c]) for c in carried], *[F.expr(e).alias(prefix + c) for c, e in made.items()])

    stop_words = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))
    split = step(
        docs, (),
        words=f"array_remove(split({text}, r'{SPACES}'), '')",
        lines=f"filter(split({text}, '\n'), x -> trim(BOTH '{SPACE_CHARS}' FROM x) <> '')",
        n_symbols=f"CAST(length(regexp_replace({text}, '[^{SYMBOLS}]+', '')) AS BIGINT)",
        n_capitals=f"CAST(length(regexp_replace({text}, '[^A-Z]+', '')) AS BIGINT)",
    )
    windows = step(
        split, ("n_symbols", "n_capitals"),
        word_chars=f"CAST(length(array_join({q['words']}, '')) AS BIGINT)",
        n_words=f"CAST(size({q['words']}) AS BIGINT)",
        n_lines=f"CAST(size({q['lines']}) AS BIGINT)",
        n_dup_lines=f"CAST(size({q['lines']}) - size(array_distinct({q['lines']})) AS BIGINT)",
        n_stop_words=f"CAST(size(filter({q['words']}, w -> lower(w) IN ({stop_words}))) AS BIGINT)",
        windows=f"""CASE WHEN size({q['words']}) > 2 THEN transform(sequence(1, size({q['words']}) - 2),
            i -> xxhash64({q['words']}[i - 1], {q['words']}[i], {q['words']}[i + 1])) ELSE array() END""",
    )
    counts = ("word_chars", "n_symbols", "n_capitals", "n_words", "n_lines", "n_dup_lines", "n_stop_words")
    in_order = step(windows, counts, windows=f"""CASE WHEN size({q['windows']}) > size(array_distinct({q['windows']}))
        THEN sort_array(transform({q['windows']}, (h, i) -> named_struct('h', h, 'p', i))) END""")
    again = step(in_order, counts, again=f"""filter({q['windows']}, (x, i) ->
        coalesce(x.h = get({q['windows']}, i - 1).h, false) OR coalesce(x.h = get({q['windows']}, i + 1).h, false)).p""")
    counted = step(again, counts, n_repeat_words=f"""CAST(coalesce(size(array_distinct(concat(
        {q['again']}, transform({q['again']}, x -> x + 1), transform({q['again']}, x -> x + 2)))), 0) AS BIGINT)""")
    return step(counted, COUNTS, **{name: f"{q[top]} / nullif({q[base]}, 0)" for name, (top, base) in MEASURES.items()})


def verdict(rules: Sequence[Rule] = RULES, prefix: str = "") -> Column:
    """The rule table as one boolean expression; an undefined ratio breaks no rule."""
    parts = []
    for rule in rules:
        bounds = [f"`{prefix}{rule.measure}` {op} {value!r}D" for op, value in ((">=", rule.low), ("<=", rule.high)) if value is not None]
        parts.append(f"(`{prefix}n_words` < {rule.least_words} OR coalesce({' AND '.join(bounds)}, true))")
    return F.expr(" AND ".join(parts) or "true")


def base_failed(prefix: str = "") -> Column:
    """Too short, or more than half of the words in repeated windows."""
    n = f"`{prefix}n_words`"
    return F.expr(f"{n} < 50 OR 100 * `{prefix}n_repeat_words` > 50 * {n}")


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, ratios, ``base_failed`` and ``kept``."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_measures(narrow).select(
        "doc_id", *COUNTS, *MEASURES, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"),
    )


def kept_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns they came with."""
    prefix = "_quality"
    while any(c.lower().startswith(prefix) for c in docs.columns):  # Spark's names have no case
        prefix += "_"
    # A filter is not moved below a row number, which would put the measures into it in full,
    # once for each time a rule names them.
    numbered = with_measures(docs, text_col, prefix).withColumn(f"{prefix}row", F.monotonically_increasing_id())
    passed = ~base_failed(prefix) & verdict(rules, prefix) & (F.col(f"{prefix}row") >= 0)
    return numbered.filter(passed).select(*docs.columns)
