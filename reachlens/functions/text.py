"""Text expressions: templates, bullets, lists, display formats, JSON replies."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from reachlens.fixed_values import BULLET
from reachlens.functions.numbers import let_sql, round2_exact_sql

# Every character that counts as white space.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Letters, digits and underscore of every script, with later apostrophes. The possessive
# quantifier never gives characters back, which saves the matcher its bookkeeping.
TERM_PATTERN = r"[\p{L}\p{N}_][\p{L}\p{N}_']*+"


def strip_space(text: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def contains_ignoring_case(text: Column, needle: str) -> Column:
    """Substring test that answers false, never null, for missing text."""
    return F.coalesce(F.contains(F.lower(text), F.lit(needle.lower())), F.lit(False))


def is_filled(text: Column) -> Column:
    """True where the text has something besides white space."""
    return F.coalesce(F.length(strip_space(text)) > 0, F.lit(False))


def bullets(text: Column, delimiter: str = BULLET) -> Column:
    """Non-blank, stripped pieces between bullet marks."""
    pieces = F.transform(F.split(text, re.escape(delimiter)), strip_space)
    return F.filter(pieces, lambda piece: piece != "")


def piece_at(pieces: Column, position: int) -> Column:
    """One piece by position, "" when there are fewer."""
    return F.coalesce(F.get(pieces, F.lit(position)), F.lit(""))


def fill(template: str, **columns: Column) -> Column:
    """Fill ``{name}`` marks with columns; a missing value makes the text null."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            parts.append(columns[piece])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def terms(*texts: Column) -> Column:
    """Lower-cased words of the joined texts, every occurrence kept."""
    joined = F.concat_ws(" ", *texts)
    return F.regexp_extract_all(F.lower(joined), F.lit(TERM_PATTERN), F.lit(0))


def cloud_words(*texts: Column) -> Column:
    """Words of the joined texts as a word cloud takes them: spelled as they are, without a
    final ``'s``, numbers left out, in order."""
    found = F.regexp_extract_all(F.concat_ws(" ", *texts), F.lit(TERM_PATTERN), F.lit(0))
    bare = F.transform(found, lambda w: F.when(F.lower(F.right(w, F.lit(2))) == "'s", F.left(w, F.length(w) - 2)).otherwise(w))
    return F.filter(bare, lambda w: ~w.rlike(r"^\p{Nd}+$"))


def singular(word: Column) -> Column:
    """A word without the ``s`` that may be a plural's; ``ss`` is none."""
    return F.when(word.rlike("(^|[^s])s$"), F.left(word, F.length(word) - 1)).otherwise(word)


def split_list(text: Column) -> Column:
    return F.split(text, ",")


def join_list(values: Column) -> Column:
    return F.array_join(values, ",")


def list_to_json(values: Column) -> Column:
    """JSON array text with ``", "`` between items, the layout kept at rest."""
    quoted = F.transform(values, lambda v: F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", ""))
    return F.concat(F.lit("["), F.array_join(quoted, ", ", "null"), F.lit("]"))


def _json_list(text: Column) -> Column:
    """The items of a JSON array text; null for any other text."""
    return F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<string>"))


def comma_list(text: Column) -> Column:
    """A JSON array text as its items joined by commas; other text as it is."""
    return F.coalesce(join_list(_json_list(text)), text)


def title_label(name: Column) -> Column:
    """Column name to heading: underscores to blanks, words capitalised."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


# --- display formats: SQL text in, SQL text out ------------------------------------


def _format_sql(pattern: str, x: str) -> str:
    """``format_string`` that stays null for null, which Java would print as text."""
    return f"CASE WHEN {x} IS NOT NULL THEN format_string('{pattern}', {x}) END"


def thousands_sql(x: str) -> str:
    """1234567 -> 1,234,567."""
    return _format_sql("%,d", f"CAST({x} AS BIGINT)")


def two_decimals_sql(x: str, grouped: bool = True) -> str:
    """Two decimals of the exact value; the rounding is done before formatting."""
    shown = _format_sql("%,.2f" if grouped else "%.2f", "v")
    finite = let_sql(round2_exact_sql(x), shown)
    return f"CASE WHEN abs({x}) = double('Infinity') THEN if({x} > 0, 'inf', '-inf') ELSE {finite} END"


def currency_sql(x: str) -> str:
    return f"concat('$', {two_decimals_sql(x)})"


def signed_percent_sql(x: str) -> str:
    return _format_sql("%+.2f%%", x)


def plain_number_sql(x: str) -> str:
    """Shortest text that reads back as the same double, with grouped thousands.

    Below 0.0001 and from 10^16 on it has an exponent. Java may print one digit more than
    needed, so 15 and 16 digits are tried first, 16 both rounded and cut.
    """
    longest = "format_string('%.16e', v)"
    shortest = longest
    for shorter in (f"regexp_replace({longest}, '[0-9]e', 'e')", "format_string('%.15e', v)", "format_string('%.14e', v)"):
        shortest = f"CASE WHEN CAST({shorter} AS DOUBLE) = v THEN {shorter} ELSE {shortest} END"
    printed = let_sql(f"CAST({x} AS DOUBLE)", shortest)
    parts = let_sql(printed, """named_struct(
        'sign', regexp_extract(v, '^-', 0), 'e', CAST(split_part(v, 'e', 2) AS INT),
        'd', regexp_replace(replace(ltrim('-', split_part(v, 'e', 1)), '.', ''), '(?<=.)0+$', ''))""")
    scientific = """concat(left(v.d, 1), if(length(v.d) > 1, concat('.', substring(v.d, 2)), ''),
        'e', if(v.e < 0, '-', '+'), lpad(CAST(abs(v.e) AS STRING), greatest(2, length(CAST(abs(v.e) AS STRING))), '0'))"""
    small = "concat('0.', repeat('0', -v.e - 1), v.d)"
    large = """concat(format_string('%,d', CAST(rpad(left(v.d, v.e + 1), v.e + 1, '0') AS BIGINT)),
        '.', if(length(v.d) > v.e + 1, substring(v.d, v.e + 2), '0'))"""
    shown = f"concat(v.sign, CASE WHEN v.e < -4 OR v.e > 15 THEN {scientific} WHEN v.e < 0 THEN {small} ELSE {large} END)"
    return f"""CASE WHEN isnan({x}) THEN 'nan' WHEN abs({x}) = double('Infinity') THEN if({x} > 0, 'inf', '-inf')
        WHEN {x} = 0 THEN '0.0' WHEN {x} IS NOT NULL THEN {let_sql(parts, shown)} END"""


def sign_class_sql(diff: str) -> str:
    """Style of a change figure: positive above 0, else negative, null if absent."""
    return f"CASE WHEN {diff} > 0 THEN 'positive' WHEN {diff} IS NOT NULL THEN 'negative' END"


# --- JSON replies --------------------------------------------------------------


def json_object_text(reply: Column) -> Column:
    """From the first ``{`` to the last ``}`` across lines; the text itself if none."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(strip_space(reply))
