"""SQL spellings of the scalar rules, written for DuckDB."""

from __future__ import annotations

import re

from reachlens.fixed_values import TIME_BUCKETS, WEEKDAYS


def bucket(ts: str) -> str:
    h = f"hour({ts})"
    return (
        f"CASE WHEN {h} = 0 THEN '12 AM' WHEN {h} <= 8 THEN '1-8 AM' WHEN {h} <= 11 THEN CAST({h} AS VARCHAR) || ' AM' "
        f"WHEN {h} = 12 THEN '12 PM' ELSE CAST({h} - 12 AS VARCHAR) || ' PM' END"
    )


def spine(labels: tuple[str, ...], name: str) -> str:
    rows = ", ".join(f"({i}, '{label}')" for i, label in enumerate(labels))
    return f"(SELECT * FROM (VALUES {rows}) AS v(position, {name}))"


BUCKETS = spine(TIME_BUCKETS, "time_bucket")
DAYS = spine(WEEKDAYS, "weekday")


def exact2(x: str) -> str:
    """Two decimals of the exact value: the error of x * 100 decides apparent ties."""
    high = f"(({x}) * 134217729.0::DOUBLE - (({x}) * 134217729.0::DOUBLE - ({x})))"
    scaled = f"(({x}) * 100.0::DOUBLE)"
    error = f"(({high} * 100.0::DOUBLE - {scaled}) + (({x}) - {high}) * 100.0::DOUBLE)"
    half = f"({scaled} - floor({scaled}) = 0.5)"
    return (
        f"((CASE WHEN {half} AND {error} > 0 THEN floor({scaled}) + 1 WHEN {half} AND {error} < 0 THEN floor({scaled}) "
        f"ELSE round_even({scaled}, 0) END) / 100.0::DOUBLE)"
    )


def change(c: str, p: str) -> str:
    c, p = f"CAST({c} AS DOUBLE)", f"CAST({p} AS DOUBLE)"
    return (
        f"CASE WHEN {c} IS NULL OR {p} IS NULL THEN NULL WHEN {c} = {p} THEN 0.0::DOUBLE WHEN {p} = 0 THEN NULL "
        f"ELSE {exact2(f'({c} - {p}) / {p} * 100.0::DOUBLE')} END"
    )


def grouped(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def plain(x: str) -> str:
    """Shortest digits with grouped thousands, for values from 0.0001 up."""
    return (
        f"(CASE WHEN {x} = 0 THEN '0.0' ELSE {grouped(f'trunc({x})')} || "
        f"'.' || split_part(CAST(CAST({x} AS DOUBLE) AS VARCHAR), '.', 2) END)"
    )


def fixed2(x: str, commas: bool = True) -> str:
    """Text with two decimals of an already rounded value."""
    r = exact2(x)
    cents = f"CAST(round_even({r} * 100, 0) AS BIGINT)"
    whole = f"{cents} // 100"
    return f"({grouped(whole) if commas else f'CAST({whole} AS VARCHAR)'} || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'))"


def signed(x: str) -> str:
    return f"printf('%+.2f%%', {x})"


STYLE = "CASE WHEN {0} > 0 THEN 'positive' WHEN {0} IS NOT NULL THEN 'negative' END"


def text(value: str) -> str:
    """A string literal, line breaks included."""
    return "'" + value.replace("'", "''") + "'"


def template(pattern: str, **columns: str) -> str:
    """Concatenation that fills {name} marks."""
    parts = re.split(r"\{(\w+)\}", pattern)
    out = [f"({columns[p]})" if i % 2 else text(p) for i, p in enumerate(parts) if p]
    return " || ".join(out)
