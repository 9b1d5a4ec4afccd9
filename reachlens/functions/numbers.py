"""Numeric expressions that reproduce dataframe arithmetic exactly.

Formulas that use their argument many times take and return SQL text: ``x`` is a column
name or an expression, the result goes through ``expr`` or ``selectExpr``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round2(x: Column) -> Column:
    """Two decimals, half to even on the scaled double.

    ``bround`` works on the decimal text of the value and differs on inputs such
    as 1.115, so the scaling is spelled out.
    """
    return F.rint(x * 100.0) / 100.0


def let_sql(x: str, body: str) -> str:
    """``body`` in terms of ``v``, with ``x`` evaluated once and called ``v``.

    Meant for frames with a row per account: the lambda stays outside generated code.
    """
    return f"get(transform(array({x}), v -> {body}), 0)"


def round2_exact_sql(x: str) -> str:
    """Two decimals of the exact binary value, the rounding of scalar floats.

    ``round2`` sees a tie wherever the scaled double lands on a half. Here the error
    of that product, taken by splitting v into two short halves, breaks such ties.
    """
    scaled = "(v * 100D)"
    high = "(v * 134217729D - (v * 134217729D - v))"
    error = f"(({high} * 100D - {scaled}) + (v - {high}) * 100D)"
    at_half = f"{scaled} - floor({scaled}) = 0.5D"
    body = f"""CASE WHEN {at_half} AND {error} > 0 THEN (floor({scaled}) + 1) / 100D
        WHEN {at_half} AND {error} < 0 THEN floor({scaled}) / 100D ELSE rint({scaled}) / 100D END"""
    return let_sql(f"CAST({x} AS DOUBLE)", body)


def float_ratio(top: Column, bottom: Column) -> Column:
    """Division as floats do it: something over 0 is infinite, 0 over 0 is missing."""
    endless = F.lit(float("inf"))
    return (
        F.when((bottom == 0) & (top > 0), endless).when((bottom == 0) & (top < 0), -endless)
        .otherwise(F.try_divide(top, bottom))
    )


def like_rate(likes: Column, reach: Column) -> Column:
    """Likes per hundred people reached. Likes without any reach rank above all."""
    return round2(float_ratio(likes, reach) * 100.0)


def safe_ratio_sql(top: str, bottom: str) -> str:
    """top / bottom, and 0 where the denominator is not positive."""
    return f"CASE WHEN {bottom} > 0 THEN try_divide({top}, {bottom}) ELSE 0D END"


def mean_of(x: str) -> Column:
    """Mean of the non-null values of an integer column, null when there are none.

    Sum and count stay integers until the last step, so the result does not depend
    on the order in which partial sums meet.
    """
    return F.expr(f"try_divide(sum({x}), count({x}))")


def pct_diff_sql(current: str, previous: str) -> str:
    """Percent change: null if a side is missing or the base is 0, 0 if equal."""
    c, p = f"CAST({current} AS DOUBLE)", f"CAST({previous} AS DOUBLE)"
    change = round2_exact_sql(f"try_divide({c} - {p}, {p}) * 100D")
    return f"""CASE WHEN {c} IS NULL OR {p} IS NULL THEN CAST(NULL AS DOUBLE) WHEN {c} = {p} THEN 0D
        WHEN {p} = 0 THEN CAST(NULL AS DOUBLE) ELSE {change} END"""


def to_number(x: Column) -> Column:
    """Text to double; anything unreadable becomes null."""
    return x.try_cast("double")


def money(x: Column) -> Column:
    """Exact amount of up to nine decimals, so that sums do not depend on row order."""
    return x.cast("decimal(28,9)")
