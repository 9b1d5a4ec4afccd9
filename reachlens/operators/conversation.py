"""Chat history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def visible_turns(turns: DataFrame) -> DataFrame:
    """Turns in order without those that only instruct the model."""
    shown = turns.filter(~F.col("role").eqNullSafe("system"))
    return shown.orderBy("conv_id", "turn")
