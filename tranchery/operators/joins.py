"""Joins whose strategy is chosen by a size that was counted, not guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small_side(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcast where it has at most ``most_rows`` rows; otherwise as it is, to be shuffled.  The count
    stops at one row beyond the bound."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
