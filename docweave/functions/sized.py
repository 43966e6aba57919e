"""Broadcast hints for tables whose size was looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a small side that may be broadcast.
MAX_ROWS = 100_000


def small_side(df: DataFrame, limit: int = MAX_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
