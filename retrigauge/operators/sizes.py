"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is sent whole to every executor; beyond it Spark joins by shuffle.
MOST_ROWS = 200_000


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than `most` rows, else df itself."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded(df: DataFrame, rows: int, most: int = MOST_ROWS) -> DataFrame:
    """df, known to have no more than `rows` rows, with a broadcast hint if that is few enough; nothing runs to find out."""
    return F.broadcast(df) if rows <= most else df
