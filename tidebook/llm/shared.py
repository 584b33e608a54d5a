"""Choices between a broadcast and a shuffle that rest on a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.session import written

#: Most rows of a narrow table (a few numbers or digests each) that is broadcast.
MOST_BROADCAST_ROWS = 500_000


def measured(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` written to the shared folder, and its number of rows."""
    df = written(df, name)
    return df, df.count()


def join_side(df: DataFrame, name: str, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """``df`` written out; marked for broadcast where its row count is within the bound, else left to a shuffle join."""
    df, n = measured(df, name)
    return F.broadcast(df) if n <= most else df
