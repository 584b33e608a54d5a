"""What the query modules share: rounding that both engines agree on, and inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Horizons and windows of the driver's sparse events, in microseconds.
HOUR = 3_600_000_000
H6, H12, H24 = 6 * HOUR, 12 * HOUR, 24 * HOUR
WEEK = 7 * 24 * HOUR


def r6(x: Column | str, name: str | None = None, digits: int = 6) -> Column:
    """Six decimals, without a negative zero: the oracles' ``round(x, 6) + 0``. Shares of whole numbers, which may lie just
    between two roundings, take more."""
    x = F.col(x) if isinstance(x, str) else x
    out = F.round(x.cast("double"), digits) + F.lit(0.0)
    return out.alias(name) if name else out


def sql6(expression: str, name: str, digits: int = 6) -> str:
    return f"round(cast({expression} as double), {digits}) + 0 as {name}"
