"""Quotes from actions, edges, positions and rewards as expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.kernels import c, sigmoid


def side_edge(side_code: int, mid, price, p_fill, alpha_bps, cost_bps, inventory, rebate_bps: float, latency_bps: float, skew_bps: float) -> Column:
    """Expected basis points of resting on one side: (spread earned + rebate + alpha) if filled, less adverse cost, latency and skew."""
    m, p = c(mid).cast("double"), c(price)
    earned = (m - p) / m * 1e4 if side_code > 0 else (p - m) / m * 1e4
    signed = 1.0 if side_code > 0 else -1.0
    return c(p_fill) * (earned + rebate_bps + signed * c(alpha_bps)) - c(cost_bps) - latency_bps - signed * skew_bps * c(inventory)


def raw_to_tick(raw, low, high, reverse: bool = False) -> Column:
    """A raw action in one of the ticks from low to high, each an equal share of its logistic value."""
    share = sigmoid(c(raw).cast("double"))
    share = 1 - share if reverse else share
    n = c(high) - c(low) + 1
    return c(low) + F.least(F.floor(share * n), n - 1)


def raw_to_qty(raw, default_qty: float, most_qty: float, step: float) -> Column:
    """A raw size action; 0 stands for the default quantity, and all stay under the most, in whole steps."""
    shift = F.log(F.lit(default_qty / (most_qty - default_qty)))
    return F.floor(sigmoid(c(raw).cast("double") + shift) * most_qty / step + 1e-9) * step


def positions(fills: DataFrame, by: list[str], order: list[str], side: str, qty: str, price: str, fee_bps: float) -> DataFrame:
    """``fills`` with position, cash, equity at the fill's price, and drawdown from the highest equity so far.

    A running sum takes each term in two parts, multiples of 2^-10 and the rest: the first add up exactly up to 2^43, so that
    millions of fills leave no rounding in what comes after them.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    signed = F.col(side) * F.col(qty)
    notional = F.col(qty) * F.col(price)

    def total(x: Column) -> Column:
        coarse = F.rint(x * 1024.0) / 1024.0
        return F.sum(coarse).over(w) + F.sum(x - coarse).over(w)

    out = fills.withColumn("position", total(signed)).withColumn("cash", total(-signed * F.col(price) - notional * fee_bps / 1e4))
    out = out.withColumn("equity", F.col("cash") + F.col("position") * F.col(price))
    peak = F.greatest(F.max("equity").over(w), F.lit(0.0))
    return out.withColumn("drawdown", peak - F.col("equity"))
