"""Rewards of a step with their penalties, and rewards projected to a horizon."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators import ordered as o


@dataclass(frozen=True)
class Penalties:
    """Basis points of held notional, of turnover and of what is held at the end, an amount a cancel, and a share of new drawdown."""

    inventory_bps: float = 0.0
    turnover_bps: float = 0.0
    cancel: float = 0.0
    drawdown_rate: float = 0.0
    terminal_bps: float = 0.0


def reward_components(steps: DataFrame, by: list[str], order: list[str], p: Penalties, contract: float = 1.0, start_equity: float = 0.0) -> DataFrame:
    """``steps`` with equity_delta, the five penalties and reward.

    A step has equity, position and mark price after it, the turnover and cancels in it, and whether it is terminal. The
    peak is the highest equity before the step; only what a step adds to the drawdown from it is penalised.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.coalesce(F.lag("equity").over(w), F.lit(start_equity))
    peak = F.greatest(F.coalesce(F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(start_equity)), F.lit(start_equity), before)
    held = F.abs("position") * F.col("mark") * contract
    zero = F.lit(0.0)
    deeper = F.greatest(F.greatest(peak - F.col("equity"), zero) - F.greatest(peak - before, zero), zero)
    parts = {
        "equity_delta": F.col("equity") - before,
        "inventory_penalty": held * p.inventory_bps / 1e4,
        "turnover_penalty": F.col("turnover") * p.turnover_bps / 1e4,
        "cancel_penalty": F.col("cancels") * p.cancel,
        "drawdown_penalty": deeper * p.drawdown_rate,
        "terminal_penalty": F.when(F.col("terminal"), held * p.terminal_bps / 1e4).otherwise(zero),
    }
    out = steps.withColumns(parts)
    return out.withColumn("reward", F.col("equity_delta") - sum((F.col(n) for n in parts if n.endswith("penalty")), zero))


def _later(rows: DataFrame, facts: DataFrame, by: list[str], ts: Column, horizon_us: int, name: str) -> DataFrame:
    """``rows`` with the (equity, mid) in force a horizon after ``ts``: of the first fact at or after it, null past the end or without a time."""
    probes = rows.withColumn("__at", ts + horizon_us).withColumn("__seq", F.lit(2**62))
    known = o.at_or_after(probes.where("__at is not null"), facts, by, ("__at", "__seq"), ("f_ts", "f_seq"), "f_value", name)
    unknown = probes.where("__at is null").withColumn(name, F.lit(None).cast(facts.schema["f_value"].dataType))
    return known.unionByName(unknown).drop("__at", "__seq")


@dataclass(frozen=True)
class Projection:
    """Horizon of the single-horizon modes, horizons with weights of the last, the scale, and the weights of what is blended."""

    horizon_us: int
    horizons: tuple[tuple[int, float], ...] = ()
    scale: float = 1.0
    path_weight: float = 1.0
    fill_weight: float = 1.0
    potential_weight: float = 1.0
    realized_weight: float = 1.0
    unrealized_weight: float = 1.0


def projected_rewards(anchors: DataFrame, fills: DataFrame, facts: DataFrame, by: list[str], p: Projection, contract: float = 1.0) -> DataFrame:
    """(anchor_id and the reward of each of seven modes); null where a mode lacks a future row that it needs.

    ``anchors`` has anchor_id, local_ts_us, next_ts_us, previous_equity, equity, env_reward, inventory, mid and realized;
    ``fills`` has anchor_id, local_ts_us, side_code, price, qty and fee; ``facts`` has local_ts_us, event_id, equity and mid.
    A mode that scores fills needs the future of all of an anchor's fills; an anchor without fills scores 0 for them.
    """
    f = facts.select(*by, F.col("local_ts_us").alias("f_ts"), F.col("event_id").alias("f_seq"), F.struct("equity", "mid").alias("f_value"))
    marked = _later(fills.select("anchor_id", *by, "local_ts_us", "side_code", "price", "qty", "fee"), f, by, F.col("local_ts_us"), p.horizon_us, "later")
    gain = F.col("qty") * contract * F.col("side_code") * (F.col("later.mid") - F.col("price")) - F.col("fee")
    scored = marked.groupBy("anchor_id").agg(F.count("*").alias("n_fills"), F.count("later.mid").alias("n_scored"), F.sum(gain).alias("gain"))
    a = _later(anchors, f, by, F.col("local_ts_us"), p.horizon_us, "at_h")
    a = _later(a, f, by, F.col("next_ts_us"), p.horizon_us, "next_h")
    for i, (h, _) in enumerate(p.horizons):
        a = _later(a, f, by, F.col("local_ts_us"), h, f"at_{i}")
    a = a.join(scored, "anchor_id", "left")
    fill = F.when(F.col("n_fills").isNull(), F.lit(0.0)).when(F.col("n_scored") == F.col("n_fills"), F.col("gain"))
    path = F.col("at_h.equity") - F.col("previous_equity")
    ahead = F.col("next_h.equity") - F.col("equity")
    carry = F.col("inventory") * contract * (F.col("at_h.mid") - F.col("mid"))
    several = sum((F.lit(w) * (F.col(f"at_{i}.equity") - F.col("previous_equity")) for i, (_, w) in enumerate(p.horizons)), F.lit(0.0))
    return a.select(
        "anchor_id",
        F.col("env_reward").alias("equity_delta"),
        (p.scale * path).alias("horizon_path_equity"),
        (p.scale * fill).alias("fill_markout_horizon"),
        (p.scale * (p.path_weight * path + p.fill_weight * fill)).alias("horizon_blend"),
        (F.col("env_reward") + p.scale * p.potential_weight * (ahead - path)).alias("horizon_potential_shaped"),
        (p.scale * (p.realized_weight * F.col("realized") + p.unrealized_weight * carry + p.fill_weight * fill)).alias("realized_lot_horizon"),
        (p.scale * several).alias("multi_horizon_path"),
    )
