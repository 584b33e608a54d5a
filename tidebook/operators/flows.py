"""Flow toxicity and price impact: volume buckets, price response to flow, rolling flow and control features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import kernels as k
from tidebook.operators import ordered as o


def volume_buckets(trades: DataFrame, by: list[str], ts: str, order: list[str], qty: str, side: str, size: int, slice_us: int = o.SLICE_US) -> DataFrame:
    """(by, bucket, buy, sell, closed_at) of full buckets of so much volume; a trade is split over the buckets that it meets.

    Closed form of the sequential filling: a trade covers a stretch of cumulative volume, and buckets are whole stretches.
    Quantities are integers; trades without a side are left out.
    """
    t = trades.where((F.col(side) != 0) & (F.col(qty) > 0))
    t = o.running_sum(t, by, ts, order, F.col(qty), "__hi", slice_us).withColumn("__lo", F.col("__hi") - F.col(qty))
    first, last = F.floor(F.col("__lo") / size).cast("long"), F.floor((F.col("__hi") - 1) / size).cast("long")
    parts = t.withColumn("bucket", F.explode(F.sequence(first, last)))
    part = F.least("__hi", (F.col("bucket") + 1) * size) - F.greatest("__lo", F.col("bucket") * size)
    got = parts.groupBy(*by, "bucket").agg(F.sum(F.when(F.col(side) > 0, part).otherwise(0)).alias("buy"), F.sum(F.when(F.col(side) < 0, part).otherwise(0)).alias("sell"), F.max(ts).alias("closed_at"))
    return got.where(F.col("buy") + F.col("sell") == size)


def vpin(buckets: DataFrame, by: list[str], size: int, window: int = 50, least: int = 10) -> DataFrame:
    """Mean imbalance of the last full buckets, as a share of their size; 0 until there are enough."""
    w = Window.partitionBy(*by).orderBy("bucket").rowsBetween(-(window - 1), 0)
    n = F.count("*").over(w)
    return buckets.withColumn("vpin", F.when(n >= least, F.sum(F.abs(F.col("buy") - F.col("sell"))).over(w) / (n * size)).otherwise(F.lit(0.0)))


def response_samples(trades: DataFrame, mids: DataFrame, by: list[str], step_us: int, response_us: int, slice_us: int = o.SLICE_US) -> DataFrame:
    """Every so long from the first quote on: the signed flow since the sample before, and the change of mid that followed.

    ``trades`` has local_ts_us, side_code, qty; ``mids`` has local_ts_us, event_id, mid. Samples whose response lies past the
    last quote are left out.
    """
    span = mids.groupBy(*by).agg(F.min("local_ts_us").alias("t0"), F.max("local_ts_us").alias("t1"))
    grid = span.select(*by, "t0", "t1", F.posexplode(F.sequence("t0", "t1", F.lit(step_us))).alias("i", "t"))
    grid = grid.where(F.col("t") + response_us <= F.col("t1")).withColumn("i", F.col("i").cast("long"))
    flow = trades.join(F.broadcast(span.select(*by, "t0")), by).withColumn("i", F.ceil((F.col("local_ts_us") - F.col("t0")) / step_us).cast("long"))
    flow = flow.groupBy(*by, "i").agg(F.sum(F.col("side_code") * F.col("qty")).alias("flow"))
    got = grid.join(flow, [*by, "i"], "left").withColumn("flow", F.coalesce("flow", F.lit(0)).cast("double"))
    facts = mids.select(*by, F.col("local_ts_us").alias("f_ts"), F.col("event_id").alias("f_seq"), "mid")
    got = got.withColumn("seq", F.lit(2**62)).withColumn("end", F.col("t") + response_us)
    got = o.asof_join(got, facts.withColumnRenamed("mid", "mid0"), by, ("t", "seq"), ("f_ts", "f_seq"), ["mid0"], slice_us)
    got = o.asof_join(got, facts.withColumnRenamed("mid", "mid1"), by, ("end", "seq"), ("f_ts", "f_seq"), ["mid1"], slice_us)
    return got.select(*by, "i", "t", "flow", (F.col("mid1") - F.col("mid0")).alias("response"))


def kyle_lambda(samples: DataFrame, by: list[str], window_us: int, least: int = 5) -> DataFrame:
    """Slope and R squared of response on flow over a window of time; 0 with too few samples or no variation."""
    w = Window.partitionBy(*by).orderBy("t").rangeBetween(-window_us, 0)
    n, flat = F.count("*").over(w), F.var_pop("flow").over(w) <= k.EPS
    slope = F.regr_slope("response", "flow").over(w)
    ok = (n >= least) & ~flat
    none = F.lit(0.0)
    spread = F.var_pop("response").over(w)
    # not by a correlation over the frame, which fails where either side is constant
    r2 = F.try_divide(slope * slope * F.var_pop("flow").over(w), spread)
    return samples.withColumn("slope", F.when(ok, slope).otherwise(none)).withColumn("r2", F.when(ok & (spread > k.EPS), r2).otherwise(none))


def flow_windows(frames: o.Frames, us: int, tag: str) -> dict[str, Column]:
    """Signed, total, bought and sold quantity, notional, count and ratio of trades in a window."""
    trade, side, qty = F.col("is_trade") == 1, F.col("side_code"), F.col("amount")
    total = lambda x: frames.total(F.when(trade, x), us)
    buy, sell = total(F.when(side > 0, qty)), total(F.when(side < 0, qty))
    return {
        f"buy_{tag}": buy, f"sell_{tag}": sell, f"signed_{tag}": buy - sell, f"abs_{tag}": buy + sell,
        f"notional_{tag}": total(F.col("price_tick") * qty), f"count_{tag}": frames.count(trade, us),
        f"ratio_{tag}": k.safe_divide(buy - sell, buy + sell),
    }
