"""Scalar and array kernels as column expressions: all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this a denominator or a spread counts as zero, and quantity steps are floored with this slack.
EPS = 1e-12


def c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def safe_divide(num, den, default: float = 0.0) -> Column:
    """num / den, or the default where the denominator is next to zero or either is no finite number."""
    n, d = c(num).cast("double"), c(den).cast("double")
    ok = is_finite(n) & is_finite(d) & (F.abs(d) > EPS)
    return F.when(ok, F.try_divide(n, d)).otherwise(F.lit(default))


def signed_log1p(x) -> Column:
    x = c(x)
    return F.signum(x) * F.log1p(F.abs(x))


def clip(x, low: float, high: float) -> Column:
    """x within bounds; what is no finite number becomes 0."""
    x = c(x).cast("double")
    return F.when(is_finite(x), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))).otherwise(F.lit(0.0))


def finite_or_zero(x) -> Column:
    x = c(x).cast("double")
    return F.when(is_finite(x), x).otherwise(F.lit(0.0))


def bps_change(new, old) -> Column:
    """Relative change in basis points, 0 from a price next to zero."""
    new, old = c(new).cast("double"), c(old).cast("double")
    return F.when(F.abs(old) > EPS, (F.try_divide(new, old) - 1) * 1e4).otherwise(F.lit(0.0))


def mid_price(bid, ask) -> Column:
    return (c(bid) + c(ask)) * 0.5


def spread_bps(bid, ask) -> Column:
    return safe_divide((c(ask) - c(bid)) * 1e4, mid_price(bid, ask))


def microprice(bid, ask, bid_size, ask_size) -> Column:
    """Quotes weighted by the size on the other side, or the mid price without any size."""
    total = c(bid_size) + c(ask_size)
    return F.when(total > EPS, F.try_divide(c(bid) * c(ask_size) + c(ask) * c(bid_size), total)).otherwise(mid_price(bid, ask))


def imbalance(bid, ask) -> Column:
    return safe_divide(c(bid) - c(ask), c(bid) + c(ask))


def log_return_bps(exit_price, entry_price) -> Column:
    """1e4 ln(exit / entry); null unless both are positive."""
    x, e = c(exit_price).cast("double"), c(entry_price).cast("double")
    return F.when((x > 0) & (e > 0), 1e4 * F.log(x / e))


def sigmoid(z) -> Column:
    """The logistic function, from the side on which the exponential stays small."""
    z = c(z)
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def to_tick(price, tick_size: float) -> Column:
    """The nearest tick, halves to even."""
    return F.rint(c(price) / F.lit(tick_size)).cast("long")


def floor_step(qty, step: float) -> Column:
    """Quantity down to a whole number of steps."""
    return F.floor(c(qty) / F.lit(step) + EPS) * F.lit(step)


def valid_qty(qty, step: float, low: float, high: float) -> Column:
    """Within bounds and a whole number of steps, up to a tolerance that grows with the step."""
    q = c(qty)
    return (q >= low) & (q <= high) & (F.abs(q - F.rint(q / step) * step) <= max(1e-12, step * 1e-9))


def valid_notional(qty, tick, tick_size: float, least: float) -> Column:
    return c(qty) * c(tick) * F.lit(tick_size) >= least - EPS


# arrays: ladders of prices and sizes, best level first


def sum_first(values, n: int) -> Column:
    return F.aggregate(F.slice(c(values), 1, n), F.lit(0.0), lambda s, v: s + v)


def notional_first(prices, sizes, n: int) -> Column:
    return sum_first(F.zip_with(c(prices), c(sizes), lambda p, s: p * s), n)


def _distance_bps(price: Column, mid: Column, side_code: int) -> Column:
    """How far a level is from mid, outwards: bids (1) below, asks (-1) above."""
    return (mid - price) / mid * 1e4 if side_code > 0 else (price - mid) / mid * 1e4


def depth_within_bps(prices, sizes, mid, side_code: int, bps: float, notional: bool = False) -> Column:
    """Size, or notional, of the levels within a band of mid; 0 without a mid price."""
    m = c(mid)
    kept = F.zip_with(c(prices), c(sizes), lambda p, s: F.when(_distance_bps(p, m, side_code) <= bps + EPS, p * s if notional else s).otherwise(0.0))
    return F.when(m > EPS, F.aggregate(kept, F.lit(0.0), lambda a, v: a + v)).otherwise(F.lit(0.0))


def depth_centroid_bps(prices, sizes, mid, side_code: int, most_bps: float) -> Column:
    """Mean distance from mid weighted by size, over levels within a band."""
    m = c(mid)
    pairs = F.zip_with(c(prices), c(sizes), lambda p, s: F.struct(_distance_bps(p, m, side_code).alias("d"), s.alias("s")))
    near = F.filter(pairs, lambda x: x["d"] <= most_bps + EPS)
    weight = F.aggregate(near, F.lit(0.0), lambda a, x: a + x["s"])
    moment = F.aggregate(near, F.lit(0.0), lambda a, x: a + x["s"] * x["d"])
    return F.when(m > EPS, safe_divide(moment, weight)).otherwise(F.lit(0.0))


def liquidity_void_bps(prices, sizes, mid, side_code: int, least: float) -> Column:
    """Distance of the first level with at least so much size; 0 if there is none."""
    m = c(mid)
    pairs = F.zip_with(c(prices), c(sizes), lambda p, s: F.struct(_distance_bps(p, m, side_code).alias("d"), s.alias("s")))
    first = F.get(F.filter(pairs, lambda x: x["s"] >= least), F.lit(0))["d"]
    return F.coalesce(first, F.lit(0.0))


# quotes and signals


def quote_mode(bid: Column, ask: Column) -> Column:
    return F.when(bid & ask, "two_sided").when(bid, "bid_only").when(ask, "ask_only").otherwise("no_quote")


def quote_mode_id(bid: Column, ask: Column) -> Column:
    return F.when(bid & ask, 3).when(bid, 1).when(ask, 2).otherwise(0)


def candidate_tick(candidate: str, side_code: int, bid, ask, gap: int = 1) -> Column:
    """Price of a quote candidate (touch, inside_k or away_k), or null where it would take liquidity."""
    name, _, k = candidate.partition("_")
    move = {"touch": 0, "inside": int(k or 0), "away": -int(k or 0)}[name]
    b, a = c(bid), c(ask)
    price = b + move if side_code > 0 else a - move
    return F.when(price <= a - gap, price) if side_code > 0 else F.when(price >= b + gap, price)


def post_only_safe(side_code, price_tick, bid, ask, gap: int = 1) -> Column:
    return F.when(c(side_code) > 0, c(price_tick) <= c(ask) - gap).otherwise(c(price_tick) >= c(bid) + gap)


def ewma_alpha(dt_us, half_life_us: float) -> Column:
    """The weight of a new value after so long: one half after a half-life, none at once."""
    return 1 - F.pow(F.lit(2.0), -c(dt_us) / F.lit(float(half_life_us)))


def base_transform(x, kind: str) -> Column:
    """A raw feature on its scale: what is no finite number is 0, and every scale has its bounds."""
    x = finite_or_zero(x)
    if kind.startswith("identity"):
        return clip(x, -1e9, 1e9)
    if kind.startswith(("log1p_pos", "time_log1p")):
        return F.log1p(F.greatest(x, F.lit(0.0)))
    if kind.startswith("signed_log1p"):
        return signed_log1p(x)
    if kind.startswith("ratio"):
        return clip(x, -10.0, 10.0)
    return clip(x, -1.0, 1.0)


def gated_signal(p_no_move, p_up, mag_up, mag_down) -> dict[str, Column]:
    """Probabilities of a move up and down, and the moments of the move that they imply, in basis points."""
    quiet, up = c(p_no_move), c(p_up)
    u, d = F.expm1(F.greatest(c(mag_up), F.lit(0.0))), F.expm1(F.greatest(c(mag_down), F.lit(0.0)))
    move = 1 - quiet
    p_u, p_d = move * up, move * (1 - up)
    mean = p_u * u - p_d * d
    square = p_u * u * u + p_d * d * d
    return {
        "p_move": move,
        "p_up_move": p_u,
        "p_down_move": p_d,
        "signed_move_prob": p_u - p_d,
        "expected_up_bps": p_u * u,
        "expected_down_bps": p_d * d,
        "expected_return_bps": mean,
        "expected_abs_move_bps": p_u * u + p_d * d,
        "predicted_vol_bps": F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))),
        "confidence": F.abs(p_u - p_d),
    }


def linear_targets(ret_bps, deadband: float = 0.0) -> dict[str, Column]:
    """Whether there is a move beyond the deadband, its direction, and its log1p size on either side."""
    r = c(ret_bps)
    still = F.abs(r) <= deadband
    return {
        "no_move": F.when(still, 1).otherwise(0),
        "direction": F.when(still, 0).when(r > 0, 1).otherwise(-1),
        "magnitude_up": F.when(~still & (r > 0), F.log1p(r)),
        "magnitude_down": F.when(~still & (r < 0), F.log1p(-r)),
    }
