"""Causal features of book, trades and both, as range windows over the tape.

Windows are named by microseconds; ``scale`` stretches them for sparse tapes, while rates stay per nominal second. Every
frame is ordered by ``key2``, so an event at the same microsecond but later in the tape is never seen. Windows hold all
their rows: there is no ring buffer that would drop any. No frame is read row by row: sums are differences of running
sums, neighbours within a frame are pairs counted up to now less those up to its first row, and maxima are put together
from two stretches as long as the frame. So the work grows with the rows, not with how many a frame holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import kernels as k
from tidebook.operators import ordered as o

EPS = k.EPS
BY = ["symbol_id"]

#: The features in the order of the schema.
FEATURES = (
    "mid_slope_bps_per_sec_1000000us", "time_since_mid_change_us", "bid_l1_notional_usd", "ask_l1_notional_usd",
    "total_depth_notional_5bps", "obi_l1", "ofi_l10_sum_over_depth_1000000us", "micro_l10_minus_mid_bps",
    "ask_depth_within_1bps", "depth_imbalance_within_1bps", "ask_l1_depletion_over_depth_200000us", "ask_l1_depletion_500000us",
    "bid_price_change_rate_1000000us", "bid_l1_depletion_1000000us", "bid_l1_depletion_over_depth_1000000us",
    "ask_l1_depletion_over_depth_1000000us", "ob_update_rate_200000us", "ob_update_rate_500000us",
    "bid_l1_rem_rate_over_depth_200000us", "trade_count_per_second_200000us", "trade_imbalance_notional_500000us",
    "trade_count_per_second_500000us", "zero_tick_fraction_1000000us", "trade_count_per_second_1000000us",
    "time_since_last_buy_trade_us", "time_since_last_sell_trade_us", "max_signed_trade_notional_usd_1000000us",
    "absorption_bid_1000000us", "absorption_ask_1000000us", "depth_imbalance_5bps_slope_1000000us",
    "depth_imbalance_5bps_slope_3000000us", "ofi_l1_pressure_over_realized_vol_1000000us", "microprice_zero_cross_rate_1000000us",
    "l1_churn_over_depth_1000000us", "same_side_trade_cluster_notional_1000000us", "touch_flicker_score_3000000us",
    "spread_state_transition_rate_3000000us", "max_trade_silence_gap_3000000us", "microprice_realized_vol_1000000us",
    "trade_sign_entropy_3000000us", "best_bid_size_age_us", "best_ask_size_age_us", "trade_side_quote_response_asymmetry_500000us",
    "near_touch_depth_drop_asymmetry", "log_events_200000us", "log_events_500000us", "log_events_1000000us", "log_events_3000000us",
)


def windows_of(name: str) -> list[int]:
    """The windows, in microseconds, that a feature's name speaks of."""
    import re

    return [int(x) for x in re.findall(r"_(\d+)us(?:_|$)", name)]


def _ladder_ofi(side: str, sign: int) -> Column:
    """Order-flow imbalance of each level against the row before, summed: what came in counts for the side, what left against."""
    px, sz, ppx, psz = (F.col(f"{p}{side}_{x}") for p in ("", "prev_") for x in ("px", "sz"))
    new, old = F.arrays_zip(px.alias("p"), sz.alias("s")), F.arrays_zip(ppx.alias("p"), psz.alias("s"))

    def level(a: Column, b: Column) -> Column:
        better = (a["p"] > b["p"]) if sign > 0 else (a["p"] < b["p"])
        return F.when(better, a["s"]).when(a["p"] == b["p"], a["s"] - b["s"]).otherwise(-b["s"])

    flows = F.zip_with(new, old, level)
    return F.when(ppx.isNotNull(), F.aggregate(flows, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))).otherwise(F.lit(0.0))


def book_changes(quotes: DataFrame) -> DataFrame:
    """Quotes with what changed since the quote before: flags, size added and removed at the touch, order-flow imbalance.

    ``quotes`` has symbol_id, event_id, local_ts_us, mid and the ladders bid_px, bid_sz, ask_px, ask_sz.
    """
    q = quotes.withColumns({"b0": F.col("bid_px")[0], "a0": F.col("ask_px")[0], "bs0": F.col("bid_sz")[0], "as0": F.col("ask_sz")[0]})
    q = o.previous(q, BY, "local_ts_us", ["event_id"], ["b0", "a0", "bs0", "as0", "mid", "bid_px", "bid_sz", "ask_px", "ask_sz"])
    first = F.col("prev_b0").isNull()
    zero = F.lit(0.0)

    def added_removed(side: str, sign: int) -> tuple[Column, Column]:
        p, s = ("b0", "bs0") if side == "bid" else ("a0", "as0")
        gain = (F.col(p) - F.col(f"prev_{p}")) * sign
        change = F.col(s) - F.col(f"prev_{s}")
        add = F.when(first, zero).when(gain > 0, F.col(s)).when(gain == 0, F.greatest(change, zero)).otherwise(zero)
        rem = F.when(first, zero).when(gain < 0, F.col(f"prev_{s}")).when(gain == 0, F.greatest(-change, zero)).otherwise(zero)
        return add, rem

    (bid_add, bid_rem), (ask_add, ask_rem) = added_removed("bid", 1), added_removed("ask", -1)
    flag = lambda c: F.when(first, F.lit(0)).when(c, 1).otherwise(0)
    changed = lambda *names: first | F.greatest(*(F.when(F.col(n) != F.col(f"prev_{n}"), 1).otherwise(0) for n in names), F.lit(0)).cast("boolean")
    at = lambda c: F.when(c, F.col("local_ts_us"))
    q = q.withColumns({
        "bid_add": bid_add, "bid_rem": bid_rem, "ask_add": ask_add, "ask_rem": ask_rem,
        "ofi_l1": bid_add - bid_rem - ask_add + ask_rem,
        "ofi_l10": _ladder_ofi("bid", 1) - _ladder_ofi("ask", -1),
        "bid_px_changed": flag(F.col("b0") != F.col("prev_b0")), "ask_px_changed": flag(F.col("a0") != F.col("prev_a0")),
        "spread_changed": flag(F.col("a0") - F.col("b0") != F.col("prev_a0") - F.col("prev_b0")),
    })
    return o.last_where(q, BY, "local_ts_us", ["event_id"], {
        "mid_changed_at": at(first | (F.abs(F.col("mid") - F.col("prev_mid")) > EPS)),
        "bid_size_changed_at": at(changed("b0", "bs0")), "ask_size_changed_at": at(changed("a0", "as0")),
    })


def _slope(w: o.Frames, us: int, value: str, relative: bool) -> Column:
    """Change from the first to the last value of a frame, a second; 0 if it has less than two rows or no time passed."""
    x0, x1 = w.first(us)[value], w.last(value)
    seconds = (w.last("local_ts_us") - w.first(us)["local_ts_us"]) / 1e6
    change = (x1 / x0 - 1) * 1e4 if relative else x1 - x0
    return F.when((w.count(F.lit(True), us) >= 2) & (seconds > EPS), change / seconds).otherwise(F.lit(0.0))


def pair_sums(laid: DataFrame, w: o.Frames, price: str) -> DataFrame:
    """Running figures of the returns of ``price`` from row to row, in basis points: pairs, pairs that move, sums and squares."""
    upto = w.rows.rowsBetween(Window.unboundedPreceding, 0)
    laid = laid.withColumn("__r", (F.col(price) / F.lag(price).over(w.rows) - 1) * 1e4)
    moved = F.when(F.col("__r") != 0, 1).otherwise(0)
    sums = {"pairs": F.count("__r"), "moves": F.sum(moved), "returns": F.sum(F.coalesce("__r", F.lit(0.0))), "squares": F.sum(F.coalesce(F.col("__r") * F.col("__r"), F.lit(0.0)))}
    return laid.withColumns({n: x.over(upto) for n, x in sums.items()}).drop("__r")


PAIR_SUMS = ["pairs", "moves", "returns", "squares"]


def realized_vol(w: o.Frames, us: int) -> Column:
    """Population deviation of successive returns in a frame, from ``pair_sums``; 0 with fewer than two, or if nothing moves."""
    n, moves, s, q = (w.last(x) - w.first(us)[x] for x in PAIR_SUMS)
    variance = F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))
    return F.when((n > 1) & (moves > 0), F.sqrt(variance)).otherwise(F.lit(0.0))


def flip_sums(laid: DataFrame, w: o.Frames, value: str) -> DataFrame:
    """Running number of sign changes between neighbours, zeros left out: ``flips`` so far, ``flips_at`` the first row from here on that isn't zero."""
    sign = F.signum(value)
    some = F.when(sign != 0, sign)
    before = F.last(some, ignorenulls=True).over(w.rows.rowsBetween(Window.unboundedPreceding, -1))
    laid = laid.withColumns({"__sign": some, "__flip": F.when(some != before, 1).otherwise(0)})
    laid = laid.withColumn("flips", F.sum("__flip").over(w.rows.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = F.last(F.when(F.col("__sign").isNotNull(), F.col("flips")), ignorenulls=True).over(w.back.rowsBetween(Window.unboundedPreceding, 0))
    return laid.withColumn("flips_at", ahead).drop("__sign", "__flip")


def sign_flips(w: o.Frames, us: int) -> Column:
    """How often neighbours in a frame differ in sign, zeros left out, from ``flip_sums``."""
    return F.coalesce(F.greatest(w.last("flips") - w.first(us)["flips_at"], F.lit(0)), F.lit(0)).cast("double")


def book_features(quotes: DataFrame, scale: int = 1, slice_us: int = o.SLICE_US) -> DataFrame:
    """Quotes with the features that the book alone gives."""
    q = book_changes(quotes)
    size = lambda s, bps: k.depth_within_bps(f"{s}_px", f"{s}_sz", "mid", 1 if s == "bid" else -1, bps)
    notional = lambda s: k.depth_within_bps(f"{s}_px", f"{s}_sz", "mid", 1 if s == "bid" else -1, 5.0, True)
    b10, a10 = k.sum_first("bid_sz", 10), k.sum_first("ask_sz", 10)
    top = lambda s: safe_mean(k.notional_first(f"{s}_px", f"{s}_sz", 10), k.sum_first(f"{s}_sz", 10))
    q = q.withColumns({
        "bid_1bps": F.greatest(size("bid", 1.0), F.lit(EPS)), "ask_1bps": F.greatest(size("ask", 1.0), F.lit(EPS)),
        "size_5bps": size("bid", 5.0) + size("ask", 5.0), "bid_n5": notional("bid"), "ask_n5": notional("ask"),
        "micro": k.microprice(top("bid"), top("ask"), b10, a10),
    })
    # depth at the touch in two parts, as a running sum of large values would swallow the floor
    floor = lambda s: F.col(f"{s}_1bps") <= EPS
    near = {"near_1bps": sum(F.when(floor(s), 0.0).otherwise(F.col(f"{s}_1bps")) for s in ("bid", "ask")), "floors_1bps": sum(floor(s).cast("double") for s in ("bid", "ask"))}
    q = q.withColumns({"imb5": k.imbalance("bid_n5", "ask_n5"), "micro_gap": F.col("micro") - F.col("mid"), **near})
    now, order = F.col("local_ts_us"), 2 * F.col("local_ts_us")

    def prepare(laid: DataFrame, w: o.Frames) -> DataFrame:
        return flip_sums(pair_sums(laid, w, "micro"), w, "micro_gap")

    def columns(w: o.Frames) -> dict[str, Column]:
        total = lambda x, u: w.total(x, u * scale)
        count = lambda u: w.count(F.lit(True), u * scale)
        drop_a, drop_b = total("ask_rem", 200_000), total("bid_rem", 200_000)
        churn = total(F.col("bid_add") + F.col("bid_rem") + F.col("ask_add") + F.col("ask_rem"), 1_000_000)
        return {
            "mid_slope_bps_per_sec_1000000us": _slope(w, 1_000_000 * scale, "mid", True),
            "time_since_mid_change_us": now - F.col("mid_changed_at"),
            "bid_l1_notional_usd": F.col("b0") * F.col("bs0"),
            "ask_l1_notional_usd": F.col("a0") * F.col("as0"),
            "total_depth_notional_5bps": F.col("bid_n5") + F.col("ask_n5"),
            "obi_l1": k.imbalance("bs0", "as0"),
            "ofi_l10_sum_over_depth_1000000us": total("ofi_l10", 1_000_000) / F.greatest("size_5bps", F.lit(EPS)),
            "micro_l10_minus_mid_bps": k.bps_change("micro", "mid"),
            "ask_depth_within_1bps": F.col("ask_1bps"),
            "depth_imbalance_within_1bps": k.imbalance("bid_1bps", "ask_1bps"),
            "ask_l1_depletion_over_depth_200000us": drop_a / F.col("ask_1bps"),
            "ask_l1_depletion_500000us": total("ask_rem", 500_000),
            "bid_price_change_rate_1000000us": total("bid_px_changed", 1_000_000).cast("double"),
            "bid_l1_depletion_1000000us": total("bid_rem", 1_000_000),
            "bid_l1_depletion_over_depth_1000000us": total("bid_rem", 1_000_000) / F.col("bid_1bps"),
            "ask_l1_depletion_over_depth_1000000us": total("ask_rem", 1_000_000) / F.col("ask_1bps"),
            "ob_update_rate_200000us": count(200_000) / 0.2,
            "ob_update_rate_500000us": count(500_000) / 0.5,
            "bid_l1_rem_rate_over_depth_200000us": drop_b / (0.2 * F.col("bid_1bps")),
            "depth_imbalance_5bps_slope_1000000us": _slope(w, 1_000_000 * scale, "imb5", False),
            "depth_imbalance_5bps_slope_3000000us": _slope(w, 3_000_000 * scale, "imb5", False),
            "microprice_zero_cross_rate_1000000us": sign_flips(w, 1_000_000 * scale),
            "l1_churn_over_depth_1000000us": churn / F.greatest((total("near_1bps", 1_000_000) + EPS * total("floors_1bps", 1_000_000)) / count(1_000_000), F.lit(EPS)),
            "touch_flicker_score_3000000us": total(F.col("bid_px_changed") + F.col("ask_px_changed"), 3_000_000) / count(3_000_000),
            "spread_state_transition_rate_3000000us": total("spread_changed", 3_000_000) / 3.0,
            "microprice_realized_vol_1000000us": realized_vol(w, 1_000_000 * scale),
            "best_bid_size_age_us": now - F.col("bid_size_changed_at"),
            "best_ask_size_age_us": now - F.col("ask_size_changed_at"),
            "near_touch_depth_drop_asymmetry": k.safe_divide(drop_a - drop_b, drop_a + drop_b),
        }

    carried = ["local_ts_us", "mid", "imb5", *PAIR_SUMS, "flips_at"]
    return o.range_features(q, BY, "local_ts_us", order, 3_000_000 * scale, columns, slice_us, prepare=prepare, carried=carried).drop(*PAIR_SUMS, "flips", "flips_at")


def safe_mean(total: Column, weight: Column) -> Column:
    return F.when(weight > EPS, F.try_divide(total, weight)).otherwise(F.lit(0.0))


def trade_stretches(laid: DataFrame, w: o.Frames, run_us: int, gap_us: int) -> DataFrame:
    """What extremes of neighbouring trades in a frame are put together from.

    ``next_trade`` has, for the first trade from a row on: its time; of its run of one side the number, what the run had
    before the trade, and its whole; its stretches of ``run_us`` and ``gap_us``; and the best that comes after it in
    them: the largest notional, the longest later run, the widest later gap. ``run``, ``side_run`` and the ``so_far_``
    columns are the same from the start of the stretch to a row, the ``else_`` columns without the stretch's first run or trade.
    """
    trade, start = F.col("is_trade") == 1, Window.unboundedPreceding
    upto, side = w.rows.rowsBetween(start, 0), F.col("side_code")
    before = F.last(F.when(trade, F.struct("local_ts_us", "side_code")), ignorenulls=True).over(w.rows.rowsBetween(start, -1))
    laid = laid.withColumn("__before", before).withColumns({"run_block": w.block(run_us), "gap_block": w.block(gap_us)})
    fresh = trade & (F.col("__before").isNull() | (side == 0) | (side != F.col("__before.side_code")))
    laid = laid.withColumns({"gap": F.when(trade, F.col("local_ts_us") - F.col("__before.local_ts_us")), "run": F.sum(F.when(fresh, 1).otherwise(0)).over(upto)})
    own = Window.partitionBy(*w.by, "__slice", "run").orderBy("__order", "event_id")
    counted = F.when(trade & (side != 0), F.col("notional")).otherwise(F.lit(0.0))
    laid = laid.withColumns({"side_run": F.when(trade, F.sum(counted).over(own.rowsBetween(start, 0))), "whole": F.sum(counted).over(own.rowsBetween(start, Window.unboundedFollowing)), "had": F.sum(counted).over(own.rowsBetween(start, 0)) - counted})
    # the stretch's first run and first trade
    first = lambda value, block: F.min(F.when(trade, value)).over(w.in_block(block).rangeBetween(start, 0))
    laid = laid.withColumns({"first_run": first(F.col("run"), "run_block"), "first_trade": first(w.key, "gap_block")})
    signed = F.signum(side) * F.col("notional")
    large = F.when(trade, F.struct(F.abs(signed).alias("size"), (-F.col("local_ts_us")).alias("t"), (-F.col("event_id")).alias("e"), signed.alias("signed")))
    later_runs = Window.partitionBy(*w.by, "__slice", "run_block").orderBy(F.desc("run")).rangeBetween(start, -1)
    later_rows = Window.partitionBy(*w.by, "__slice", "gap_block").orderBy(F.desc("__order"), F.desc("event_id")).rowsBetween(start, -1)
    laid = laid.withColumns({
        "__large": F.max(large).over(w.in_block("run_block", True).rangeBetween(start, 0)),
        "__later_run": F.max("side_run").over(later_runs), "__later_gap": F.max("gap").over(later_rows),
        "so_far_large": F.max(large).over(w.in_block("run_block").rangeBetween(start, 0)),
        "so_far_run": F.max("side_run").over(w.in_block("run_block").rangeBetween(start, 0)),
        "else_run": F.max(F.when(F.col("run") != F.col("first_run"), F.col("side_run"))).over(w.in_block("run_block").rangeBetween(start, 0)),
        "so_far_gap": F.max("gap").over(w.in_block("gap_block").rangeBetween(start, 0)),
        "else_gap": F.max(F.when(w.key != F.col("first_trade"), F.col("gap"))).over(w.in_block("gap_block").rangeBetween(start, 0)),
    })
    held = F.struct("local_ts_us", "__order", "run", "had", "whole", "run_block", "gap_block", F.col("__large").alias("large"), F.col("__later_run").alias("later_run"), F.col("__later_gap").alias("later_gap"))
    ahead = F.last(F.when(trade, held), ignorenulls=True).over(w.back.rowsBetween(start, 0))
    return laid.withColumn("next_trade", ahead)


def largest_trade(w: o.Frames, us: int) -> Column:
    """The signed notional of the largest trade in a frame, of equal ones the earliest; 0 without trades."""
    t = w.first(us)["next_trade"]
    old = F.when((t["run_block"] < F.col("run_block")) & (t["__order"] <= F.col("__order")), t["large"])
    return F.coalesce(F.greatest(old, w.last("so_far_large"))["signed"], F.lit(0.0))


def longest_run(w: o.Frames, us: int) -> Column:
    """The largest notional of neighbouring trades of one side in a frame; a trade without a side ends a run."""
    t = w.first(us)["next_trade"]
    now = F.max_by(F.struct("run", "side_run"), F.when(F.col("is_trade") == 1, w.key)).over(w.upto)  # the last trade
    rest = F.when(t["run"] == w.last("first_run"), w.last("else_run")).otherwise(w.last("so_far_run"))
    later = F.when(t["run_block"] < F.col("run_block"), t["later_run"])
    several = F.greatest(t["whole"] - t["had"], later, rest)
    best = F.when(now["run"] == t["run"], now["side_run"] - t["had"]).otherwise(several)
    return F.when(t["__order"] <= F.col("__order"), best).otherwise(F.lit(0.0))


def widest_gap(w: o.Frames, us: int) -> Column:
    """The longest time between neighbouring trades in a frame; 0 with fewer than two."""
    t = w.first(us)["next_trade"]
    old = t["gap_block"] < F.col("gap_block")
    gap = F.when(old, F.greatest(t["later_gap"], w.last("so_far_gap"))).otherwise(w.last("else_gap"))
    return F.when(t["__order"] <= F.col("__order"), F.coalesce(gap, F.lit(0))).otherwise(F.lit(0))


TRADE_FEATURES = tuple(n for n in FEATURES if n.startswith(("trade_count", "trade_imb", "zero_tick", "time_since_last", "max_", "same_side", "trade_sign")))


def sign_entropy(buys: Column, sells: Column, other: Column) -> Column:
    """Entropy of trade sides as a share of the largest, 0 without trades."""
    n = buys + sells + other
    part = lambda x: F.when(x > 0, -(x / n) * F.log2(x / n)).otherwise(F.lit(0.0))
    return F.when(n > 0, (part(buys) + part(sells) + part(other)) / F.log2(F.lit(3.0))).otherwise(F.lit(0.0))


def trade_features(tape: DataFrame, scale: int = 1, slice_us: int = o.SLICE_US) -> DataFrame:
    """All events of the tape with the features of trades up to each: 0 until the first trade.

    ``tape`` has symbol_id, event_id, local_ts_us, is_trade, side_code, price (a number) and amount; quotes have any side.
    """
    trade = F.col("is_trade") == 1
    t = o.previous(tape.where(trade), BY, "local_ts_us", ["event_id"], ["price"])
    t = t.withColumn("tick_sign", F.coalesce(F.signum(F.col("price") - F.col("prev_price")), F.lit(0.0))).drop("prev_price")
    both = t.unionByName(tape.where(~trade), allowMissingColumns=True)
    side = F.col("side_code")
    both = o.last_where(both, BY, "local_ts_us", ["is_trade", "event_id"], {"buy_at": F.when(trade & (side > 0), F.col("local_ts_us")), "sell_at": F.when(trade & (side < 0), F.col("local_ts_us")), "trade_at": F.when(trade, F.col("local_ts_us"))})
    both = both.withColumn("notional", F.when(trade, F.col("price") * F.col("amount")))
    now = F.col("local_ts_us")

    def columns(w: o.Frames) -> dict[str, Column]:
        count = lambda cond, u: w.count(trade & cond, u * scale)
        of = lambda cond, u: w.total(F.when(trade & cond, F.col("notional")), u * scale)
        every = F.lit(True)
        buy, sell = of(side > 0, 500_000), of(side < 0, 500_000)
        n1 = count(every, 1_000_000)
        return {
            "trade_count_per_second_200000us": count(every, 200_000) / 0.2,
            "trade_imbalance_notional_500000us": k.safe_divide(buy - sell, buy + sell),
            "trade_count_per_second_500000us": count(every, 500_000) / 0.5,
            "zero_tick_fraction_1000000us": k.safe_divide(count(F.col("tick_sign") == 0, 1_000_000), n1),
            "trade_count_per_second_1000000us": n1 / 1.0,
            "time_since_last_buy_trade_us": F.coalesce(now - F.col("buy_at"), F.lit(0)),
            "time_since_last_sell_trade_us": F.coalesce(now - F.col("sell_at"), F.lit(0)),
            "max_signed_trade_notional_usd_1000000us": largest_trade(w, 1_000_000 * scale),
            "same_side_trade_cluster_notional_1000000us": longest_run(w, 1_000_000 * scale),
            "max_trade_silence_gap_3000000us": widest_gap(w, 3_000_000 * scale),
            "trade_sign_entropy_3000000us": sign_entropy(count(side > 0, 3_000_000), count(side < 0, 3_000_000), count(side == 0, 3_000_000)),
        }

    prepare = lambda laid, w: trade_stretches(laid, w, 1_000_000 * scale, 3_000_000 * scale)
    names = [*both.columns, *TRADE_FEATURES]
    return o.range_features(both, BY, "local_ts_us", o.key2(), 3_000_000 * scale, columns, slice_us, prepare=prepare, carried=["next_trade"]).select(*names)


def cross_features(tape: DataFrame, quotes: DataFrame, scale: int = 1, slice_us: int = o.SLICE_US) -> DataFrame:
    """Quotes with the features of book and trades together, and of how many events there were."""
    q = book_changes(quotes)
    b10, a10 = k.sum_first("bid_sz", 10), k.sum_first("ask_sz", 10)
    top = lambda s: safe_mean(k.notional_first(f"{s}_px", f"{s}_sz", 10), k.sum_first(f"{s}_sz", 10))
    size5 = k.depth_within_bps("bid_px", "bid_sz", "mid", 1, 5.0) + k.depth_within_bps("ask_px", "ask_sz", "mid", -1, 5.0)
    q = q.withColumns({"micro": k.microprice(top("bid"), top("ask"), b10, a10), "size_5bps": size5, "is_trade": F.lit(0), "side_code": F.lit(0), "qty": F.lit(0.0)})
    # the book's own figure first, over quotes alone: frames of both streams hold the same quotes
    span, twice = 1_000_000 * scale, 2 * F.col("local_ts_us")
    q = o.range_features(q, BY, "local_ts_us", twice, span, lambda w: {"vol": realized_vol(w, span)}, slice_us, prepare=lambda laid, w: pair_sums(laid, w, "micro"), carried=PAIR_SUMS)
    parts = ["bid_add", "bid_rem", "ask_add", "ask_rem", "ofi_l1", "vol", "size_5bps"]
    t = tape.where("is_trade = 1").withColumn("qty", F.col("amount"))
    keys = ["symbol_id", "event_id", "local_ts_us", "is_trade", "side_code", "qty"]
    both = q.select(*keys, *parts).unionByName(t.select(*keys), allowMissingColumns=True)

    def columns(w: o.Frames) -> dict[str, Column]:
        total = lambda x, u: w.total(x, u * scale)
        bought = lambda u: total(F.when(F.col("side_code") > 0, F.col("qty")), u)
        sold = lambda u: total(F.when(F.col("side_code") < 0, F.col("qty")), u)
        share = lambda x, u: k.safe_divide(x, bought(u) + sold(u))
        refill = lambda s, u: k.safe_divide(total(f"{s}_add", u), total(f"{s}_add", u) + total(f"{s}_rem", u))
        pressure = total("ofi_l1", 1_000_000) / F.greatest("size_5bps", F.lit(EPS))
        return {
            "absorption_bid_1000000us": share(sold(1_000_000), 1_000_000) * refill("bid", 1_000_000),
            "absorption_ask_1000000us": share(bought(1_000_000), 1_000_000) * refill("ask", 1_000_000),
            "ofi_l1_pressure_over_realized_vol_1000000us": k.safe_divide(pressure, F.col("vol")),
            "trade_side_quote_response_asymmetry_500000us": share(bought(500_000), 500_000) * refill("ask", 500_000) - share(sold(500_000), 500_000) * refill("bid", 500_000),
            **{f"log_events_{u}us": F.log1p(w.count(F.lit(True), u * scale).cast("double")) for u in (200_000, 500_000, 1_000_000, 3_000_000)},
        }

    return o.range_features(both, BY, "local_ts_us", o.key2(), 3_000_000 * scale, columns, slice_us).where("is_trade = 0")
