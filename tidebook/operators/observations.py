"""What a policy sees of a decision, as columns in the order of the schema, and quotes from its actions with the reasons against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.kernels import EPS, c, floor_step, sigmoid, valid_notional

#: The fields of an observation in the order of the schema.
MARKET = ("spread_ticks", "spread_bps", "mid_price", "microprice_bps", "top_imbalance", "bid_depth_count", "ask_depth_count", "bid_top_size", "ask_top_size")
CONTROL = (
    "depth_bid_qty_5", "depth_ask_qty_5", "depth_imbalance_5",
    "flow_signed_qty_200ms", "flow_abs_qty_200ms", "flow_trade_count_200ms", "flow_imbalance_ratio_200ms",
    "flow_signed_qty_500ms", "flow_abs_qty_500ms", "flow_trade_count_500ms", "flow_imbalance_ratio_500ms",
    "flow_signed_qty_1000ms", "flow_abs_qty_1000ms", "flow_trade_count_1000ms", "flow_imbalance_ratio_1000ms",
    "bid_touch_depletion_ratio_1000ms", "ask_touch_depletion_ratio_1000ms", "bid_touch_replenishment_ratio_1000ms", "ask_touch_replenishment_ratio_1000ms",
    "recent_mid_return_bps_200ms", "recent_mid_return_bps_1000ms",
)
SIGNAL = (
    "linear_p_no_move", "linear_p_move", "linear_p_up_move", "linear_p_down_move", "linear_signed_move_prob", "linear_expected_up_bps",
    "linear_expected_down_bps", "linear_expected_return_bps", "linear_expected_abs_move_bps", "linear_predicted_vol_bps", "linear_confidence",
)
POSITION = ("cash", "inventory_qty", "inventory_notional", "inventory_order_units", "equity", "inventory_abs_notional", "fees_paid")
ORDERS = (
    "has_live_bid", "has_live_ask", "bid_distance_ticks", "ask_distance_ticks", "bid_distance_bps", "ask_distance_bps", "bid_qty", "ask_qty",
    "bid_remaining_qty", "ask_remaining_qty", "bid_queue_ahead_qty", "ask_queue_ahead_qty", "bid_age_ms", "ask_age_ms",
)
FILLS = ("last_fill_side", "last_fill_qty", "last_fill_notional", "last_fill_fee", "last_fill_age_ms", "step_fill_count", "step_buy_fill_qty", "step_sell_fill_qty", "step_fill_notional")
TIME = ("local_time_since_start_s", "time_since_last_event_ms")
FIELDS = (*MARKET, *CONTROL, *SIGNAL, *POSITION, *ORDERS, *FILLS, *TIME)


def observations(rows: DataFrame, keep: list[str], tick_size: float, contract: float = 1.0, unit_qty: float = 0.003, most: float | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and the fields, each a finite number, bounded by ``most`` if given.

    A row has the touch (best_bid_tick, best_ask_tick, bid_sz, ask_sz) and numbers of levels (bid_levels, ask_levels),
    local_ts_us, start_ts_us and prev_ts_us (null at the first event), cash, inventory_qty, fees_paid, the live orders as
    structs bid_order and ask_order (price_tick, qty, remaining, queue, created_us; null if there is none), and the step's
    fills as an array of structs (local_ts_us, side_code, price_tick, qty, fee) in order. Control, signal and ``extra`` fields
    are columns of the same name; one that a table lacks is 0.
    """
    mid = (c("best_bid_tick") + c("best_ask_tick")) * 0.5 * tick_size
    now, size = c("local_ts_us"), c("bid_sz") + c("ask_sz")
    gap = c("best_ask_tick") - c("best_bid_tick")
    micro = (c("best_bid_tick") * c("ask_sz") + c("best_ask_tick") * c("bid_sz")) * tick_size / size
    some = size > EPS
    held = c("inventory_qty") * mid * contract
    out: dict[str, Column] = {
        "spread_ticks": gap, "spread_bps": gap * tick_size / mid * 1e4, "mid_price": mid,
        "microprice_bps": F.when(some, (micro - mid) / mid * 1e4), "top_imbalance": F.when(some, (c("bid_sz") - c("ask_sz")) / size),
        "bid_depth_count": c("bid_levels"), "ask_depth_count": c("ask_levels"), "bid_top_size": c("bid_sz"), "ask_top_size": c("ask_sz"),
        "cash": c("cash"), "inventory_qty": c("inventory_qty"), "inventory_notional": held, "inventory_order_units": c("inventory_qty") / max(unit_qty, EPS),
        "equity": c("cash") + held, "inventory_abs_notional": F.abs(held), "fees_paid": c("fees_paid"),
    }
    for side, away in (("bid", c("best_bid_tick") - c("bid_order.price_tick")), ("ask", c("ask_order.price_tick") - c("best_ask_tick"))):
        order, away = f"{side}_order", F.greatest(away, F.lit(0))
        there = c(order).isNotNull()
        out |= {f"has_live_{side}": there.cast("int"), f"{side}_distance_ticks": F.when(there, away), f"{side}_distance_bps": F.when(there, away * tick_size / mid * 1e4)}
        out |= {f"{side}_qty": c(f"{order}.qty"), f"{side}_remaining_qty": c(f"{order}.remaining"), f"{side}_queue_ahead_qty": c(f"{order}.queue")}
        out[f"{side}_age_ms"] = F.when(there, F.greatest(now - c(f"{order}.created_us"), F.lit(0)) / 1000)
    notional = lambda x: x["qty"] * x["price_tick"] * tick_size * contract
    total = lambda what: F.aggregate("fills", F.lit(0.0), lambda s, x: s + what(x))
    of = lambda side: total(lambda x: F.when(x["side_code"] == side, x["qty"]).otherwise(0.0))
    last = F.try_element_at("fills", F.lit(-1))
    out |= {
        "last_fill_side": last["side_code"], "last_fill_qty": last["qty"], "last_fill_notional": notional(last), "last_fill_fee": last["fee"],
        "last_fill_age_ms": F.greatest(now - last["local_ts_us"], F.lit(0)) / 1000, "step_fill_count": F.size("fills"),
        "step_buy_fill_qty": of(1), "step_sell_fill_qty": of(-1), "step_fill_notional": total(notional),
        "local_time_since_start_s": (now - c("start_ts_us")) / 1e6, "time_since_last_event_ms": (now - c("prev_ts_us")) / 1000,
    }
    names = (*FIELDS, *extra)
    known = {n: out[n] if n in out else c(n) if n in rows.columns else F.lit(0.0) for n in names}

    def safe(x: Column) -> Column:
        x = x.cast("double")
        x = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(F.lit(0.0))
        return F.least(F.greatest(x, F.lit(-most)), F.lit(most)) if most is not None else x

    return rows.select(*keep, *(safe(known[n]).alias(n) for n in names))


def sized(raw, least: float, most: float, default: float, step: float) -> Column:
    """A quantity from a raw size: 0 stands for the default, and all lie between least and most, in whole steps; 0 if none does."""
    if most < least:
        return F.lit(0.0)
    share = min(max((min(max(default, least), most) - least) / (most - least), 1e-12), 1 - 1e-12) if most > least else 1.0
    import math

    target = F.lit(most) if most == least else F.lit(least) + sigmoid(c(raw).cast("double") + math.log(share / (1 - share))) * (most - least)
    qty = F.least(floor_step(target, step), floor_step(F.lit(most), step))
    return F.when(qty >= least - EPS, qty).otherwise(F.lit(0.0))


def quotes_from_actions(rows: DataFrame, keep: list[str], away: int, gap: int, tick_size: float, least_qty: float, most_qty: float, default_qty: float, step: float, least_notional: float, most_inventory: float | None = None, most_notional: float | None = None, contract: float = 1.0, allow: tuple[bool, bool] = (True, True)) -> DataFrame:
    """``keep`` columns with, for each side, tick, qty, offset and the reason why it isn't quoted ('' if it is).

    A row has the touch, inventory, and for each side a wish (bid_on), a raw price and a raw size. Prices lie between ``away``
    ticks behind the touch and what is still post-only. Reasons are tried in order; the notional of the position that a fill
    would leave and quotes that meet come last.
    """
    bid, ask, inv = c("best_bid_tick"), c("best_ask_tick"), c("inventory")
    mid = (bid + ask) * 0.5 * tick_size
    low = {"bid": F.greatest(F.lit(1), bid - away + 1), "ask": bid + gap}
    high = {"bid": ask - gap, "ask": ask + away - 1}
    ticks, qtys, why = {}, {}, {}
    for side, s in (("bid", 1), ("ask", -1)):
        share = sigmoid(c(f"{side}_price_raw").cast("double"))
        n = high[side] - low[side] + 1
        ticks[side] = low[side] + F.least(F.floor((share if s > 0 else 1 - share) * n), n - 1)
        qtys[side] = sized(c(f"{side}_size_raw"), least_qty, most_qty, default_qty, step)
        reason = F.when(bid.isNull() | ask.isNull(), "missing_book_top").when(~c(f"{side}_on"), "disabled_by_action").when(F.lit(not allow[s < 0]), "disabled_by_action_spec").when(n < 1, "invalid_geometry")
        reason = reason.when(qtys[side] <= 0, "qty_below_min")
        if most_inventory is not None:
            reason = reason.when(s * inv >= most_inventory, "inventory_limit")
        reason = reason.when(~valid_notional(qtys[side], ticks[side], tick_size, least_notional), "notional_below_min")
        if most_notional is not None:
            reason = reason.when(F.abs(inv + s * qtys[side]) * mid * contract > most_notional, "position_notional_limit")
        why[side] = reason.otherwise("")
    meet = (why["bid"] == "") & (why["ask"] == "") & (ticks["bid"] >= ticks["ask"])
    columns = []
    for side in ("bid", "ask"):
        reason = F.when(meet, "invalid_geometry").otherwise(why[side])
        on = reason == ""
        offset = F.greatest(F.lit(0), (bid - ticks[side] if side == "bid" else ticks[side] - ask) + 1)
        columns += [F.when(on, ticks[side]).otherwise(F.lit(0)).cast("long").alias(f"{side}_tick"), F.when(on, qtys[side]).otherwise(F.lit(0.0)).alias(f"{side}_qty"), offset.cast("long").alias(f"{side}_offset"), reason.alias(f"{side}_reason")]
    return rows.select(*keep, *columns)
