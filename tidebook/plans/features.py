"""The 48 features over the driver's sparse tape, with windows stretched to hours: operators 69 to 76 and F0 to F47."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.functions import kernels as k
from tidebook.operators import features as f
from tidebook.plans.common import r6, sql6
from tidebook.plans.registry import query
from tidebook.sources.market import EV_SQL, events

#: 200 ms become an hour, 3 s become fifteen; slices are longer than the longest window.
SCALE = 18_000
SLICE = 2 * 86_400_000_000
LEVELS = 5


def book_quotes(spark, sf_dir):
    """Quotes with five levels a side, a tick being near a basis point."""
    e, steps = F.col("event_id"), F.sequence(F.lit(0), F.lit(LEVELS - 1))
    q = events(spark, sf_dir).where("is_trade = 0")
    px = lambda side, sign: F.transform(steps, lambda i: (10000 + F.col(f"best_{side}_tick") + sign * i).cast("double"))
    return q.select(
        "symbol_id", "event_id", "local_ts_us",
        (k.mid_price("best_bid_tick", "best_ask_tick") + 10000).cast("double").alias("mid"),
        px("bid", -1).alias("bid_px"), px("ask", 1).alias("ask_px"),
        F.transform(steps, lambda i: (1 + (e * (i + 3)) % 9).cast("double")).alias("bid_sz"),
        F.transform(steps, lambda i: (1 + (e * (i + 5)) % 7).cast("double")).alias("ask_sz"),
    )


def tape(spark, sf_dir):
    return events(spark, sf_dir).select("symbol_id", "event_id", "local_ts_us", "is_trade", "side_code", F.col("price_tick").cast("double").alias("price"), "amount")


def _w(*us: int, order: str = "2 * local_ts_us") -> str:
    return "window " + ", ".join(f"w{u} as (partition by symbol_id order by {order} range between {2 * u * SCALE} preceding and current row)" for u in us)


_BOOK = f"""{EV_SQL},
lad as (select symbol_id, event_id, local_ts_us, 10000 + (best_bid_tick + best_ask_tick) * 0.5::double as mid,
  list_transform(range({LEVELS}), lambda i: (10000 + best_bid_tick - i)::double) as bp, list_transform(range({LEVELS}), lambda i: (10000 + best_ask_tick + i)::double) as ap,
  list_transform(range({LEVELS}), lambda i: (1 + (event_id * (i + 3)) % 9)::double) as bs, list_transform(range({LEVELS}), lambda i: (1 + (event_id * (i + 5)) % 7)::double) as az from ev where is_trade = 0),
lg as (select *, lag(bp) over w as pbp, lag(ap) over w as pap, lag(bs) over w as pbs, lag(az) over w as paz, lag(mid) over w as pmid from lad window w as (partition by symbol_id order by local_ts_us, event_id)),
ch as (select *,
  case when pbp is null then 0 when bp[1] > pbp[1] then bs[1] when bp[1] = pbp[1] then greatest(bs[1] - pbs[1], 0) else 0 end::double as bid_add,
  case when pbp is null then 0 when bp[1] < pbp[1] then pbs[1] when bp[1] = pbp[1] then greatest(pbs[1] - bs[1], 0) else 0 end::double as bid_rem,
  case when pbp is null then 0 when ap[1] < pap[1] then az[1] when ap[1] = pap[1] then greatest(az[1] - paz[1], 0) else 0 end::double as ask_add,
  case when pbp is null then 0 when ap[1] > pap[1] then paz[1] when ap[1] = pap[1] then greatest(paz[1] - az[1], 0) else 0 end::double as ask_rem,
  case when pbp is null then 0 else list_sum(list_transform(range(1, {LEVELS + 1}), lambda i:
    case when bp[i] > pbp[i] then bs[i] when bp[i] = pbp[i] then bs[i] - pbs[i] else -pbs[i] end - case when ap[i] < pap[i] then az[i] when ap[i] = pap[i] then az[i] - paz[i] else -paz[i] end)) end::double as ofi10,
  case when bp[1] <> pbp[1] then 1 else 0 end as bch, case when ap[1] <> pap[1] then 1 else 0 end as ach, case when ap[1] - bp[1] <> pap[1] - pbp[1] then 1 else 0 end as sch,
  case when pmid is null or abs(mid - pmid) > 1e-12 then local_ts_us end as m_at, case when pbp is null or bp[1] <> pbp[1] or bs[1] <> pbs[1] then local_ts_us end as b_at,
  case when pbp is null or ap[1] <> pap[1] or az[1] <> paz[1] then local_ts_us end as a_at,
  list_sum(bs) as b10, list_sum(az) as a10, list_sum(list_transform(range(1, {LEVELS + 1}), lambda i: bp[i] * bs[i])) as bn, list_sum(list_transform(range(1, {LEVELS + 1}), lambda i: ap[i] * az[i])) as an,
  list_sum(list_transform(range(1, {LEVELS + 1}), lambda i: case when (mid - bp[i]) / mid * 1e4 <= 5 + 1e-12 then bs[i] else 0 end)) as bz5, list_sum(list_transform(range(1, {LEVELS + 1}), lambda i: case when (ap[i] - mid) / mid * 1e4 <= 5 + 1e-12 then az[i] else 0 end)) as az5,
  list_sum(list_transform(range(1, {LEVELS + 1}), lambda i: case when (mid - bp[i]) / mid * 1e4 <= 5 + 1e-12 then bp[i] * bs[i] else 0 end)) as bn5, list_sum(list_transform(range(1, {LEVELS + 1}), lambda i: case when (ap[i] - mid) / mid * 1e4 <= 5 + 1e-12 then ap[i] * az[i] else 0 end)) as an5,
  greatest(list_sum(list_transform(range(1, {LEVELS + 1}), lambda i: case when (mid - bp[i]) / mid * 1e4 <= 1 + 1e-12 then bs[i] else 0 end)), 1e-12) as b1, greatest(list_sum(list_transform(range(1, {LEVELS + 1}), lambda i: case when (ap[i] - mid) / mid * 1e4 <= 1 + 1e-12 then az[i] else 0 end)), 1e-12) as a1
  from lg),
bk as (select *, (bn / b10 * a10 + an / a10 * b10) / (b10 + a10) as micro, (bn5 - an5) / nullif(bn5 + an5, 0) as imb5x, last_value(m_at ignore nulls) over w as mc, last_value(b_at ignore nulls) over w as bc, last_value(a_at ignore nulls) over w as ac
  from ch window w as (partition by symbol_id order by local_ts_us, event_id rows between unbounded preceding and current row)),
bq as (select *, coalesce(imb5x, 0) as imb5, micro - mid as gap from bk)"""


def _slope_sql(x: str, w: str, relative: bool) -> str:
    first, last = f"first_value({x}) over {w}", f"last_value({x}) over {w}"
    change = f"({last} / {first} - 1) * 1e4" if relative else f"({last} - {first})"
    span = f"((last_value(local_ts_us) over {w} - first_value(local_ts_us) over {w}) / 1e6)"
    return f"case when count(*) over {w} >= 2 and {span} > 1e-12 then {change} / {span} else 0 end"


_VOL = "coalesce(list_aggregate(list_transform(range(2, len(ms) + 1), lambda i: (ms[i] / ms[i - 1] - 1) * 1e4), 'stddev_pop'), 0)"
_FLIPS = "len(list_filter(range(2, len(sg) + 1), lambda i: sg[i] <> sg[i - 1]))"
_BOOK_COLUMNS = {
    "mid_slope_bps_per_sec_1000000us": _slope_sql("mid", "w1000000", True),
    "time_since_mid_change_us": "local_ts_us - mc",
    "bid_l1_notional_usd": "bp[1] * bs[1]",
    "ask_l1_notional_usd": "ap[1] * az[1]",
    "total_depth_notional_5bps": "bn5 + an5",
    "obi_l1": "(bs[1] - az[1]) / (bs[1] + az[1])",
    "ofi_l10_sum_over_depth_1000000us": "sum(ofi10) over w1000000 / greatest(bz5 + az5, 1e-12)",
    "micro_l10_minus_mid_bps": "(micro / mid - 1) * 1e4",
    "ask_l1_depletion_500000us": "sum(ask_rem) over w500000",
    "bid_price_change_rate_1000000us": "sum(bch) over w1000000",
    "bid_l1_depletion_1000000us": "sum(bid_rem) over w1000000",
    "ob_update_rate_200000us": "count(*) over w200000 / 0.2",
    "ob_update_rate_500000us": "count(*) over w500000 / 0.5",
    "depth_imbalance_5bps_slope_1000000us": _slope_sql("imb5", "w1000000", False),
    "depth_imbalance_5bps_slope_3000000us": _slope_sql("imb5", "w3000000", False),
    "l1_churn_over_depth_1000000us": "sum(bid_add + bid_rem + ask_add + ask_rem) over w1000000 / greatest(avg(b1 + a1) over w1000000, 1e-12)",
    "touch_flicker_score_3000000us": "sum(bch + ach) over w3000000 / count(*) over w3000000",
    "spread_state_transition_rate_3000000us": "sum(sch) over w3000000 / 3.0",
    "best_bid_size_age_us": "local_ts_us - bc",
    "best_ask_size_age_us": "local_ts_us - ac",
    "near_touch_depth_drop_asymmetry": "coalesce((sum(ask_rem) over w200000 - sum(bid_rem) over w200000) / nullif(sum(ask_rem) over w200000 + sum(bid_rem) over w200000, 0), 0)",
}
#: Those over the depth within a basis point, which may be next to nothing: compared by their inverse, times the depth.
_OVER_DEPTH = {
    "ask_l1_depletion_over_depth_200000us": ("sum(ask_rem) over w200000", "a1"),
    "bid_l1_depletion_over_depth_1000000us": ("sum(bid_rem) over w1000000", "b1"),
    "ask_l1_depletion_over_depth_1000000us": ("sum(ask_rem) over w1000000", "a1"),
    "bid_l1_rem_rate_over_depth_200000us": ("sum(bid_rem) over w200000 / 0.2", "b1"),
}
_BOOK_COLUMNS |= {n: f"case when {d} > 1e-9 then {x} / {d} end" for n, (x, d) in _OVER_DEPTH.items()}
_BOOK_COLUMNS |= {"ask_depth_within_1bps": "a1", "depth_imbalance_within_1bps": "case when b1 + a1 > 1e-9 then (b1 - a1) / (b1 + a1) else 0 end"}
_W4 = _w(200_000, 500_000, 1_000_000, 3_000_000)


@query("features_book", f"{_BOOK} select event_id, {', '.join(sql6(x, n) for n, x in _BOOK_COLUMNS.items())} from bq {_W4}")
def features_book(spark, sf_dir):
    out = f.book_features(book_quotes(spark, sf_dir), SCALE, SLICE)
    tiny = lambda n: F.col("ask_1bps" if n.startswith("ask") else "bid_1bps") > 1e-9
    return out.select("event_id", *(r6(F.when(tiny(n), F.col(n)) if n in _OVER_DEPTH else F.col(n), n) for n in _BOOK_COLUMNS))


@query("features_book_lists", f"""{_BOOK},
l as (select event_id, list(micro) over w1000000 as ms, list_filter(list(sign(gap)) over w1000000, lambda x: x <> 0) as sg from bq {_w(1_000_000)})
select event_id, {sql6(_VOL, "microprice_realized_vol_1000000us")}, {sql6(_FLIPS, "microprice_zero_cross_rate_1000000us")} from l""")
def features_book_lists(spark, sf_dir):
    """F32 and F38, which look at neighbours within the window."""
    out = f.book_features(book_quotes(spark, sf_dir), SCALE, SLICE)
    return out.select("event_id", r6("microprice_realized_vol_1000000us", "microprice_realized_vol_1000000us"), r6("microprice_zero_cross_rate_1000000us", "microprice_zero_cross_rate_1000000us"))


_KEY2 = "2 * local_ts_us + is_trade"
_TRADE = f"""{EV_SQL},
tp as (select symbol_id, event_id, local_ts_us, is_trade, side_code, price_tick::double as price, amount, price_tick * amount as notional from ev),
ts as (select event_id, coalesce(sign(price - lag(price) over (partition by symbol_id order by local_ts_us, event_id)), 0) as ticksign from tp where is_trade = 1),
tr as (select tp.*, ticksign, last_value(case when is_trade = 1 and side_code > 0 then local_ts_us end ignore nulls) over w as buy_at, last_value(case when is_trade = 1 and side_code < 0 then local_ts_us end ignore nulls) over w as sell_at
  from tp left join ts using (event_id) window w as (partition by symbol_id order by local_ts_us, is_trade, event_id rows between unbounded preceding and current row))"""


def _n(cond: str, w: int) -> str:
    return f"(count(*) filter (is_trade = 1 and {cond}) over w{w})"


def _sum(cond: str, w: int) -> str:
    return f"coalesce(sum(notional) filter (is_trade = 1 and {cond}) over w{w}, 0)"


def _entropy(w: int) -> str:
    n = _n("true", w)
    parts = " + ".join(f"(case when {_n(c, w)} > 0 then -({_n(c, w)} / {n}::double) * log2({_n(c, w)} / {n}::double) else 0 end)" for c in ("side_code > 0", "side_code < 0", "side_code = 0"))
    return f"case when {n} > 0 then ({parts}) / log2(3.0) else 0 end"


_TRADE_COLUMNS = {
    "trade_count_per_second_200000us": f"{_n('true', 200_000)} / 0.2",
    "trade_imbalance_notional_500000us": f"coalesce(({_sum('side_code > 0', 500_000)} - {_sum('side_code < 0', 500_000)}) / nullif({_sum('side_code > 0', 500_000)} + {_sum('side_code < 0', 500_000)}, 0), 0)",
    "trade_count_per_second_500000us": f"{_n('true', 500_000)} / 0.5",
    "zero_tick_fraction_1000000us": f"coalesce({_n('ticksign = 0', 1_000_000)} / nullif({_n('true', 1_000_000)}, 0)::double, 0)",
    "trade_count_per_second_1000000us": _n("true", 1_000_000),
    "time_since_last_buy_trade_us": "coalesce(local_ts_us - buy_at, 0)",
    "time_since_last_sell_trade_us": "coalesce(local_ts_us - sell_at, 0)",
    "max_signed_trade_notional_usd_1000000us": "coalesce(arg_max(sign(side_code) * notional, {'m': abs(sign(side_code) * notional), 't': -local_ts_us, 'e': -event_id}) filter (is_trade = 1) over w1000000, 0)",
    "trade_sign_entropy_3000000us": _entropy(3_000_000),
}


@query("features_trade", f"{_TRADE} select event_id, {', '.join(sql6(x, n) for n, x in _TRADE_COLUMNS.items())} from tr {_w(200_000, 500_000, 1_000_000, 3_000_000, order=_KEY2)}")
def features_trade(spark, sf_dir):
    out = f.trade_features(tape(spark, sf_dir), SCALE, SLICE)
    return out.select("event_id", *(r6(n, n) for n in _TRADE_COLUMNS))


@query("features_trade_lists", f"""{_TRADE},
l as (select event_id, list({{'side': side_code, 'run': case when side_code = 0 then 0 else notional end, 'best': case when side_code = 0 then 0 else notional end}}) filter (is_trade = 1) over w1000000 as ts, list(local_ts_us) filter (is_trade = 1) over w3000000 as tms from tr {_w(1_000_000, 3_000_000, order=_KEY2)})
select event_id, {sql6("coalesce(list_reduce(ts, lambda a, x: {'side': x.side, 'run': case when x.side = 0 then 0 when x.side = a.side then a.run + x.run else x.run end, 'best': greatest(a.best, case when x.side = 0 then 0 when x.side = a.side then a.run + x.run else x.run end)}).best, 0)", "same_side_trade_cluster_notional_1000000us")},
  {sql6("coalesce(list_max(list_transform(range(2, len(tms) + 1), lambda i: tms[i] - tms[i - 1])), 0)", "max_trade_silence_gap_3000000us")} from l""")
def features_trade_lists(spark, sf_dir):
    """F34 and F37, which look at neighbours within the window."""
    out = f.trade_features(tape(spark, sf_dir), SCALE, SLICE)
    return out.select("event_id", r6("same_side_trade_cluster_notional_1000000us", "same_side_trade_cluster_notional_1000000us"), r6("max_trade_silence_gap_3000000us", "max_trade_silence_gap_3000000us"))


def _tot(x: str, w: int) -> str:
    return f"coalesce(sum({x}) over w{w}, 0)"


def _share(side: str, w: int) -> str:
    b, s = _tot("case when side_code > 0 then qty end", w), _tot("case when side_code < 0 then qty end", w)
    return f"coalesce({b if side == 'buy' else s} / nullif({b} + {s}, 0), 0)"


def _refill(side: str, w: int) -> str:
    return f"coalesce({_tot(side + '_add', w)} / nullif({_tot(side + '_add', w)} + {_tot(side + '_rem', w)}, 0), 0)"


@query("features_cross", f"""{_BOOK},
x as (select symbol_id, event_id, local_ts_us, 0 as is_trade, 0 as side_code, 0.0::double as qty, bid_add, bid_rem, ask_add, ask_rem, bid_add - bid_rem - ask_add + ask_rem as ofi1, micro, bz5 + az5 as sz5 from bq
  union all select symbol_id, event_id, local_ts_us, 1, side_code, amount, null, null, null, null, null, null, null from ev where is_trade = 1),
y as (select *, {_share("sell", 1_000_000)} * {_refill("bid", 1_000_000)} as ab, {_share("buy", 1_000_000)} * {_refill("ask", 1_000_000)} as aa, {_share("buy", 500_000)} * {_refill("ask", 500_000)} - {_share("sell", 500_000)} * {_refill("bid", 500_000)} as asym,
  {_tot("ofi1", 1_000_000)} / greatest(sz5, 1e-12) as pressure, list(micro) filter (micro is not null) over w1000000 as ms,
  {", ".join(f"ln(1 + count(*) over w{u}) as e{u}" for u in (200_000, 500_000, 1_000_000, 3_000_000))} from x {_w(200_000, 500_000, 1_000_000, 3_000_000, order=_KEY2)})
select event_id, {sql6("ab", "absorption_bid_1000000us")}, {sql6("aa", "absorption_ask_1000000us")}, {sql6("asym", "trade_side_quote_response_asymmetry_500000us")}, {sql6(f"case when {_VOL} > 1e-12 then pressure / {_VOL} else 0 end", "ofi_l1_pressure_over_realized_vol_1000000us")},
  {", ".join(sql6(f"e{u}", f"log_events_{u}us") for u in (200_000, 500_000, 1_000_000, 3_000_000))} from y where is_trade = 0""")
def features_cross(spark, sf_dir):
    out = f.cross_features(tape(spark, sf_dir), book_quotes(spark, sf_dir), SCALE, SLICE)
    names = ["absorption_bid_1000000us", "absorption_ask_1000000us", "trade_side_quote_response_asymmetry_500000us", "ofi_l1_pressure_over_realized_vol_1000000us", *(f"log_events_{u}us" for u in (200_000, 500_000, 1_000_000, 3_000_000))]
    return out.select("event_id", *(r6(n, n) for n in names))
