"""Scalar and array kernels over the tape: operators 22 to 25, 33 and 97 to 117."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.functions import kernels as k
from tidebook.plans.common import r6, sql6
from tidebook.plans.registry import query
from tidebook.sources.market import EV_SQL, events

_FIN = "coalesce(({x})::double, 'nan'::double)"
LEVELS = 5


def ladders(ev):
    """Quotes with five levels a side: prices fall or rise by a tick, sizes follow from the id."""
    steps = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    e = F.col("event_id")
    return ev.where("is_trade = 0").select(
        "event_id",
        "best_bid_tick",
        "best_ask_tick",
        F.transform(steps, lambda i: (F.col("best_bid_tick") - i).cast("double")).alias("bid_px"),
        F.transform(steps, lambda i: (F.col("best_ask_tick") + i).cast("double")).alias("ask_px"),
        F.transform(steps, lambda i: (1 + (e * (i + 3)) % 9).cast("double")).alias("bid_sz"),
        F.transform(steps, lambda i: (1 + (e * (i + 5)) % 7).cast("double")).alias("ask_sz"),
        k.mid_price("best_bid_tick", "best_ask_tick").alias("mid"),
    )


LADDER_SQL = f"""{EV_SQL},
lad as (select event_id, best_bid_tick, best_ask_tick, (best_bid_tick + best_ask_tick) * 0.5::double as mid,
  list_transform(range({LEVELS}), lambda i: (best_bid_tick - i)::double) as bid_px, list_transform(range({LEVELS}), lambda i: (best_ask_tick + i)::double) as ask_px,
  list_transform(range({LEVELS}), lambda i: (1 + (event_id * (i + 3)) % 9)::double) as bid_sz, list_transform(range({LEVELS}), lambda i: (1 + (event_id * (i + 5)) % 7)::double) as ask_sz
  from ev where is_trade = 0),
lv as (select event_id, mid, unnest(range(1, {LEVELS + 1})) as lvl, unnest(bid_px) as bp, unnest(ask_px) as ap, unnest(bid_sz) as bs, unnest(ask_sz) as sz from lad)"""


@query("scalar_guards", f"""{EV_SQL}
select event_id, {sql6("case when side_code = 0 then 0 else amount / side_code end", "ratio")},
  {sql6("sign(amount - 50) * ln(1 + abs(amount - 50))", "signed_log")}, {sql6("least(greatest(amount - 50, -20), 20)", "clipped")},
  {sql6("(price_tick::double / best_bid_tick - 1) * 1e4", "change_bps")} from ev""")
def scalar_guards(spark, sf_dir):
    """Guarded division, signed log, clipping and relative change: operators 97 to 100."""
    return events(spark, sf_dir).select("event_id", r6(k.safe_divide("amount", "side_code"), "ratio"), r6(k.signed_log1p(F.col("amount") - 50), "signed_log"), r6(k.clip(F.col("amount") - 50, -20, 20), "clipped"), r6(k.bps_change("price_tick", "best_bid_tick"), "change_bps"))


@query("quote_algebra", f"""{EV_SQL}
select event_id, (best_bid_tick + best_ask_tick) * 0.5::double as mid, {sql6("(best_ask_tick - best_bid_tick) * 1e4 / ((best_bid_tick + best_ask_tick) * 0.5)", "spread_bps")},
  {sql6("(best_bid_tick * ask_sz + best_ask_tick * bid_sz) / (bid_sz + ask_sz)", "micro")}, {sql6("(bid_sz - ask_sz) / (bid_sz + ask_sz)", "imbalance")}
from ev where is_trade = 0 and best_bid_tick > 0 and best_ask_tick > best_bid_tick""")
def quote_algebra(spark, sf_dir):
    """Mid, spread, microprice and imbalance of valid two-sided quotes: operators 22, 101 and 111."""
    q = events(spark, sf_dir).where("is_trade = 0 and best_bid_tick > 0 and best_ask_tick > best_bid_tick")
    return q.select("event_id", k.mid_price("best_bid_tick", "best_ask_tick").cast("double").alias("mid"), r6(k.spread_bps("best_bid_tick", "best_ask_tick"), "spread_bps"), r6(k.microprice("best_bid_tick", "best_ask_tick", "bid_sz", "ask_sz"), "micro"), r6(k.imbalance("bid_sz", "ask_sz"), "imbalance"))


@query("ladder_prefix_sums", f"""{LADDER_SQL}
select event_id, sum(bs) filter (lvl <= 3) as bid_size_3, sum(bp * bs) filter (lvl <= 3) as bid_notional_3, sum(ap * sz) as ask_notional_all from lv group by event_id""")
def ladder_prefix_sums(spark, sf_dir):
    """Sums over the first levels: operator 102."""
    return ladders(events(spark, sf_dir)).select("event_id", k.sum_first("bid_sz", 3).alias("bid_size_3"), k.notional_first("bid_px", "bid_sz", 3).alias("bid_notional_3"), k.notional_first("ask_px", "ask_sz", 10).alias("ask_notional_all"))


@query("ladder_depth_bands", f"""{LADDER_SQL}
select event_id, coalesce(sum(bs) filter ((mid - bp) / mid * 1e4 <= 20 + 1e-12), 0) as bid_depth, coalesce(sum(sz) filter ((ap - mid) / mid * 1e4 <= 20 + 1e-12), 0) as ask_depth,
  {sql6("coalesce(sum(bp * bs) filter ((mid - bp) / mid * 1e4 <= 20 + 1e-12), 0)", "bid_notional")} from lv group by event_id""")
def ladder_depth_bands(spark, sf_dir):
    """Size and notional within 20 basis points of mid: operator 103."""
    lad = ladders(events(spark, sf_dir))
    return lad.select("event_id", k.depth_within_bps("bid_px", "bid_sz", "mid", 1, 20).alias("bid_depth"), k.depth_within_bps("ask_px", "ask_sz", "mid", -1, 20).alias("ask_depth"), r6(k.depth_within_bps("bid_px", "bid_sz", "mid", 1, 20, True), "bid_notional"))


@query("ladder_shape", f"""{LADDER_SQL}
select event_id, {sql6("coalesce(sum(bs * (mid - bp) / mid * 1e4) filter ((mid - bp) / mid * 1e4 <= 30 + 1e-12) / sum(bs) filter ((mid - bp) / mid * 1e4 <= 30 + 1e-12), 0)", "bid_centroid_bps")},
  {sql6("coalesce(min((ap - mid) / mid * 1e4) filter (sz >= 6), 0)", "ask_void_bps")} from lv group by event_id""")
def ladder_shape(spark, sf_dir):
    """Mean distance of size, and the first level of some size: operator 104."""
    lad = ladders(events(spark, sf_dir))
    return lad.select("event_id", r6(k.depth_centroid_bps("bid_px", "bid_sz", "mid", 1, 30), "bid_centroid_bps"), r6(k.liquidity_void_bps("ask_px", "ask_sz", "mid", -1, 6), "ask_void_bps"))


@query("log_return", f"""{EV_SQL} select event_id, {sql6("1e4 * ln(best_ask_tick::double / best_bid_tick)", "ret_bps")} from ev""")
def log_return(spark, sf_dir):
    """Operator 105."""
    return events(spark, sf_dir).select("event_id", r6(k.log_return_bps("best_ask_tick", "best_bid_tick"), "ret_bps"))


@query("sigmoid_expm1", f"""{EV_SQL} select event_id, {sql6("1 / (1 + exp(-((event_id % 41) - 20)::double))", "p")}, {sql6("exp(((event_id % 5) / 4.0)::double) - 1", "bps")} from ev""")
def sigmoid_expm1(spark, sf_dir):
    """Operator 106."""
    return events(spark, sf_dir).select("event_id", r6(k.sigmoid(((F.col("event_id") % 41) - 20).cast("double")), "p"), r6(F.expm1((F.col("event_id") % 5) / 4.0), "bps"))


_GATED = """, g as (select event_id, (event_id % 11) / 20.0::double as quiet, (event_id % 13) / 13.0::double as up, (event_id % 5) / 4.0::double as mu, (event_id % 7) / 6.0::double as md from ev),
h as (select *, (1 - quiet) * up as pu, (1 - quiet) * (1 - up) as pd, exp(mu) - 1 as u, exp(md) - 1 as d from g)"""


@query("gated_signal", f"""{EV_SQL}{_GATED}
select event_id, {sql6("1 - quiet", "p_move")}, {sql6("pu", "p_up_move")}, {sql6("pd", "p_down_move")}, {sql6("pu - pd", "signed_move_prob")}, {sql6("pu * u", "expected_up_bps")}, {sql6("pd * d", "expected_down_bps")},
  {sql6("pu * u - pd * d", "expected_return_bps")}, {sql6("pu * u + pd * d", "expected_abs_move_bps")}, {sql6("sqrt(greatest(pu * u * u + pd * d * d - (pu * u - pd * d) * (pu * u - pd * d), 0))", "predicted_vol_bps")}, {sql6("abs(pu - pd)", "confidence")} from h""")
def gated_signal(spark, sf_dir):
    """Signal outputs from four heads: operator 107."""
    e = F.col("event_id")
    out = k.gated_signal((e % 11) / 20.0, (e % 13) / 13.0, (e % 5) / 4.0, (e % 7) / 6.0)
    return events(spark, sf_dir).select("event_id", *(r6(v, n) for n, v in out.items()))


@query("tick_and_qty", f"""{EV_SQL} select event_id, round_even(amount / 0.25, 0)::bigint as tick, {sql6("floor(amount / 0.3 + 1e-12) * 0.3", "qty_floor")},
  amount >= 1 and amount <= 90 and abs(amount - round_even(amount / 0.01, 0) * 0.01) <= 1e-11 as qty_ok, amount * price_tick * 0.1 >= 500 - 1e-12 as notional_ok from ev""")
def tick_and_qty(spark, sf_dir):
    """Ticks, steps and validity rules: operators 5, 24, 109 and 117."""
    return events(spark, sf_dir).select("event_id", k.to_tick("amount", 0.25).alias("tick"), r6(k.floor_step("amount", 0.3), "qty_floor"), k.valid_qty("amount", 0.01, 1, 90).alias("qty_ok"), k.valid_notional("amount", "price_tick", 0.1, 500).alias("notional_ok"))


@query("quote_modes", f"""{EV_SQL}, m as (select event_id, event_id % 2 = 0 as b, event_id % 3 = 0 as a from ev)
select event_id, case when b and a then 'two_sided' when b then 'bid_only' when a then 'ask_only' else 'no_quote' end as mode, case when b and a then 3 when b then 1 when a then 2 else 0 end as mode_id from m""")
def quote_modes(spark, sf_dir):
    """Operator 110."""
    b, a = F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0
    return events(spark, sf_dir).select("event_id", k.quote_mode(b, a).alias("mode"), k.quote_mode_id(b, a).alias("mode_id"))


_CANDIDATES = ("touch", "inside_1", "away_1")


def _candidate_sql(name: str, side: int) -> str:
    move = {"touch": 0, "inside_1": 1, "away_1": -1}[name]
    return f"case when best_bid_tick + {move} <= best_ask_tick - 1 then best_bid_tick + {move} end as bid_{name}" if side > 0 else f"case when best_ask_tick - {move} >= best_bid_tick + 1 then best_ask_tick - {move} end as ask_{name}"


@query("quote_candidates", f"""{EV_SQL} select event_id, {", ".join(_candidate_sql(n, s) for n in _CANDIDATES for s in (1, -1))}, price_tick <= best_ask_tick - 1 as bid_safe, price_tick >= best_bid_tick + 1 as ask_safe from ev where is_trade = 0""")
def quote_candidates(spark, sf_dir):
    """Candidate quotes and the post-only rule: operators 33 and 112."""
    q = events(spark, sf_dir).where("is_trade = 0")
    columns = [k.candidate_tick(n, s, "best_bid_tick", "best_ask_tick").alias(f"{'bid' if s > 0 else 'ask'}_{n}") for n in _CANDIDATES for s in (1, -1)]
    return q.select("event_id", *columns, k.post_only_safe(F.lit(1), "price_tick", "best_bid_tick", "best_ask_tick").alias("bid_safe"), k.post_only_safe(F.lit(-1), "price_tick", "best_bid_tick", "best_ask_tick").alias("ask_safe"))


@query("base_transforms", f"""{EV_SQL}, x as (select event_id, amount - 50 as v from ev)
select event_id, {sql6("least(greatest(v, -1e9), 1e9)", "identity")}, {sql6("ln(1 + greatest(v, 0))", "log1p_pos")}, {sql6("sign(v) * ln(1 + abs(v))", "signed_log1p")}, {sql6("least(greatest(v, -10), 10)", "ratio")}, {sql6("least(greatest(v, -1), 1)", "sign")},
  (abs(v) > 10)::int as ratio_clipped from x""")
def base_transforms(spark, sf_dir):
    """Raw features on their scales, with a clip counter: operator 115."""
    v = F.col("amount") - 50
    return events(spark, sf_dir).select("event_id", *(r6(k.base_transform(v, n), n) for n in ("identity", "log1p_pos", "signed_log1p", "ratio", "sign")), (F.abs(v) > 10).cast("int").alias("ratio_clipped"))


@query("effective_trades", f"{EV_SQL} select event_id, symbol_id, local_ts_us, side_code, amount from ev where is_trade = 1 and side_code <> 0 and amount > 0")
def effective_trades(spark, sf_dir):
    """Trades with a side and a size: operator 23."""
    return events(spark, sf_dir).where("is_trade = 1 and side_code <> 0 and amount > 0").select("event_id", "symbol_id", "local_ts_us", "side_code", "amount")


_EDGE = """, x as (select event_id, best_bid_tick + 1 as px, (best_bid_tick + best_ask_tick) * 0.5::double as mid, (event_id % 10) / 10.0::double as p_fill, (event_id % 4)::double as cost, ((event_id % 21) - 10)::double as alpha, ((event_id % 7) - 3)::double as inv from ev where is_trade = 0)"""


@query("executable_edge", f"""{EV_SQL}{_EDGE}
select event_id, {sql6("p_fill * ((mid - px) / mid * 1e4 + 0.5 + alpha) - cost - 0.1 - 0.2 * inv", "edge_bps")}, p_fill * ((mid - px) / mid * 1e4 + 0.5 + alpha) - cost - 0.1 - 0.2 * inv > 0 as allowed from x""")
def executable_edge(spark, sf_dir):
    """Fill probability times what a fill earns, less costs and inventory skew: operator 114."""
    from tidebook.operators.execution import side_edge

    e = F.col("event_id")
    q = events(spark, sf_dir).where("is_trade = 0").withColumn("mid", k.mid_price("best_bid_tick", "best_ask_tick"))
    edge = side_edge(1, F.col("mid"), F.col("best_bid_tick") + 1, (e % 10) / 10.0, (e % 21) - 10, e % 4, (e % 7) - 3, rebate_bps=0.5, latency_bps=0.1, skew_bps=0.2)
    return q.select("event_id", r6(edge, "edge_bps"), (edge > 0).alias("allowed"))
