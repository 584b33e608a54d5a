"""Feature rows at decisions and their transforms, rewards, fills by candidate, observations, quotes and contracts: operators 28 to 32, 42, 43, 113, 118, 120, 127, 128, 132, 134 to 136, 144 to 146, 153, 172 and 176."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.operators import contracts, fills, observations, rewards, transforms
from tidebook.operators import features as f
from tidebook.operators import ordered as o
from tidebook.plans import features as pf
from tidebook.plans.common import H6, H24, HOUR, r6, sql6
from tidebook.plans.labels import _DECISIONS_SQL, decisions, quotes
from tidebook.plans.registry import oracle_sql, query
from tidebook.sources.market import EV_SQL, events

BY = ["symbol_id"]
CANDIDATES = ["touch", "inside_1", "away_1"]

# features

def feature_rows(spark, sf_dir):
    """All 48 features at every quote: those of the book, of trades so far, and of both, side by side."""
    tape, book = pf.tape(spark, sf_dir), pf.book_quotes(spark, sf_dir)
    parts = [f.book_features(book, pf.SCALE, pf.SLICE), f.trade_features(tape, pf.SCALE, pf.SLICE), f.cross_features(tape, book, pf.SCALE, pf.SLICE)]
    keys = ["symbol_id", "event_id", "local_ts_us"]
    a, b, c = (p.select(*(keys if i == 0 else ["event_id"]), *(n for n in f.FEATURES if n in p.columns)) for i, p in enumerate(parts))
    return a.join(b, "event_id").join(c, "event_id").select(*keys, *f.FEATURES)


@query("feature_replay", f"""with recursive q0 as (select 1), d as ({_DECISIONS_SQL} select event_id from d), a as ({oracle_sql()["features_book"]}), a2 as ({oracle_sql()["features_book_lists"]}),
b as ({oracle_sql()["features_trade"]}), b2 as ({oracle_sql()["features_trade_lists"]}), c as ({oracle_sql()["features_cross"]})
select a.* exclude ({", ".join(pf._OVER_DEPTH)}), a2.* exclude (event_id), b.* exclude (event_id), b2.* exclude (event_id), c.* exclude (event_id)
from d join a using (event_id) join a2 using (event_id) join b using (event_id) join b2 using (event_id) join c using (event_id)""")
def feature_replay(spark, sf_dir):
    """Feature rows at the rows of the grid, where the touch moves: operator 127."""
    rows = feature_rows(spark, sf_dir).join(decisions(spark, sf_dir).select("event_id"), "event_id", "left_semi")
    return rows.select("event_id", *(r6(n, n) for n in f.FEATURES if n not in pf._OVER_DEPTH))


@query("features_normalised")
def features_normalised(spark, sf_dir):
    """All features through their transforms, with half-lives stretched as the windows are: operators 115 and 128."""
    return transforms.transformed(feature_rows(spark, sf_dir), BY, ["local_ts_us", "event_id"], scale=float(pf.SCALE))


def _case(rules, name: str = "feature") -> str:
    """The first pattern that a name has, in SQL; patterns may ask for a source."""
    whens = []
    for rule in rules:
        value, source, pattern = (rule[0], None, rule[1]) if len(rule) == 2 else rule
        tests = ([f"source = '{source}'"] if source else []) + ([f"regexp_matches({name}, '{pattern}')"] if pattern else [])
        whens.append(f"when {' and '.join(tests) or 'true'} then {value if isinstance(value, int) else repr(value)}")
    return f"case {' '.join(whens)} end"


@query("feature_metadata", f"""with n as (select * from (values {", ".join(f"('{n}', {i}::int)" for i, n in enumerate(f.FEATURES))}) t(feature, position)),
s as (select *, {_case(transforms.SOURCES)} as source, {_case(transforms.UNITS)} as unit from n),
m as (select *, {_case(transforms.FAMILIES)} as family, {_case(transforms.DEPTHS)}::int as depth, case when source in ('book', 'trade') then source || '_state' else 'engine' end as owner,
  case when source = 'event_context' then 'log1p_pos' when unit = 'microseconds' then 'time_log1p' when unit = 'sign' then 'sign' when unit = 'ratio' or contains(feature, 'over_depth') then 'ratio_bounded'
    when starts_with(feature, 'max_signed_trade') then 'signed_log1p' when regexp_matches(feature, 'notional|usd') or unit in ('count', 'rate_per_second') then 'log1p_pos' else 'identity' end as scale from s)
select * from m""")
def feature_metadata(spark, sf_dir):
    """What the registry infers from names: operator 31."""
    known = transforms.specs()
    rows = [(s.name, s.position, s.source, s.unit, s.family, s.depth, s.owner, s.scale) for s in known]
    return spark.createDataFrame(rows, "feature string, position int, source string, unit string, family string, depth int, owner string, scale string")


@query("head_matrix", f"{EV_SQL} select event_id, round(bid_sz, 6) as x0, round(best_bid_tick::double, 6) as x1 from ev where is_trade = 0")
def head_matrix(spark, sf_dir):
    """A head's columns in the table's order as one array a row, checked to be finite: operators 28 and 29."""
    q = events(spark, sf_dir).where("is_trade = 0")
    columns = contracts.head_columns(["ask_sz", "bid_sz", "best_bid_tick"], {"direction": ["best_bid_tick", "bid_sz"]})["direction"]
    return contracts.matrix(q, columns, ["event_id"]).select("event_id", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


@query("pointer_gather", f"{EV_SQL} select event_id, case when is_trade = 0 then best_bid_tick end as book_best_bid_tick, case when is_trade = 1 then price_tick end as trade_price_tick from ev")
def pointer_gather(spark, sf_dir):
    """Events with the row that each points to: operator 42."""
    ev = events(spark, sf_dir)
    return contracts.gathered(ev.select("event_id"), ev.where("is_trade = 0").select("event_id", "best_bid_tick"), ev.where("is_trade = 1").select("event_id", "price_tick"), "event_id", "event_id")


@query("grid_contract", f"""{_DECISIONS_SQL}, n as (select count(*) as n, min(event_id) as first from d), third as (select n, first, n // 3 as t from n)
select first as start_event, n as rows_available, t as n_train, t as n_val, n - 2 * t as n_test from third""")
def grid_contract(spark, sf_dir):
    """Where a grid starts, how many rows follow, and a contract of its splits, checked again: operators 43 and 172."""
    from tidebook.session import written

    grid = written(decisions(spark, sf_dir).select("event_id", "local_ts_us"), "grid")
    start = contracts.grid_start(grid, "event_id", least_rows=1)
    n = start["rows_available"]
    made = contracts.split_contract(grid, "event_id", {"train": [(0, n // 3)], "val": [(n // 3, 2 * (n // 3))], "test": [(2 * (n // 3), n)]}, {"source": "events"})
    counts = contracts.check_contract(made, grid, "event_id")["counts"]
    return spark.createDataFrame([(start["event"], n, counts["train"], counts["val"], counts["test"])], "start_event long, rows_available long, n_train long, n_val long, n_test long")


@query("golden_outputs", f"{EV_SQL} select 'effective' as name, count(*) as n_rows, true as same from ev where is_trade = 1 and side_code <> 0 and amount > 0 union all select 'quotes', count(*), true from ev where is_trade = 0")
def golden_outputs(spark, sf_dir):
    """Hashes and rows of results, held against a second run: operators 118 and 176."""
    ev = events(spark, sf_dir)
    make = {"effective": lambda: ev.where("is_trade = 1 and side_code <> 0 and amount > 0"), "quotes": lambda: ev.where("is_trade = 0")}
    one, two = contracts.golden(make), contracts.golden(make)
    return spark.createDataFrame([(n, x["rows"], x["sha256"] == two[n]["sha256"]) for n, x in one.items()], "name string, n_rows long, same boolean")


# rewards

PENALTIES = rewards.Penalties(0.1, 0.1, 0.001, 0.2, 1.5)  # all amounts are whole multiples of 1e-7
_POSITIONS = f"""{EV_SQL}, f as (select * from ev where is_trade = 1 and side_code <> 0 and amount > 0),
c as (select *, sum(side_code * amount) over w as pos, sum(-side_code * amount * price_tick + amount * price_tick * 0.5 / 1e4) over w as cash, row_number() over (partition by symbol_id order by local_ts_us desc, event_id desc) = 1 as terminal from f window w as (partition by symbol_id order by local_ts_us, event_id rows between unbounded preceding and current row)), e as (select *, cash + pos * price_tick as eq from c)"""


@query("reward_components", f"""{_POSITIONS}, b as (select *, coalesce(lag(eq) over w, 0) as prev, coalesce(max(eq) over (partition by symbol_id order by local_ts_us, event_id rows between unbounded preceding and 1 preceding), 0) as mx from e window w as (partition by symbol_id order by local_ts_us, event_id)),
p as (select *, greatest(mx, 0, prev) as peak from b),
r as (select event_id, eq - prev as d, abs(pos) * price_tick * 0.1 / 1e4 as inv, amount * price_tick * 0.1 / 1e4 as turn, (event_id % 3) * 0.001 as canc, greatest(greatest(peak - eq, 0) - greatest(peak - prev, 0), 0) * 0.2 as dd, case when terminal then abs(pos) * price_tick * 1.5 / 1e4 else 0 end as term from p)
select event_id, {sql6("d", "equity_delta", 7)}, {sql6("inv", "inventory_penalty", 7)}, {sql6("turn", "turnover_penalty", 7)}, {sql6("canc", "cancel_penalty", 7)}, {sql6("dd", "drawdown_penalty", 7)}, {sql6("term", "terminal_penalty", 7)}, {sql6("d - inv - turn - canc - dd - term", "reward", 7)} from r""")
def reward_components(spark, sf_dir):
    """Equity changes less five penalties, after every fill: operator 144."""
    from pyspark.sql import Window

    from tidebook.operators import execution as x

    e = events(spark, sf_dir).where("is_trade = 1 and side_code <> 0 and amount > 0")
    steps = x.positions(e, BY, ["local_ts_us", "event_id"], "side_code", "amount", "price_tick", -0.5)
    last = F.lead("event_id").over(Window.partitionBy("symbol_id").orderBy("local_ts_us", "event_id")).isNull()
    steps = steps.select("event_id", "symbol_id", "local_ts_us", "equity", "position", F.col("price_tick").cast("double").alias("mark"), (F.col("amount") * F.col("price_tick")).alias("turnover"), (F.col("event_id") % 3).alias("cancels"), last.alias("terminal"))
    got = rewards.reward_components(steps, BY, ["local_ts_us", "event_id"], PENALTIES)
    return got.select("event_id", *(r6(n, n, 7) for n in ("equity_delta", "inventory_penalty", "turnover_penalty", "cancel_penalty", "drawdown_penalty", "terminal_penalty", "reward")))


PROJECTION = rewards.Projection(H6, ((H6, 0.5), (H24, 0.25)), 2.0, 0.7, 0.3, 0.4, 0.6, 0.2)
_ANCHORS = f"""{EV_SQL}, q as (select symbol_id, event_id, local_ts_us, (best_bid_tick + best_ask_tick) * 0.5::double as mid, ((best_bid_tick + best_ask_tick) * 0.5 * ((event_id % 5) - 2))::double as equity from ev where is_trade = 0),
u as (select symbol_id, local_ts_us, max_by(mid, event_id) as mid, max_by(equity, event_id) as equity from q group by all),
a as (select *, lead(local_ts_us) over w as next_ts, coalesce(lag(equity) over w, 0) as prev, ((event_id % 7) - 3)::double as inv, ((event_id * 3) % 11)::double as realized from q window w as (partition by symbol_id order by local_ts_us, event_id)),
fl as (select t.*, q.event_id as anchor from (select * from ev where is_trade = 1 and side_code <> 0 and amount > 0) t asof join q on q.symbol_id = t.symbol_id and q.local_ts_us <= t.local_ts_us),
fm as (select fl.*, u.mid as later from fl asof left join u on u.symbol_id = fl.symbol_id and u.local_ts_us >= fl.local_ts_us + {H6}),
fg as (select anchor, count(*) as n, count(later) as m, sum(amount * side_code * (later - price_tick) - 0.01 * amount) as gain from fm group by anchor),
z as (select a.*, case when fg.n is null then 0 when m = n then gain end as fill, h.equity - prev as path, h.mid as hmid, x.equity - a.equity as ahead, y.equity - prev as day from
  (select *, local_ts_us + {H6} as t1, next_ts + {H6} as t2, local_ts_us + {H24} as t3 from a) a left join fg on fg.anchor = a.event_id
  asof left join u h on h.symbol_id = a.symbol_id and h.local_ts_us >= a.t1 asof left join u x on x.symbol_id = a.symbol_id and x.local_ts_us >= a.t2 asof left join u y on y.symbol_id = a.symbol_id and y.local_ts_us >= a.t3)"""


@query("projected_rewards", f"""{_ANCHORS} select event_id as anchor_id, {sql6("equity - prev", "equity_delta")}, {sql6("2 * path", "horizon_path_equity")}, {sql6("2 * fill", "fill_markout_horizon")}, {sql6("2 * (0.7 * path + 0.3 * fill)", "horizon_blend")},
{sql6("equity - prev + 2 * 0.4 * (ahead - path)", "horizon_potential_shaped")}, {sql6("2 * (0.6 * realized + 0.2 * inv * (hmid - mid) + 0.3 * fill)", "realized_lot_horizon")}, {sql6("2 * (0.5 * path + 0.25 * day)", "multi_horizon_path")} from z""")
def projected_rewards(spark, sf_dir):
    """Seven ways to reward a decision by what follows: operator 146."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol_id").orderBy("local_ts_us", "event_id")
    e = F.col("event_id")
    q = quotes(spark, sf_dir).select("symbol_id", "event_id", "local_ts_us", F.col("mid").cast("double").alias("mid"), (F.col("mid") * ((e % 5) - 2)).cast("double").alias("equity"))
    before = F.coalesce(F.lag("equity").over(w), F.lit(0.0))
    anchors = q.select("symbol_id", e.alias("anchor_id"), "local_ts_us", F.lead("local_ts_us").over(w).alias("next_ts_us"), before.alias("previous_equity"), "equity", (F.col("equity") - before).alias("env_reward"), ((e % 7) - 3).cast("double").alias("inventory"), "mid", ((e * 3) % 11).cast("double").alias("realized"))
    t = events(spark, sf_dir).where("is_trade = 1 and side_code <> 0 and amount > 0").withColumn("__late", F.lit(2**62))
    facts = q.select("symbol_id", F.col("local_ts_us").alias("q_ts"), F.col("event_id").alias("q_id"), F.col("event_id").alias("anchor_id"))
    t = o.asof_join(t, facts, BY, ("local_ts_us", "__late"), ("q_ts", "q_id"), ["anchor_id"]).where("anchor_id is not null")
    made = t.select("anchor_id", "symbol_id", "local_ts_us", "side_code", F.col("price_tick").cast("double").alias("price"), F.col("amount").alias("qty"), (F.col("amount") * 0.01).alias("fee"))
    got = rewards.projected_rewards(anchors, made, q, BY, PROJECTION)
    return got.select("anchor_id", *(r6(n, n) for n in got.columns if n != "anchor_id"))


# fills by candidate


def _queue(name: str, side: int):
    return F.lit(0.0) if name.startswith("inside") else F.col("bid_sz" if side > 0 else "ask_sz") * (2 if name.startswith("away") else 1)


def _orders(spark, sf_dir):
    return fills.candidate_orders(quotes(spark, sf_dir), BY, CANDIDATES, _queue)


def _labels(orders, spark, sf_dir):
    end = events(spark, sf_dir).agg(F.max("local_ts_us").alias("end_ts"))
    judged = fills.adverse_labels(orders.crossJoin(F.broadcast(end)), quotes(spark, sf_dir), BY, H6, "end_ts", toxic_bps=1.0, wait_us=H24)
    got = fills.labels_by_decision(judged, CANDIDATES)
    return got.select("event_id", *(r6(n, n) for n in got.columns if n != "event_id"))


def _six() -> str:
    move = {"touch": 0, "inside_1": 1, "away_1": -1}
    parts = []
    for i, (n, s) in enumerate((n, s) for n in CANDIDATES for s in (1, -1)):
        price = f"(best_bid_tick + {move[n]})" if s > 0 else f"(best_ask_tick - {move[n]})"
        queue = "0.0" if n == "inside_1" else f"{'bid_sz' if s > 0 else 'ask_sz'} * {2 if n == 'away_1' else 1}"
        safe = "<= best_ask_tick - 1" if s > 0 else ">= best_bid_tick + 1"
        parts.append(f"select event_id * 6 + {i} as order_id, event_id, '{n}' as candidate, {s} as side_code, symbol_id, local_ts_us, {price} as price_tick, {queue} as queue from ev where is_trade = 0 and {price} {safe}")
    return " union all ".join(parts)


_LABELS = f"""{EV_SQL}, o as ({_six()}), t as (select * from ev where is_trade = 1 and amount > 0),
h as (select o.*, t.event_id as tid, t.local_ts_us as tts, (o.price_tick - t.price_tick) * o.side_code > 0 as through, sum(case when o.price_tick = t.price_tick then 0.5 * t.amount else 0 end) over (partition by o.order_id order by t.local_ts_us, t.event_id) as worn
  from o join t on t.symbol_id = o.symbol_id and t.side_code = -o.side_code and t.local_ts_us > o.local_ts_us + {HOUR} and t.local_ts_us <= o.local_ts_us + {HOUR + H24} and (o.price_tick - t.price_tick) * o.side_code >= 0),
ff as (select order_id, min(tts) as fill_ts from h where through or worn > queue + 1e-12 group by order_id),
q as (select symbol_id, local_ts_us, arg_min((best_bid_tick + best_ask_tick) * 0.5::double, event_id) as mid from ev where is_trade = 0 group by all), en as (select max(local_ts_us) as end_ts from ev),
j as (select o.*, fill_ts, q.mid as fm, end_ts >= o.local_ts_us + {H24} as done from o left join ff using (order_id) cross join en asof left join q on q.symbol_id = o.symbol_id and q.local_ts_us >= fill_ts + {H6}),
l as (select *, case when fm is not null then greatest(side_code * (price_tick - fm) / price_tick * 1e4, 0) end as adv from j),
m as (select *, case when fill_ts is not null then 1 when done then 0 end as filled, fill_ts - local_ts_us as latency, case when adv is not null then (adv > 1)::int end as toxic, case when fill_ts is not null then adv when done then 0 end as cost from l)
select event_id, {", ".join(sql6(f"max({c}) filter (candidate = '{n}' and side_code = {s})", f"{'bid' if s > 0 else 'ask'}_{n}_{label}") for n in CANDIDATES for label, c in (("filled", "filled"), ("fill_latency_us", "latency"), ("adverse_bps", "adv"), ("toxic_fill", "toxic"), ("toxic_cost_bps", "cost")) for s in (1, -1))} from m group by event_id"""


@query("adverse_labels_by_candidate", _LABELS)
def adverse_labels_by_candidate(spark, sf_dir):
    """Ten labels for each of three candidates on both sides, by the closed form of conservative fills: operators 133, 135 and 136."""
    filled = fills.conservative_fills(_orders(spark, sf_dir), events(spark, sf_dir).where("is_trade = 1 and amount > 0"), BY, H24, HOUR, 0.5)
    return _labels(filled, spark, sf_dir)


@query("adverse_labels_balanced")
def adverse_labels_balanced(spark, sf_dir):
    """The same labels by a replay in which size that leaves a level wears the queue too: operators 132 and 134."""
    orders = _orders(spark, sf_dir).drop("queue")
    filled = fills.replayed_fills(orders, events(spark, sf_dir).where("is_trade = 0 or amount > 0"), BY, wait_us=H24, delay_us=HOUR, unknown=20.0)
    return _labels(filled, spark, sf_dir)


@query("edge_requirements", "select * from (values " + ", ".join(f"('{n}')" for n in contracts.edge_targets(CANDIDATES)) + ") t(target)")
def edge_requirements(spark, sf_dir):
    """The targets that the executable edge needs, checked against the labels' columns: operator 32."""
    have = [f"{side}_{n}_{label}" for n in CANDIDATES for label in fills.LABELS for side in ("bid", "ask")]
    contracts.require_edge_targets(have, CANDIDATES)
    wanted = contracts.edge_targets(CANDIDATES)
    return spark.createDataFrame([(n,) for n in have if n in set(wanted)], "target string")


# observations and quotes

_FIELD_SQL = {
    "spread_ticks": "g", "spread_bps": "g * 0.1 / mid * 1e4", "mid_price": "mid", "microprice_bps": "((best_bid_tick * ask_sz + best_ask_tick * bid_sz) * 0.1 / (bid_sz + ask_sz) - mid) / mid * 1e4",
    "top_imbalance": "(bid_sz - ask_sz) / (bid_sz + ask_sz)", "bid_depth_count": "e % 25", "ask_depth_count": "e % 23", "bid_top_size": "bid_sz", "ask_top_size": "ask_sz",
    "depth_imbalance_5": "((e % 13) - 6) / 6.0", "flow_signed_qty_200ms": "((e % 5) - 2)::double", "linear_confidence": "(e % 10) / 10.0",
    "cash": "cash", "inventory_qty": "inv", "inventory_notional": "inv * mid * 2", "inventory_order_units": "inv / 0.5", "equity": "cash + inv * mid * 2", "inventory_abs_notional": "abs(inv * mid * 2)", "fees_paid": "(e % 4) * 0.25",
    "has_live_bid": "hb::int", "has_live_ask": "ha::int", "bid_distance_ticks": "case when hb then e % 3 else 0 end", "ask_distance_ticks": "case when ha then greatest(1 - e % 3, 0) else 0 end",
    "bid_distance_bps": "case when hb then (e % 3) * 0.1 / mid * 1e4 else 0 end", "ask_distance_bps": "case when ha then greatest(1 - e % 3, 0) * 0.1 / mid * 1e4 else 0 end",
    "bid_qty": "case when hb then 2 else 0 end", "ask_qty": "case when ha then 3 else 0 end", "bid_remaining_qty": "case when hb then 1.5 else 0 end", "ask_remaining_qty": "case when ha then 1 else 0 end",
    "bid_queue_ahead_qty": "case when hb then bid_sz else 0 end", "ask_queue_ahead_qty": "case when ha then ask_sz else 0 end", "bid_age_ms": "case when hb then 7 else 0 end", "ask_age_ms": "case when ha then 9 else 0 end",
    "last_fill_side": "case when nf > 0 then case when nf = 2 then -1 else 1 end else 0 end", "last_fill_qty": "nf * 0.5", "last_fill_notional": "nf * 0.5 * (best_bid_tick + nf) * 0.1 * 2", "last_fill_fee": "nf * 0.125",
    "last_fill_age_ms": "case when nf > 0 then 5 else 0 end", "step_fill_count": "nf", "step_buy_fill_qty": "case when nf > 0 then 0.5 else 0 end", "step_sell_fill_qty": "case when nf = 2 then 1 else 0 end",
    "step_fill_notional": "case when nf > 0 then 0.5 * (best_bid_tick + 1) * 0.1 * 2 else 0 end + case when nf = 2 then 1.0 * (best_bid_tick + 2) * 0.1 * 2 else 0 end",
    "local_time_since_start_s": "(local_ts_us - t0) / 1e6", "time_since_last_event_ms": "coalesce((local_ts_us - before) / 1e3, 0)",
}


@query("observation_fields", f"""{EV_SQL}, s as (select symbol_id, min(local_ts_us) as t0 from ev where is_trade = 0 group by 1),
x as (select ev.*, event_id as e, best_ask_tick - best_bid_tick as g, (best_bid_tick + best_ask_tick) * 0.5 * 0.1 as mid, ((event_id % 9) - 4) * 0.5::double as inv, ((event_id % 17) - 8) * 3.0::double as cash, event_id % 2 = 0 as hb, event_id % 5 < 3 as ha, event_id % 3 as nf, t0, lag(local_ts_us) over (partition by ev.symbol_id order by local_ts_us, event_id) as before from ev join s using (symbol_id) where is_trade = 0)
select event_id, {", ".join(sql6(f"least(greatest({_FIELD_SQL.get(n, '0')}, -1e7), 1e7)", n) for n in observations.FIELDS)} from x""")
def observation_fields(spark, sf_dir):
    """All 73 fields of an observation at every quote: operator 145."""
    from pyspark.sql import Window

    e, now = F.col("event_id"), F.col("local_ts_us")
    q = events(spark, sf_dir).where("is_trade = 0")
    start = q.groupBy("symbol_id").agg(F.min("local_ts_us").alias("start_ts_us"))
    w = Window.partitionBy("symbol_id").orderBy("local_ts_us", "event_id")
    order = lambda on, tick, qty, left, queue, age: F.when(on, F.struct(tick.cast("long").alias("price_tick"), F.lit(qty).alias("qty"), F.lit(left).alias("remaining"), F.col(queue).alias("queue"), (now - age).alias("created_us")))
    one = lambda i, side: F.struct((now - 5000).alias("local_ts_us"), F.lit(side).alias("side_code"), (F.col("best_bid_tick") + i).cast("long").alias("price_tick"), F.lit(0.5 * i).alias("qty"), F.lit(0.125 * i).alias("fee"))
    some = F.array(one(1, 1), one(2, -1))
    rows = q.join(F.broadcast(start), "symbol_id").select(
        "*", F.lag("local_ts_us").over(w).alias("prev_ts_us"), (e % 25).alias("bid_levels"), (e % 23).alias("ask_levels"),
        (((e % 17) - 8) * 3.0).alias("cash"), (((e % 9) - 4) * 0.5).alias("inventory_qty"), ((e % 4) * 0.25).alias("fees_paid"),
        order(e % 2 == 0, F.col("best_bid_tick") - e % 3, 2.0, 1.5, "bid_sz", 7000).alias("bid_order"), order(e % 5 < 3, F.col("best_ask_tick") + 1 - e % 3, 3.0, 1.0, "ask_sz", 9000).alias("ask_order"),
        F.slice(some, F.lit(1), (e % 3).cast("int")).alias("fills"), (((e % 13) - 6) / 6.0).alias("depth_imbalance_5"), ((e % 5) - 2).alias("flow_signed_qty_200ms"), ((e % 10) / 10.0).alias("linear_confidence"),
    )
    got = observations.observations(rows, ["event_id"], 0.1, 2.0, 0.5, 1e7)
    return got.select("event_id", *(r6(n, n) for n in observations.FIELDS))


def _quote_sql() -> str:
    """Both sides by the same steps: ticks, sizes, the first reason against, then quotes that meet."""
    steps = []
    for side, s in (("bid", 1), ("ask", -1)):
        low, high = ("greatest(1, best_bid_tick - 3)", "(best_ask_tick - 1)") if s > 0 else ("(best_bid_tick + 1)", "(best_ask_tick + 3)")
        raw = f"((event_id % {11 if s > 0 else 13}) - {5 if s > 0 else 6}) / 2.0"
        share = f"1 / (1 + exp(-({raw})))" if s > 0 else f"1 - 1 / (1 + exp(-({raw})))"
        tick = f"({low} + least(floor(({share}) * ({high} - {low} + 1)), {high} - {low}))"
        target = f"0.1::double + 1 / (1 + exp(-(((event_id % {7 if s > 0 else 5}) - 3)::double + ln(0.15 / 1.9 / (1 - 0.15 / 1.9))))) * 1.9"
        steps.append((side, s, tick, f"least(floor(({target}) / 0.05 + 1e-12) * 0.05, 2.0)"))
    columns = ", ".join(f"{t}::bigint as {n}_t, {q} as {n}_q" for n, _, t, q in steps)
    why = ", ".join(f"""case when event_id % {4 if s > 0 else 6} = 0 then 'disabled_by_action' when {n}_q <= 0 then 'qty_below_min' when {s} * inv >= 3 then 'inventory_limit'
      when {n}_q * {n}_t * 0.1 < 20 - 1e-12 then 'notional_below_min' when abs(inv + {s} * {n}_q) * (best_bid_tick + best_ask_tick) * 0.05 > 250 then 'position_notional_limit' else '' end as {n}_w""" for n, s, _, _ in steps)
    out = ", ".join(f"case when {n}_r = '' then {n}_t else 0 end as {n}_tick, {sql6(f'case when {n}_r = {chr(39) * 2} then {n}_q else 0 end', f'{n}_qty')}, greatest(0, {'best_bid_tick - bid_t' if s > 0 else 'ask_t - best_ask_tick'} + 1) as {n}_offset, {n}_r as {n}_reason" for n, s, _, _ in steps)
    return f"""{EV_SQL}, a as (select *, ((event_id % 9) - 4)::double as inv, {columns} from ev where is_trade = 0), b as (select *, {why} from a),
c as (select *, case when bid_w = '' and ask_w = '' and bid_t >= ask_t then 'invalid_geometry' else bid_w end as bid_r, case when bid_w = '' and ask_w = '' and bid_t >= ask_t then 'invalid_geometry' else ask_w end as ask_r from b)
select event_id, {out} from c"""


@query("quotes_from_actions", _quote_sql())
def quotes_from_actions(spark, sf_dir):
    """Actions to quotes with limits and the reasons against them: operator 113."""
    e = F.col("event_id")
    rows = events(spark, sf_dir).where("is_trade = 0").select("event_id", "best_bid_tick", "best_ask_tick", ((e % 9) - 4).cast("double").alias("inventory"), (e % 4 != 0).alias("bid_on"), (e % 6 != 0).alias("ask_on"), (((e % 11) - 5) / 2.0).alias("bid_price_raw"), (((e % 13) - 6) / 2.0).alias("ask_price_raw"), ((e % 7) - 3).alias("bid_size_raw"), ((e % 5) - 3).alias("ask_size_raw"))
    got = observations.quotes_from_actions(rows, ["event_id"], 4, 1, 0.1, 0.1, 2.0, 0.25, 0.05, 20.0, 3.0, 250.0)
    return got.withColumns({n: r6(n) for n in ("bid_qty", "ask_qty")})
