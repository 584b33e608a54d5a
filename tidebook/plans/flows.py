"""Books, decisions, flow and fills: operators 60 to 63, 77 to 79, 83, 88, 121 to 137 and 144."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.functions import kernels as k
from tidebook.operators import execution as x
from tidebook.operators import fills, flows, folds
from tidebook.operators import ordered as o
from tidebook.plans.common import H6, H12, H24, HOUR, r6, sql6
from tidebook.plans.labels import quotes
from tidebook.plans.registry import query
from tidebook.sources.market import EV_SQL, L2_SQL, events, l2_updates

BY = ["symbol_id"]
BUCKET = 20_000


def cents(ev):
    """Trades with a whole number of hundredths as their quantity."""
    return ev.where("is_trade = 1").withColumn("qty", F.floor(F.col("amount") * 100 + 0.5).cast("long")).where("qty > 0")


_CENTS = "select *, floor(amount * 100 + 0.5)::bigint as qty from ev where is_trade = 1 and floor(amount * 100 + 0.5) > 0"
_BUCKETS = f"""{EV_SQL}, t as ({_CENTS} and side_code <> 0), c as (select *, (sum(qty) over (partition by symbol_id order by local_ts_us, event_id))::bigint as hi from t),
u as (select *, hi - qty as lo from c), p as (select symbol_id, side_code, lo, hi, local_ts_us, unnest(range(lo // {BUCKET}, (hi - 1) // {BUCKET} + 1)) as bucket from u),
b as (select symbol_id, bucket, sum(case when side_code > 0 then least(hi, (bucket + 1) * {BUCKET}) - greatest(lo, bucket * {BUCKET}) else 0 end)::bigint as buy,
  sum(case when side_code < 0 then least(hi, (bucket + 1) * {BUCKET}) - greatest(lo, bucket * {BUCKET}) else 0 end)::bigint as sell, max(local_ts_us) as closed_at from p group by symbol_id, bucket),
f as (select * from b where buy + sell = {BUCKET})"""


@query("vpin", f"""{_BUCKETS} select symbol_id, bucket, buy, sell, closed_at, {sql6(f"case when count(*) over w >= 5 then sum(abs(buy - sell)) over w / (count(*) over w * {BUCKET}.0) else 0 end", "vpin", 10)}
from f window w as (partition by symbol_id order by bucket rows between 19 preceding and current row)""")
def vpin(spark, sf_dir):
    """Operator 129."""
    b = flows.volume_buckets(cents(events(spark, sf_dir)), BY, "local_ts_us", ["event_id"], "qty", "side_code", BUCKET)
    got = flows.vpin(b, BY, BUCKET, 20, 5)
    return got.select("symbol_id", "bucket", "buy", "sell", "closed_at", r6("vpin", "vpin", 10))


_SAMPLES = f"""{EV_SQL}, q as (select *, (best_bid_tick + best_ask_tick) * 0.5::double as mid from ev where is_trade = 0), s as (select symbol_id, min(local_ts_us) as t0, max(local_ts_us) as t1 from q group by 1),
g as (select symbol_id, t0, t1, unnest(range(0, (t1 - t0) // {H6} + 1)) as i from s), h as (select symbol_id, i, t0 + i * {H6} as t, t0 + i * {H6} + {H12} as e from g where t0 + i * {H6} + {H12} <= t1),
fl as (select c.symbol_id, ((local_ts_us - t0 + {H6} - 1) // {H6}) as i, sum(side_code * qty)::double as flow from ({_CENTS}) c join s using (symbol_id) where local_ts_us >= t0 - {H6} group by 1, 2),
sm as (select h.symbol_id, h.i, h.t, coalesce(flow, 0) as flow, b.mid - a.mid as response from h left join fl on fl.symbol_id = h.symbol_id and fl.i = h.i
  asof join q a on a.symbol_id = h.symbol_id and a.local_ts_us <= h.t asof join q b on b.symbol_id = h.symbol_id and b.local_ts_us <= h.e)"""


def samples(spark, sf_dir):
    return flows.response_samples(cents(events(spark, sf_dir)), quotes(spark, sf_dir), BY, H6, H12)


@query("kyle_samples", f"{_SAMPLES} select symbol_id, i, t, flow, response from sm")
def kyle_samples(spark, sf_dir):
    """Operator 130."""
    return samples(spark, sf_dir)


@query("kyle_lambda", f"""{_SAMPLES} select symbol_id, i, {sql6("case when count(*) over w >= 5 and var_pop(flow) over w > 1e-12 then 1e6 * regr_slope(response, flow) over w else 0 end", "slope_e6")},
  {sql6("case when count(*) over w >= 5 and var_pop(flow) over w > 1e-12 and var_pop(response) over w > 1e-12 then regr_r2(response, flow) over w else 0 end", "r2")}
from sm window w as (partition by symbol_id order by t range between {5 * H24} preceding and current row)""")
def kyle_lambda(spark, sf_dir):
    """Operator 78."""
    got = flows.kyle_lambda(samples(spark, sf_dir), BY, 5 * H24)
    return got.select("symbol_id", "i", r6(F.col("slope") * 1e6, "slope_e6"), r6("r2", "r2"))


def _flow_sql(u: int, tag: str) -> str:
    buy, sell = (f"coalesce(sum(amount) filter (is_trade = 1 and side_code {c} 0) over {tag}, 0)" for c in (">", "<"))
    return ", ".join([sql6(buy, f"buy_{tag}"), sql6(sell, f"sell_{tag}"), sql6(f"{buy} - {sell}", f"signed_{tag}"), sql6(f"{buy} + {sell}", f"abs_{tag}"), sql6(f"coalesce(sum(price_tick * amount) filter (is_trade = 1) over {tag}, 0)", f"notional_{tag}"), f"count(*) filter (is_trade = 1) over {tag} as count_{tag}", sql6(f"case when {buy} + {sell} > 1e-9 then ({buy} - {sell}) / ({buy} + {sell}) else 0 end", f"ratio_{tag}")])


_TAGS = {"h6": H6, "h12": H12, "h24": H24}


@query("trade_flow_windows", f"{EV_SQL} select event_id, {', '.join(_flow_sql(u, t) for t, u in _TAGS.items())} from ev window {', '.join(f'{t} as (partition by symbol_id order by 2 * local_ts_us + is_trade range between {2 * u} preceding and current row)' for t, u in _TAGS.items())}")
def trade_flow_windows(spark, sf_dir):
    """Operators 69 and 77."""
    names = ("buy", "sell", "signed", "abs", "notional", "count", "ratio")
    ev = events(spark, sf_dir)
    got = o.range_features(ev, BY, "local_ts_us", o.key2(), H24, lambda frames: {n: c for t, u in _TAGS.items() for n, c in flows.flow_windows(frames, u, t).items()})
    return got.select("event_id", *(F.col(f"{n}_{t}") if n == "count" else r6(f"{n}_{t}", f"{n}_{t}") for t in _TAGS for n in names))


@query("l2_batches", f"{L2_SQL} select local_ts_us, count(*) as n_updates, count(*) filter (side = 'bid') as n_bids, count(*) filter (amount = 0) as n_deletes from l2 group by local_ts_us")
def l2_batches(spark, sf_dir):
    """Operators 8 and 121."""
    u = l2_updates(spark, sf_dir)
    return u.groupBy("local_ts_us").agg(F.count("*").alias("n_updates"), F.count_if(F.col("side") == "bid").alias("n_bids"), F.count_if(F.col("amount") == 0).alias("n_deletes"))


_BOOK_SQL = f"""{L2_SQL}, iv as (select side, price_tick, amount, local_ts_us as t0, lead(local_ts_us) over (partition by side, price_tick order by local_ts_us) as t1 from l2), b as (select distinct local_ts_us from l2),
bk as (select b.local_ts_us, max(case when side = 'bid' then price_tick end) as best_bid_tick, min(case when side = 'ask' then price_tick end) as best_ask_tick, count(*) as levels, {sql6("sum(amount)", "total_size")}
from b join iv on iv.t0 <= b.local_ts_us and (iv.t1 is null or b.local_ts_us < iv.t1) and iv.amount > 0 group by b.local_ts_us)"""


@query("book_by_intervals", f"{_BOOK_SQL} select * from bk")
def book_by_intervals(spark, sf_dir):
    """The closed form of operator 122."""
    got = folds.book_by_intervals(l2_updates(spark, sf_dir), [])
    return got.select("local_ts_us", "best_bid_tick", "best_ask_tick", "levels", r6("total_size", "total_size"))


def _stream(spark, sf_dir):
    """Level updates as a source delivers them: the first batch is the snapshot."""
    u = l2_updates(spark, sf_dir)
    first = u.agg(F.min("local_ts_us").alias("t0"))
    u = u.crossJoin(F.broadcast(first)).withColumn("is_snapshot", F.col("local_ts_us") == F.col("t0")).withColumn("symbol_id", F.lit(0))
    return u.withColumn("source_row", F.xxhash64("local_ts_us", "side", "price_tick")).drop("t0")


@query("book_rebuilt", f"{_BOOK_SQL} select * from bk")
def book_rebuilt(spark, sf_dir):
    """The fold of operators 122 and 123 over a book without crossings gives the closed form's rows."""
    got = folds.rebuild_book(_stream(spark, sf_dir), BY).where("levels > 0")
    return got.select("local_ts_us", "best_bid_tick", "best_ask_tick", "levels", r6("total_size", "total_size"))


@query("book_top_levels", f"""{L2_SQL}, iv as (select side, price_tick, amount, local_ts_us as t0, lead(local_ts_us) over (partition by side, price_tick order by local_ts_us) as t1 from l2),
b as (select distinct local_ts_us from l2), lv as (select b.local_ts_us, side, price_tick, amount, row_number() over (partition by b.local_ts_us, side order by case side when 'bid' then -price_tick else price_tick end) as r
from b join iv on iv.t0 <= b.local_ts_us and (iv.t1 is null or b.local_ts_us < iv.t1) and iv.amount > 0) select local_ts_us, side, (r - 1)::int as level, price_tick, amount from lv where r <= 5""")
def book_top_levels(spark, sf_dir):
    """The five best levels a side after every batch: operator 88."""
    return _levels(folds.rebuild_book(_stream(spark, sf_dir), BY, 5))


def _levels(got):
    side = lambda s: got.select("local_ts_us", F.lit(s).alias("side"), F.posexplode(F.arrays_zip(f"{s}_px", f"{s}_sz")).alias("level", "x")).select("local_ts_us", "side", "level", F.col(f"x.{s}_px").alias("price_tick"), F.col(f"x.{s}_sz").alias("amount"))
    return side("bid").unionByName(side("ask"))


@query("l2_quality_audit", f"""{_BOOK_SQL} select count(*) as n_batches, count(*) filter (best_bid_tick is null or best_ask_tick is null) as n_one_sided, min(best_ask_tick - best_bid_tick) as least_spread, {sql6("avg(best_ask_tick - best_bid_tick)", "mean_spread")}, max(best_ask_tick - best_bid_tick) as most_spread, max(levels) as most_levels, 0::bigint as n_crossed from bk""")
def l2_quality_audit(spark, sf_dir):
    """Operators 62 and 63."""
    b = folds.rebuild_book(_stream(spark, sf_dir), BY).where("levels > 0")
    gap = F.col("best_ask_tick") - F.col("best_bid_tick")
    return b.agg(F.count("*").alias("n_batches"), F.count_if(gap.isNull()).alias("n_one_sided"), F.min(gap).alias("least_spread"), r6(F.avg(gap), "mean_spread"), F.max(gap).alias("most_spread"), F.max("levels").alias("most_levels"), F.sum((F.col("crossed_removed") > 0).cast("long")).alias("n_crossed"))


@query("decision_grid", f"""{EV_SQL}, t as (select *, row_number() over w as rn, sum(is_trade) over w as nt, sum(1 - is_trade) over w as nb from ev window w as (partition by symbol_id order by local_ts_us, is_trade, event_id)),
q as (select *, lag(nt) over w as pnt, lag(best_bid_tick) over w as pb, lag(best_ask_tick) over w as pa, lag(bid_sz) over w as pbs, lag(ask_sz) over w as pas from t where is_trade = 0 window w as (partition by symbol_id order by local_ts_us, event_id)),
f as (select *, case when pb is null then 8 else (case when nt > pnt then 2 else 0 end) + (case when pb <> best_bid_tick or pa <> best_ask_tick or pbs <> bid_sz or pas <> ask_sz then 4 else 0 end) end as flags from q),
d as (select * from f where flags > 0)
select symbol_id, event_id, local_ts_us, (case when flags = 8 then 8 when flags in (2, 6) then 2 else 4 end)::int as reason, flags::int as flags, local_ts_us - lag(local_ts_us) over w as elapsed_us, rn - coalesce(lag(rn) over w, 0) as events_since, (nb - coalesce(lag(nb) over w, 0))::bigint as books_since, (nt - coalesce(lag(nt) over w, 0))::bigint as trades_since
from d window w as (partition by symbol_id order by local_ts_us, event_id)""")
def decision_grid(spark, sf_dir):
    """Decisions with no least interval and a heartbeat that never comes have a closed form: operators 124 and 125."""
    return folds.decision_grid(events(spark, sf_dir), BY, 0, 2**62)


@query("decision_grid_heartbeat")
def decision_grid_heartbeat(spark, sf_dir):
    """With an hour at least and six at most between decisions, and size changes of a quarter."""
    return folds.decision_grid(events(spark, sf_dir), BY, HOUR, H6, 0.25)


@query("ewma_normalised")
def ewma_normalised(spark, sf_dir):
    """Operators 80 and 128; tests hold it against a plain loop."""
    return folds.ewma_normalise(events(spark, sf_dir), BY, ["local_ts_us", "event_id"], ["amount", "bid_sz"], float(H24))


@query("ewma_mean", f"""{EV_SQL}, x as (select *, row_number() over w as i, exp(ln(2.0) * (local_ts_us - min(local_ts_us) over (partition by symbol_id)) / {10 * H24}.0) as e, local_ts_us - lag(local_ts_us) over w as dt from ev window w as (partition by symbol_id order by local_ts_us, event_id)),
y as (select *, case when i = 1 then bid_sz else (1 - pow(2.0, -dt / {10 * H24}.0)) * bid_sz end as a from x)
select event_id, {sql6("sum(a * e) over (partition by symbol_id order by i) / e", "ewma")} from y""")
def ewma_mean(spark, sf_dir):
    """The time-decayed mean alone has a closed form: a running sum of weighted values."""
    ev = o.previous(events(spark, sf_dir), BY, "local_ts_us", ["event_id"], ["local_ts_us"])
    start = events(spark, sf_dir).groupBy("symbol_id").agg(F.min("local_ts_us").alias("t0"))
    ev = ev.join(F.broadcast(start), "symbol_id")
    half = float(10 * H24)
    e = F.exp(F.lit(0.6931471805599453) * (F.col("local_ts_us") - F.col("t0")) / half)
    a = F.when(F.col("prev_local_ts_us").isNull(), F.col("bid_sz")).otherwise(k.ewma_alpha(F.col("local_ts_us") - F.col("prev_local_ts_us"), half) * F.col("bid_sz"))
    got = o.running_sum(ev.withColumn("e", e), BY, "local_ts_us", ["event_id"], a * e, "s")
    return got.select("event_id", r6(F.col("s") / F.col("e"), "ewma"))


@query("fifo_lots")
def fifo_lots(spark, sf_dir):
    """Operator 137."""
    f = events(spark, sf_dir).where("is_trade = 1 and side_code <> 0 and amount > 0").select("symbol_id", "event_id", "local_ts_us", "side_code", F.col("amount").alias("qty"), F.col("price_tick").cast("double").alias("price"))
    return folds.fifo_lots(f, BY, ["local_ts_us", "event_id"], 0.5)


@query("fifo_position", f"{EV_SQL} select event_id, {sql6('sum(side_code * amount) over (partition by symbol_id order by local_ts_us, event_id)', 'position')} from ev where is_trade = 1 and side_code <> 0 and amount > 0")
def fifo_position(spark, sf_dir):
    """The ledger's position is the running sum of signed fills."""
    return fifo_lots(spark, sf_dir).select("event_id", r6("position", "position"))


_ORDERS = f"""{EV_SQL}, o as (select event_id as order_id, symbol_id, local_ts_us, 1 as side_code, best_bid_tick as price_tick, bid_sz as queue from ev where is_trade = 0), t as (select * from ev where is_trade = 1 and amount > 0),
h as (select o.*, t.event_id as tid, t.local_ts_us as tts, t.price_tick < o.price_tick as through, sum(case when t.price_tick < o.price_tick then 0 else 0.5 * t.amount end) over (partition by o.order_id order by t.local_ts_us, t.event_id) as worn
  from o join t on t.symbol_id = o.symbol_id and t.local_ts_us > o.local_ts_us + {HOUR} and t.local_ts_us <= o.local_ts_us + {HOUR + H24} and t.side_code = -1 and t.price_tick <= o.price_tick),
ff as (select order_id, min(tts) as fill_ts, arg_min(tid, tts) as fill_event, arg_min(case when through then 'trade_through' else 'queue_consumed' end, tts) as fill_reason from h where through or worn > queue + 1e-12 group by order_id)"""


def bid_orders(spark, sf_dir):
    q = events(spark, sf_dir).where("is_trade = 0")
    orders = q.select(F.col("event_id").alias("order_id"), "symbol_id", "local_ts_us", F.lit(1).alias("side_code"), F.col("best_bid_tick").alias("price_tick"), F.col("bid_sz").alias("queue"))
    return fills.conservative_fills(orders, events(spark, sf_dir).where("is_trade = 1 and amount > 0"), BY, H24, HOUR, 0.5)


@query("conservative_fills", f"{_ORDERS} select o.order_id, fill_ts, fill_event, fill_reason from o left join ff using (order_id)")
def conservative_fills(spark, sf_dir):
    """Operators 44 and 133."""
    return bid_orders(spark, sf_dir).select("order_id", "fill_ts", "fill_event", "fill_reason")


@query("adverse_labels", f"""{_ORDERS}, q as (select symbol_id, local_ts_us, arg_min((best_bid_tick + best_ask_tick) * 0.5::double, event_id) as mid from ev where is_trade = 0 group by all), en as (select max(local_ts_us) as end_ts from ev),
j as (select o.*, fill_ts, q.mid as fm, end_ts from o left join ff using (order_id) cross join en asof left join q on q.symbol_id = o.symbol_id and q.local_ts_us >= fill_ts + {H6}),
l as (select *, case when fm is not null then greatest((price_tick - fm) / price_tick * 1e4, 0) end as adv from j)
select order_id, case when fill_ts is not null then 1 when end_ts >= local_ts_us + {H6} then 0 end::int as filled, fill_ts - local_ts_us as latency_us, {sql6("adv", "adverse_bps")}, case when adv is not null then (adv > 0)::int end as toxic,
  {sql6(f"case when fill_ts is not null then adv when end_ts >= local_ts_us + {H6} then 0 end", "cost_bps")} from l""")
def adverse_labels(spark, sf_dir):
    """Operators 135 and 136."""
    end = events(spark, sf_dir).agg(F.max("local_ts_us").alias("end_ts"))
    f = bid_orders(spark, sf_dir).crossJoin(F.broadcast(end))
    got = fills.adverse_labels(f, quotes(spark, sf_dir), BY, H6, "end_ts")
    return got.select("order_id", "filled", "latency_us", r6("adverse_bps", "adverse_bps"), "toxic", r6("cost_bps", "cost_bps"))


@query("equity_drawdown", f"""{EV_SQL}, f as (select * from ev where is_trade = 1 and side_code <> 0 and amount > 0),
c as (select *, sum(side_code * amount) over w as pos, sum(-side_code * amount * price_tick + amount * price_tick * 0.5 / 1e4) over w as cash from f window w as (partition by symbol_id order by local_ts_us, event_id rows between unbounded preceding and current row)), e as (select *, cash + pos * price_tick as eq from c)
select event_id, {sql6("pos", "position")}, round(eq * 1e7)::bigint as equity_e7, round((greatest(max(eq) over (partition by symbol_id order by local_ts_us, event_id rows between unbounded preceding and current row), 0) - eq) * 1e7)::bigint as drawdown_e7 from e""")
def equity_drawdown(spark, sf_dir):
    """Positions, equity and drawdown from fills with a rebate of half a basis point: operators 60, 67, 83 and 144."""
    f = events(spark, sf_dir).where("is_trade = 1 and side_code <> 0 and amount > 0")
    got = x.positions(f, BY, ["local_ts_us", "event_id"], "side_code", "amount", "price_tick", -0.5)
    return got.select("event_id", r6("position", "position"), *(F.round(F.col(c) * 1e7).cast("long").alias(f"{c}_e7") for c in ("equity", "drawdown")))
