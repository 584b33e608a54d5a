"""Forward-return labels and look-ups in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions import kernels as k
from tidebook.operators import ordered as o
from tidebook.plans.common import H6, H12, H24, HOUR, WEEK, r6, sql6
from tidebook.plans.registry import query
from tidebook.sources.market import EV_SQL, events

MAX_SEQ = 2**62
DELAY = 1_000_000
HORIZONS = {"6h": H6, "12h": H12, "24h": H24}

_DECISIONS_SQL = f"""{EV_SQL},
q as (select *, (best_bid_tick + best_ask_tick) * 0.5::double as mid from ev where is_trade = 0),
d as (select * from (select *, lag(best_bid_tick) over w as pb, lag(best_ask_tick) over w as pa from q window w as (partition by symbol_id order by local_ts_us, event_id))
      where pb is null or pb <> best_bid_tick or pa <> best_ask_tick),
ends as (select symbol_id, max(local_ts_us) as last_ts from q group by symbol_id)"""


def quotes(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).where("is_trade = 0").withColumn("mid", k.mid_price("best_bid_tick", "best_ask_tick"))


def decisions(spark, sf_dir) -> DataFrame:
    """Quotes at which the best bid or ask differs from the quote before."""
    seen = o.previous(quotes(spark, sf_dir), ["symbol_id"], "local_ts_us", ["event_id"], ["best_bid_tick", "best_ask_tick"])
    first = F.col("prev_best_bid_tick").isNull()
    return seen.where(first | (F.col("prev_best_bid_tick") != F.col("best_bid_tick")) | (F.col("prev_best_ask_tick") != F.col("best_ask_tick")))


def forward_returns(decided: DataFrame, prices: DataFrame, delay_us: int, horizons: dict[str, int], slice_us: int = o.SLICE_US) -> DataFrame:
    """``decided`` with ``entry_mid`` and ``ret_<horizon>_bps``: 1e4 ln(exit / entry) on the mid prices in force.

    The entry is read at the decision's own key without a delay, else after all events of its microsecond; an exit is read
    after all events of its. A label is null unless prices reach its exit. One look-up serves the entry and all exits: each
    decision asks at every one of its times, and its answers meet again. Rows that are alike in all columns stay as many.
    """
    facts = prices.select("symbol_id", F.col("local_ts_us").alias("f_ts"), F.col("event_id").alias("f_seq"), "mid")
    entry = F.col("local_ts_us") + delay_us
    at = lambda which, ts, seq: F.struct(F.lit(which).alias("which"), ts.alias("ts"), seq.cast("long").alias("seq"))
    times = [at(0, entry, F.lit(MAX_SEQ) if delay_us else F.col("event_id")), *(at(i, entry + h, F.lit(MAX_SEQ)) for i, h in enumerate(horizons.values(), 1))]
    asked = decided.withColumn("__at", F.explode(F.array(*times))).select("*", "__at.*").drop("__at")
    found = o.asof_join(asked, facts, ["symbol_id"], ("ts", "seq"), ("f_ts", "f_seq"), ["mid"], slice_us)
    mid = lambda which: F.max(F.when(F.col("which") == which, F.col("mid")))  # noqa: E731  alike in all rows of a group
    exits = [mid(i).alias(f"__exit_{n}") for i, n in enumerate(horizons, 1)]
    met = found.groupBy(*decided.columns).agg(mid(0).alias("entry_mid"), *exits, F.count_if(F.col("which") == 0).alias("__copies"))
    last = prices.groupBy("symbol_id").agg(F.max("local_ts_us").alias("__last"))
    returns = [F.when(F.col("__last") >= entry + h, k.log_return_bps(f"__exit_{n}", "entry_mid")).alias(f"ret_{n}_bps") for n, h in horizons.items()]
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__copy")
    return met.join(last, "symbol_id").select(*decided.columns, "entry_mid", *returns, copies).drop("__copy")


_JOINS = " ".join(f"asof left join qq x{n} on x{n}.symbol_id = e.symbol_id and x{n}.local_ts_us <= e.t_{n}" for n in HORIZONS)
_LABELS_SQL = f"""{_DECISIONS_SQL},
qq as (select symbol_id, local_ts_us, arg_max(mid, event_id) as mid from q group by symbol_id, local_ts_us),
e as (select d.event_id, d.symbol_id, d.local_ts_us, qq.mid as entry_mid, ends.last_ts, {", ".join(f"d.local_ts_us + {DELAY + h} as t_{n}" for n, h in HORIZONS.items())}
      from (select *, local_ts_us + {DELAY} as t from d) d join ends using (symbol_id)
      asof join qq on qq.symbol_id = d.symbol_id and qq.local_ts_us <= d.t)
select e.event_id, e.symbol_id, e.local_ts_us, e.entry_mid,
  {", ".join(sql6(f"case when e.last_ts >= e.t_{n} then 1e4 * ln(x{n}.mid / e.entry_mid) end", f"ret_{n}_bps") for n in HORIZONS)}
from e {_JOINS}"""


@query("label_forward_returns", _LABELS_SQL)
def label_forward_returns(spark, sf_dir):
    decided = decisions(spark, sf_dir).select("event_id", "symbol_id", "local_ts_us")
    out = forward_returns(decided, quotes(spark, sf_dir), DELAY, HORIZONS)
    return out.select("event_id", "symbol_id", "local_ts_us", "entry_mid", *(r6(f"ret_{n}_bps", f"ret_{n}_bps") for n in HORIZONS))


@query("asof_trade_quote", f"""{EV_SQL},
q as (select * from ev where is_trade = 0), t as (select * from ev where is_trade = 1)
select t.event_id, t.symbol_id, q.event_id as quote_id, q.best_bid_tick, q.best_ask_tick
from t asof left join q on q.symbol_id = t.symbol_id and q.local_ts_us <= t.local_ts_us""")
def asof_trade_quote(spark, sf_dir):
    """Each trade with the quote in force: operators 34 and 35."""
    ev = events(spark, sf_dir)
    q = ev.where("is_trade = 0").select("symbol_id", F.col("local_ts_us").alias("q_ts"), F.col("event_id").alias("quote_id"), "best_bid_tick", "best_ask_tick")
    t = ev.where("is_trade = 1").select("event_id", "symbol_id", "local_ts_us").withColumn("seq", F.lit(MAX_SEQ))
    return o.asof_join(t, q, ["symbol_id"], ("local_ts_us", "seq"), ("q_ts", "quote_id"), ["quote_id", "best_bid_tick", "best_ask_tick"]).drop("local_ts_us", "seq")


@query("asof_value_default", f"""{EV_SQL},
p as (select symbol_id, local_ts_us, price_tick::double as price from ev where is_trade = 1), t as (select * from ev where is_trade = 0)
select t.event_id, coalesce(p.price, 0.0::double) as last_trade_price
from t asof left join p on p.symbol_id = t.symbol_id and p.local_ts_us <= t.local_ts_us - {HOUR}""")
def asof_value_default(spark, sf_dir):
    """The last trade's price as of an hour before each quote, 0 before the first."""
    ev = events(spark, sf_dir)
    p = ev.where("is_trade = 1").select("symbol_id", F.col("local_ts_us").alias("p_ts"), F.col("event_id").alias("p_seq"), F.col("price_tick").cast("double").alias("price"))
    t = ev.where("is_trade = 0").select("event_id", "symbol_id", (F.col("local_ts_us") - HOUR).alias("at")).withColumn("seq", F.lit(MAX_SEQ))
    found = o.asof_join(t, p, ["symbol_id"], ("at", "seq"), ("p_ts", "p_seq"), ["price"])
    return found.select("event_id", F.coalesce("price", F.lit(0.0)).alias("last_trade_price"))


@query("forward_at_or_after", f"""{EV_SQL},
q as (select symbol_id, local_ts_us, arg_min((best_bid_tick + best_ask_tick) * 0.5::double, event_id) as mid from ev where is_trade = 0 group by all),
t as (select *, local_ts_us + {H6} as at from ev where is_trade = 1)
select t.event_id, q.mid as future_mid
from t asof left join q on q.symbol_id = t.symbol_id and q.local_ts_us >= t.at""")
def forward_at_or_after(spark, sf_dir):
    """The mid price six hours after each trade, or the first after that: operators 36 and 37."""
    ev = events(spark, sf_dir)
    q = quotes(spark, sf_dir).select("symbol_id", F.col("local_ts_us").alias("q_ts"), F.col("event_id").alias("q_seq"), "mid")
    t = ev.where("is_trade = 1").select("event_id", "symbol_id", (F.col("local_ts_us") + H6).alias("at")).withColumn("seq", F.lit(MAX_SEQ))
    return o.at_or_after(t, q, ["symbol_id"], ("at", "seq"), ("q_ts", "q_seq"), "mid", "future_mid").select("event_id", "future_mid")


@query("merged_tape", f"""{EV_SQL}
select symbol_id, event_id, local_ts_us, is_trade,
  row_number() over (partition by symbol_id order by local_ts_us, is_trade, event_id) - 1 as event_seq from ev""")
def merged_tape(spark, sf_dir):
    """Quotes and trades in one order, quotes first at a tie: operators 38 and 94."""
    ev = events(spark, sf_dir).select("symbol_id", "event_id", "local_ts_us", "is_trade")
    out = o.merge_streams(ev.where("is_trade = 0"), ev.where("is_trade = 1"), ["symbol_id"], "local_ts_us", "event_id")
    return out.select("symbol_id", "event_id", "local_ts_us", "is_trade", F.col("event_seq").cast("long"))


@query("merged_tape_trades_first", f"""{EV_SQL}
select symbol_id, event_id, row_number() over (partition by symbol_id order by local_ts_us, 1 - is_trade, event_id) - 1 as event_seq from ev""")
def merged_tape_trades_first(spark, sf_dir):
    ev = events(spark, sf_dir).select("symbol_id", "event_id", "local_ts_us", "is_trade")
    out = o.merge_streams(ev.where("is_trade = 0"), ev.where("is_trade = 1"), ["symbol_id"], "local_ts_us", "event_id", trades_first=True)
    return out.select("symbol_id", "event_id", F.col("event_seq").cast("long"))


@query("merge_counters", f"""{EV_SQL},
c as (select symbol_id, local_ts_us, count(*) filter (is_trade = 0) as q, count(*) filter (is_trade = 1) as t from ev group by all)
select symbol_id, sum(q)::bigint as l2_events, sum(t)::bigint as trades, sum(q + t)::bigint as emitted, (count(*) filter (q > 0 and t > 0))::bigint as tied_timestamps from c group by symbol_id""")
def merge_counters(spark, sf_dir):
    """Counters of the merge: operator 63."""
    ev = events(spark, sf_dir)
    c = ev.groupBy("symbol_id", "local_ts_us").agg(F.count_if(F.col("is_trade") == 0).alias("q"), F.count_if(F.col("is_trade") == 1).alias("t"))
    return c.groupBy("symbol_id").agg(F.sum("q").alias("l2_events"), F.sum("t").alias("trades"), F.sum(F.col("q") + F.col("t")).alias("emitted"), F.count_if((F.col("q") > 0) & (F.col("t") > 0)).alias("tied_timestamps"))


@query("order_validation", f"""{EV_SQL},
x as (select *, lag(local_ts_us) over (partition by symbol_id order by event_id) as before from ev)
select symbol_id, count(*) as n_rows, coalesce(sum(case when before >= local_ts_us then 1 else 0 end), 0)::bigint as n_violations from x group by symbol_id""")
def order_validation(spark, sf_dir):
    """Rows out of order in the order of arrival: operators 9 and 87."""
    return o.order_violations(events(spark, sf_dir), ["symbol_id"], ["local_ts_us"], True, "event_id")


@query("interval_trades_in_window", f"""{EV_SQL},
d as (select * from ev where is_trade = 0), t as (select * from ev where is_trade = 1)
select d.event_id, count(t.event_id) as n_trades, {sql6("coalesce(sum(t.amount), 0)", "volume")}
from d left join t on t.symbol_id = d.symbol_id and t.local_ts_us > d.local_ts_us + {HOUR} and t.local_ts_us <= d.local_ts_us + {H6} group by d.event_id""")
def interval_trades_in_window(spark, sf_dir):
    """Trades from one to six hours after every quote: operator 44."""
    ev = events(spark, sf_dir)
    d = ev.where("is_trade = 0").select("event_id", "symbol_id", (F.col("local_ts_us") + HOUR).alias("lo"), (F.col("local_ts_us") + H6).alias("hi"))
    t = ev.where("is_trade = 1").select("symbol_id", F.col("local_ts_us").alias("t_ts"), "amount")
    hit = o.interval_join(d, t, ["symbol_id"], "lo", "hi", "t_ts", H6).groupBy("event_id").agg(F.count("*").alias("n"), F.sum("amount").alias("v"))
    return d.select("event_id").join(hit, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n_trades"), r6(F.coalesce("v", F.lit(0.0)), "volume"))


@query("linear_targets", f"""{_DECISIONS_SQL},
y as (select event_id, 1e4 * ln(mid / (lag(mid) over (partition by symbol_id order by local_ts_us, event_id))) as r from q)
select event_id, case when abs(r) <= 2.0 then 1 else 0 end as no_move, case when abs(r) <= 2.0 then 0 when r > 0 then 1 else -1 end as direction,
  {sql6("case when abs(r) > 2.0 and r > 0 then ln(1 + r) end", "magnitude_up")}, {sql6("case when abs(r) > 2.0 and r < 0 then ln(1 - r) end", "magnitude_down")}
from y where r is not null""")
def linear_targets(spark, sf_dir):
    """Targets from one-quote returns with a deadband of 2 basis points: operator 108."""
    q = o.previous(quotes(spark, sf_dir), ["symbol_id"], "local_ts_us", ["event_id"], ["mid"]).withColumn("r", k.log_return_bps("mid", "prev_mid")).where("r is not null")
    t = k.linear_targets("r", 2.0)
    return q.select("event_id", t["no_move"].alias("no_move"), t["direction"].alias("direction"), r6(t["magnitude_up"], "magnitude_up"), r6(t["magnitude_down"], "magnitude_down"))
