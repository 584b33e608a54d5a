"""Simulation, learning data and linear heads: operators 84, 85, 113, 138 to 148, 155 to 157."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.functions import kernels as k
from tidebook.operators import execution as x
from tidebook.operators import linear, simulation
from tidebook.plans.common import H6, H24, HOUR, r6, sql6
from tidebook.plans.metrics import thirds
from tidebook.plans.registry import query
from tidebook.sources.market import EV_SQL, events

BY = ["symbol_id"]


@query("simulated_journal")
def simulated_journal(spark, sf_dir):
    """A fixed policy at the touch with delays: operators 138 to 143, 151 and 152."""
    return simulation.simulate(events(spark, sf_dir), BY, delay_us=HOUR, cancel_us=HOUR // 2)


@query("simulated_fills")
def simulated_fills(spark, sf_dir):
    """Fills, bought and sold quantity and the last position by symbol."""
    j = simulated_journal(spark, sf_dir).where("what = 'fill'")
    return j.groupBy("symbol_id").agg(F.count("*").alias("n_fills"), r6(F.sum(F.when(F.col("side_code") > 0, F.col("qty"))), "bought"), r6(F.sum(F.when(F.col("side_code") < 0, F.col("qty"))), "sold"))


_STEPS = f"""{EV_SQL}, s as (select symbol_id * 1000 + local_ts_us // {H24} as episode, event_id as step, ((event_id * 37) % 11 - 5) / 5.0::double as reward, ((event_id * 13) % 7) / 7.0::double as value, event_id % 50 = 0 as done, 0.9::double as discount from ev),
n as (select *, coalesce(lead(value) over (partition by episode order by step), 0) as next_value, row_number() over (partition by episode order by step desc) as back from s)"""


def _steps(spark, sf_dir):
    from pyspark.sql import Window

    e = F.col("event_id")
    s = events(spark, sf_dir).select((F.col("symbol_id") * 1000 + F.floor(F.col("local_ts_us") / H24)).alias("episode"), e.alias("step"), (((e * 37) % 11 - 5) / 5.0).alias("reward"), (((e * 13) % 7) / 7.0).alias("value"), (e % 50 == 0).alias("done"), F.lit(0.9).alias("discount"))
    return s.withColumn("next_value", F.coalesce(F.lead("value").over(Window.partitionBy("episode").orderBy("step")), F.lit(0.0)))


@query("advantages", f"""with recursive {_STEPS.removeprefix("with ")},
r(episode, back, step, value, adv) as (
  select episode, back, step, value, reward + case when done then 0 else discount * next_value end - value from n where back = 1
  union all select n.episode, n.back, n.step, n.value, n.reward + case when n.done then 0 else n.discount * n.next_value end - n.value + case when n.done then 0 else n.discount * 0.95 * r.adv end from r join n on n.episode = r.episode and n.back = r.back + 1)
select episode, step, {sql6("adv", "advantage")}, {sql6("adv + value", "return")} from r""")
def advantages(spark, sf_dir):
    """Operator 84."""
    got = simulation.advantages(_steps(spark, sf_dir), ["episode"], "step", 0.95)
    return got.select("episode", "step", r6("advantage", "advantage"), r6("return", "return"))


@query("normalised_rewards", f"{_STEPS} select step, {sql6('(reward - avg(reward) over ()) / stddev_pop(reward) over ()', 'z')} from s")
def normalised_rewards(spark, sf_dir):
    """Operator 85."""
    return simulation.normalised(_steps(spark, sf_dir), "reward", "z").select("step", r6("z", "z"))


@query("time_discounts", f"{EV_SQL} select event_id, {sql6(f'pow(0.99, (event_id % 100) * {HOUR}.0 / {H24})', 'discount')} from ev")
def time_discounts(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", r6(simulation.discounts((F.col("event_id") % 100) * HOUR, 0.99, H24), "discount"))


@query("raw_actions", f"""{EV_SQL}, a as (select event_id, ((event_id % 17) - 8) / 2.0::double as raw, best_bid_tick - 4 as lo, best_bid_tick as hi from ev where is_trade = 0), s as (select *, 1 / (1 + exp(-raw)) as sh from a)
select event_id, (lo + least(floor(sh * 5), 4))::bigint as tick, {sql6("floor(1 / (1 + exp(-(raw + ln(0.25::double / 0.75)))) / 0.05 + 1e-9) * 0.05", "qty")} from s""")
def raw_actions(spark, sf_dir):
    """Raw actions to ticks and sizes: operator 113."""
    raw = ((F.col("event_id") % 17) - 8) / 2.0
    q = events(spark, sf_dir).where("is_trade = 0")
    return q.select("event_id", x.raw_to_tick(raw, F.col("best_bid_tick") - 4, F.col("best_bid_tick")).cast("long").alias("tick"), r6(x.raw_to_qty(raw, 0.25, 1.0, 0.05), "qty"))


@query("path_rewards", f"""{EV_SQL}, q as (select symbol_id, event_id, local_ts_us, (best_bid_tick + best_ask_tick) * 0.5::double as equity from ev where is_trade = 0), u as (select symbol_id, local_ts_us, arg_min(equity, event_id) as equity from q group by all),
a as (select *, local_ts_us + {H6} as t1, local_ts_us + {H24} as t2 from q)
select a.event_id, {sql6("x.equity - a.equity", "reward_6h")}, {sql6("y.equity - a.equity", "reward_24h")}
from a asof left join u x on x.symbol_id = a.symbol_id and x.local_ts_us >= a.t1 asof left join u y on y.symbol_id = a.symbol_id and y.local_ts_us >= a.t2""")
def path_rewards(spark, sf_dir):
    """Changes of equity to later rows from every quote: operators 37, 146 and 147."""
    q = events(spark, sf_dir).where("is_trade = 0").select("symbol_id", "event_id", "local_ts_us", k.mid_price("best_bid_tick", "best_ask_tick").cast("double").alias("equity"))
    got = simulation.path_rewards(q, q, BY, {"6h": H6, "24h": H24})
    return got.select("event_id", r6("reward_6h", "reward_6h"), r6("reward_24h", "reward_24h"))


@query("linear_head")
def linear_head(spark, sf_dir):
    """A logistic head, standardised and trained on the train third alone, that scores all rows: operators 116 and 154 to 156."""
    ev = thirds(events(spark, sf_dir)).withColumn("y", (F.col("event_type") == "purchase").cast("int"))
    xs = ["bid_sz", "ask_sz", "best_bid_tick"]
    train = ev.where("role = 'train'")
    zs = linear.standardised(xs, *linear.standardiser(train, xs))
    w, b = linear.train_head(train, zs, "y", "event_id", "logistic")
    return ev.select("event_id", "role", "y", r6(k.sigmoid(linear.linear_score(w, b, zs)), "p"))


@query("linear_evaluation")
def linear_evaluation(spark, sf_dir):
    """Rows, positives, loss, accuracy and mean score of the head in each split, and whether it beats the base rate: operator 157."""
    return linear.evaluated(linear_head(spark, sf_dir), "role", "y", "p")
