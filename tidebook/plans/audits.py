"""Control features, feature rows at decisions, audits and profiles: operators 26, 27, 30, 79, 91, 95, 131, 134, 145, 147, 161 to 167."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.functions import kernels as k
from tidebook.operators import features as f
from tidebook.operators import flows, metrics, simulation, splits
from tidebook.operators import ordered as o
from tidebook.plans import flows as pf
from tidebook.plans.common import H6, H24, r6, sql6
from tidebook.plans.features import LEVELS, book_quotes
from tidebook.plans.metrics import _THIRDS, thirds
from tidebook.plans.registry import oracle_sql, query
from tidebook.sources.market import EV_SQL, events
from tidebook.sources.tables import table

BY = ["symbol_id"]

_TOUCH = f"""{EV_SQL}, q as (select *, lag(best_bid_tick) over w as pb, lag(best_ask_tick) over w as pa, lag(bid_sz) over w as pbs, lag(ask_sz) over w as paz from ev where is_trade = 0 window w as (partition by symbol_id order by local_ts_us, event_id)),
c as (select *, case when pb is null then 0 when best_bid_tick > pb then bid_sz when best_bid_tick = pb then greatest(bid_sz - pbs, 0) else 0 end as badd, case when pb is null then 0 when best_bid_tick < pb then pbs when best_bid_tick = pb then greatest(pbs - bid_sz, 0) else 0 end as brem,
  case when pb is null then 0 when best_ask_tick < pa then ask_sz when best_ask_tick = pa then greatest(ask_sz - paz, 0) else 0 end as aadd, case when pb is null then 0 when best_ask_tick > pa then paz when best_ask_tick = pa then greatest(paz - ask_sz, 0) else 0 end as arem, (best_bid_tick + best_ask_tick) * 0.5::double as mid, local_ts_us - {H6} as t0 from q)"""


@query("control_features", f"""{_TOUCH}, s as (select event_id, symbol_id, mid, t0, sum(badd) over w as ba, sum(brem) over w as br, sum(aadd) over w as aa, sum(arem) over w as ar from c window w as (partition by symbol_id order by 2 * local_ts_us range between {2 * H6} preceding and current row))
select s.event_id, {sql6("coalesce(br / nullif(ba + br, 0), 0)", "bid_depletion")}, {sql6("coalesce(aa / nullif(aa + ar, 0), 0)", "ask_replenishment")}, {sql6("case when p.mid is null then 0 else (s.mid / p.mid - 1) * 1e4 end", "mid_return_bps")}
from s asof left join c p on p.symbol_id = s.symbol_id and p.local_ts_us <= s.t0""")
def control_features(spark, sf_dir):
    """Depletion and replenishment of the touch over six hours, and the mid return since: operator 79."""
    q = events(spark, sf_dir).where("is_trade = 0").select("symbol_id", "event_id", "local_ts_us", k.mid_price("best_bid_tick", "best_ask_tick").cast("double").alias("mid"), *(F.array(F.col(c).cast("double")).alias(n) for c, n in (("best_bid_tick", "bid_px"), ("best_ask_tick", "ask_px"), ("bid_sz", "bid_sz"), ("ask_sz", "ask_sz"))))
    share = lambda w, a, b: k.safe_divide(w.total(a, H6), w.total(a, H6) + w.total(b, H6))
    got = o.range_features(f.book_changes(q), BY, "local_ts_us", 2 * F.col("local_ts_us"), H6, lambda w: {"bid_depletion": share(w, "bid_rem", "bid_add"), "ask_replenishment": share(w, "ask_add", "ask_rem")})
    facts = q.select("symbol_id", F.col("local_ts_us").alias("p_ts"), F.col("event_id").alias("p_seq"), F.col("mid").alias("past_mid"))
    got = o.asof_join(got.withColumn("t0", F.col("local_ts_us") - H6).withColumn("t0_seq", F.lit(2**62)), facts, BY, ("t0", "t0_seq"), ("p_ts", "p_seq"), ["past_mid"])
    back = F.when(F.col("past_mid").isNull(), F.lit(0.0)).otherwise(k.bps_change("mid", "past_mid"))
    return got.select("event_id", r6("bid_depletion", "bid_depletion"), r6("ask_replenishment", "ask_replenishment"), r6(back, "mid_return_bps"))


_VPIN = oracle_sql()["vpin"]


@query("adverse_feature_rows", f"""with v as ({_VPIN}), d as (select event_id, cast(user_id % 4 as bigint) as symbol_id, epoch_us(ts) as local_ts_us from events where event_type in ('click', 'view')),
u as (select symbol_id, closed_at, arg_max(vpin, bucket) as vpin, max(bucket) as bucket from v group by all)
select d.event_id, {sql6("coalesce(u.vpin, 0)", "vpin", 10)}, coalesce(u.bucket + 1, 0) as n_buckets from d asof left join u on u.symbol_id = d.symbol_id and u.closed_at <= d.local_ts_us""")
def adverse_feature_rows(spark, sf_dir):
    """Flow toxicity as it stands at each quote: operator 131."""
    b = flows.vpin(flows.volume_buckets(pf.cents(events(spark, sf_dir)), BY, "local_ts_us", ["event_id"], "qty", "side_code", pf.BUCKET), BY, pf.BUCKET, 20, 5)
    d = events(spark, sf_dir).where("is_trade = 0").select("event_id", "symbol_id", "local_ts_us").withColumn("seq", F.lit(2**62))
    got = o.asof_join(d, b.select("symbol_id", "closed_at", "bucket", "vpin"), BY, ("local_ts_us", "seq"), ("closed_at", "bucket"), ["vpin", "bucket"])
    return got.select("event_id", r6(F.coalesce("vpin", F.lit(0.0)), "vpin", 10), F.coalesce(F.col("bucket") + 1, F.lit(0)).alias("n_buckets"))


@query("split_role_masks", f"{_THIRDS} select event_id, role, role = 'train' as in_train, event_type = 'purchase' and side_code > 0 as scope_up, side_code <> 0 as scope_move from z")
def split_role_masks(spark, sf_dir):
    """Roles of rows, and masks of what each head learns from: operators 26 and 27."""
    ev = thirds(events(spark, sf_dir))
    return ev.select("event_id", "role", (F.col("role") == "train").alias("in_train"), ((F.col("event_type") == "purchase") & (F.col("side_code") > 0)).alias("scope_up"), (F.col("side_code") != 0).alias("scope_move"))


@query("feature_registry", "select * from (values " + ", ".join(f"('{n}', {i}::int, {len(f.windows_of(n))}::int, {max(f.windows_of(n), default=0)}::bigint)" for i, n in enumerate(f.FEATURES)) + ") t(feature, position, n_windows, longest_window_us)")
def feature_registry(spark, sf_dir):
    """The features in order, with the windows that their names speak of: operators 30, 31 and 119."""
    names = spark.range(1).select(F.posexplode(F.array(*map(F.lit, f.FEATURES))).alias("position", "feature"))
    us = F.transform(F.regexp_extract_all("feature", F.lit(r"_(\d+)us(?:_|$)"), F.lit(1)), lambda x: x.cast("bigint"))
    return names.select("feature", "position", F.size(us).alias("n_windows"), F.coalesce(F.array_max(us), F.lit(0).cast("bigint")).alias("longest_window_us"))


@query("first_rows_in_order", f"{EV_SQL} select event_id, local_ts_us from ev where is_trade = 1 order by local_ts_us, event_id limit 100")
def first_rows_in_order(spark, sf_dir):
    """A cap on rows, in order: operator 91."""
    return events(spark, sf_dir).where("is_trade = 1").select("event_id", "local_ts_us").orderBy("local_ts_us", "event_id").limit(100)


@query("schema_check", "select 1 as n_missing, 4 as n_extra")
def schema_check(spark, sf_dir):
    """Columns that lack, and that are too many: operator 95."""
    missing, extra = splits.schema_difference(table(spark, sf_dir, "events"), ["event_id", "ts", "nothing"])
    return spark.range(1).select(F.lit(len(missing)).alias("n_missing"), F.lit(len(extra)).alias("n_extra"))


@query("horizon_alignment", f"""with l as ({oracle_sql()["label_forward_returns"]}), s as (select l.*, ((event_id * 7) % 21 - 10) / 10.0::double as signal from l)
select count(*) as n, {sql6("corr(signal, ret_6h_bps)", "pearson")}, {sql6("avg((sign(signal) = sign(ret_6h_bps))::int)", "sign_accuracy")} from s where ret_6h_bps is not null and signal <> 0""")
def horizon_alignment(spark, sf_dir):
    """How a signal and what followed agree: operator 147."""
    from tidebook.plans.labels import label_forward_returns

    s = label_forward_returns(spark, sf_dir).withColumn("signal", ((F.col("event_id") * 7) % 21 - 10) / 10.0).where("ret_6h_bps is not null and signal <> 0")
    return s.agg(F.count("*").alias("n"), r6(F.corr("signal", "ret_6h_bps"), "pearson"), r6(F.avg((F.signum("signal") == F.signum("ret_6h_bps")).cast("int")), "sign_accuracy"))


_LAB = f"{_THIRDS}, c as (select *, (event_type = 'purchase')::int as y, case when event_id % 7 = 0 then null else ((event_id * 11) % 17)::double end as cand from z)"


@query("feature_lab", f"""{_LAB} select role, count(*) as n_rows, count(cand) as n_joined, {sql6("count(cand)::double / count(*)", "coverage")}, {sql6("stddev_samp(cand)", "std")}, {sql6("corr(cand, y)", "target_corr")}, {sql6("corr(cand, bid_sz)", "redundancy")} from c group by role""")
def feature_lab(spark, sf_dir):
    """Coverage, spread, association and redundancy of a candidate in each split: operators 160 and 161."""
    e = F.col("event_id")
    c = thirds(events(spark, sf_dir)).withColumn("y", (F.col("event_type") == "purchase").cast("int")).withColumn("cand", F.when(e % 7 != 0, ((e * 11) % 17).cast("double")))
    both = F.when(F.col("cand").isNotNull(), F.col("y").cast("double")), F.when(F.col("cand").isNotNull(), F.col("bid_sz"))
    return c.groupBy("role").agg(F.count("*").alias("n_rows"), F.count("cand").alias("n_joined"), r6(F.count("cand") / F.count("*"), "coverage"), r6(F.stddev_samp("cand"), "std"), r6(F.corr("cand", both[0]), "target_corr"), r6(F.corr("cand", both[1]), "redundancy"))


@query("preprocess_audit", f"""{_THIRDS}, t as (select avg(amount) as m, stddev_samp(amount) as s from z where role = 'train'), y as (select role, (amount - m) / s as v from z, t where amount is not null)
select role, count(*) as n, {sql6("avg(v)", "mean_z")}, {sql6("avg((abs(v) > 1.5)::int)", "clip_rate")}, {sql6("avg((abs(v) > 1.35)::int)", "near_clip_rate")}, {sql6("max(abs(v))", "most_z")} from y group by role""")
def preprocess_audit(spark, sf_dir):
    """How often z-scores are clipped, or nearly, in each split: operators 163 and 164."""
    ev = thirds(events(spark, sf_dir))
    fit = ev.where("role = 'train'").agg(F.avg("amount").alias("m"), F.stddev_samp("amount").alias("s"))
    y = ev.where("amount is not null").crossJoin(F.broadcast(fit)).withColumn("v", (F.col("amount") - F.col("m")) / F.col("s"))
    rate = lambda b: F.avg((F.abs("v") > b).cast("int"))
    return y.groupBy("role").agg(F.count("*").alias("n"), r6(F.avg("v"), "mean_z"), r6(rate(1.5), "clip_rate"), r6(rate(1.35), "near_clip_rate"), r6(F.max(F.abs("v")), "most_z"))


_FIELDS = {"spread": "best_ask_tick - best_bid_tick", "imbalance": "(bid_sz - ask_sz) / (bid_sz + ask_sz)", "depth": "bid_sz + ask_sz"}


@query("observation_profile", f"{EV_SQL} " + " union all ".join(f"select '{n}' as field, count(*) as n, {sql6(f'avg({x})', 'mean')}, {sql6(f'stddev_pop({x})', 'std')}, {sql6(f'min({x})', 'least')}, {sql6(f'quantile_cont({x}, 0.5)', 'median')}, {sql6(f'max({x})', 'most')} from ev where is_trade = 0" for n, x in _FIELDS.items()))
def observation_profile(spark, sf_dir):
    """Fields of an observation, one row each: operators 145, 166 and 167."""
    q = events(spark, sf_dir).where("is_trade = 0")
    long = q.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.expr(x).cast("double").alias("v")) for n, x in _FIELDS.items()))).alias("x")).select("x.*")
    got = long.groupBy("field").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("least"), F.percentile("v", 0.5).alias("median"), F.max("v").alias("most"))
    return got.select("field", "n", *(r6(c, c) for c in ("mean", "std", "least", "median", "most")))


@query("simulated_balanced")
def simulated_balanced(spark, sf_dir):
    """The simulator with a queue that also wears down as levels shrink, net of prints: operators 134 and 138."""
    return simulation.simulate(events(spark, sf_dir), BY, model=simulation.QueueModel(1.0, 0.5, True, 0.0), delay_us=H6 // 6)


@query("book_depth_profile", f"""{EV_SQL}, lv as (select event_id, unnest(list_transform(range({LEVELS}), lambda i: (1 + (event_id * (i + 3)) % 9)::double)) as sz, unnest(range({LEVELS})) as level from ev where is_trade = 0)
select level::int as level, count(*) as n, {sql6("avg(sz)", "mean_size")} from lv group by level""")
def book_depth_profile(spark, sf_dir):
    """Mean size by level."""
    got = book_quotes(spark, sf_dir).select(F.posexplode("bid_sz").alias("level", "sz")).groupBy("level").agg(F.count("*").alias("n"), F.avg("sz").alias("m"))
    return got.select("level", "n", r6("m", "mean_size"))


@query("reward_discounted", f"{EV_SQL} select symbol_id, {sql6(f'sum((event_id % 5) * pow(0.9, (local_ts_us - (select min(local_ts_us) from ev)) / {H24}.0))', 'total')} from ev group by symbol_id")
def reward_discounted(spark, sf_dir):
    """Rewards discounted by the time since the tape's start: operators 84 and 146."""
    ev = events(spark, sf_dir)
    start = ev.agg(F.min("local_ts_us").alias("t0"))
    d = simulation.discounts(F.col("local_ts_us") - F.col("t0"), 0.9, H24)
    return ev.crossJoin(F.broadcast(start)).groupBy("symbol_id").agg(r6(F.sum((F.col("event_id") % 5) * d), "total"))


@query("moments_merge", f"{EV_SQL} select count(amount) as n, {sql6('avg(amount)', 'mean')}, {sql6('var_samp(amount)', 'variance')}, {sql6('min(amount)', 'least')}, {sql6('max(amount)', 'most')} from ev")
def moments_merge(spark, sf_dir):
    """Moments of all rows, merged from partial ones: operator 46."""
    got = metrics.moments(events(spark, sf_dir), [], "amount")
    return got.select("n", *(r6(c, c) for c in ("mean", "variance", "least", "most")))
