"""Aggregations, ranks, audits and splits: operators 46 to 68, 81 to 96, 154 to 174."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.functions import kernels as k
from tidebook.operators import metrics as m
from tidebook.operators import ordered as o
from tidebook.plans.common import HOUR, r6, sql6
from tidebook.plans.registry import query
from tidebook.sources.market import EV_SQL, events
from tidebook.sources.tables import table

_Y = f"""{EV_SQL}, s as (select event_id, symbol_id, local_ts_us, event_type, side_code, amount, (event_type = 'purchase')::int as y, amount / 1000.0::double as p from ev where amount is not null)"""


def scored(spark, sf_dir):
    return events(spark, sf_dir).where("amount is not null").withColumn("y", (F.col("event_type") == "purchase").cast("int")).withColumn("p", F.col("amount") / 1000.0)


def _all(df, *exact):
    return df.select(*(F.col(c) if c in exact or t in ("string", "boolean") or t == "bigint" or t == "int" else r6(c, c) for c, t in df.dtypes))


@query("moments_by_symbol", f"{_Y} select symbol_id, count(amount) as n, {sql6('avg(amount)', 'mean')}, {sql6('var_samp(amount)', 'variance')}, {sql6('min(amount)', 'least')}, {sql6('max(amount)', 'most')} from s group by symbol_id")
def moments_by_symbol(spark, sf_dir):
    """Operator 46."""
    return _all(m.moments(scored(spark, sf_dir), ["symbol_id"], "amount"))


@query("running_mean_std", f"""{_Y}, t as (select symbol_id, count(p) as n, avg(p) as m, var_pop(p) as v from s group by symbol_id)
select symbol_id, {sql6("n + 1e-4", "count")}, {sql6("m * n / (n + 1e-4)", "mean")}, {sql6("(1e-4 + v * n + m * m * 1e-4 * n / (n + 1e-4)) / (n + 1e-4)", "variance")} from t""")
def running_mean_std(spark, sf_dir):
    """Operator 47."""
    return _all(m.running_mean_std(scored(spark, sf_dir), ["symbol_id"], "p"))


_XS = ["l_quantity", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_XS) for b in _XS[i:]]


@query("correlation_matrix", " union all ".join(f"select '{a}' as a, '{b}' as b, {sql6('max(1)' if a == b else f'corr({a}, {b})', 'corr')} from lineitem" for a, b in _PAIRS))
def correlation_matrix(spark, sf_dir):
    """Operators 48 and 90."""
    return _all(m.correlations(table(spark, sf_dir, "lineitem"), _XS))


@query("gram_matrix", " union all ".join(f"select {i}::int as i, {j}::int as j, {sql6(f'sum({v})', 'value')} from lineitem" for i, j, v in [(0, 0, "1"), (0, 1, "l_quantity"), (0, 2, "l_tax"), (1, 1, "l_quantity * l_quantity"), (1, 2, "l_quantity * l_tax"), (2, 2, "l_tax * l_tax"), (0, -1, "l_discount"), (1, -1, "l_quantity * l_discount"), (2, -1, "l_tax * l_discount")]))
def gram_matrix(spark, sf_dir):
    """Sums for normal equations: operators 49 and 158."""
    return _all(m.gram(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], "l_discount"))


@query("ridge_fit_score", f"select {sql6('regr_intercept(l_extendedprice, l_quantity)', 'intercept')}, {sql6('regr_slope(l_extendedprice, l_quantity)', 'slope')} from lineitem")
def ridge_fit_score(spark, sf_dir):
    """With no penalty, ridge is least squares: operators 158 and 159."""
    fit = m.ridge(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", l2=0.0)
    slope = fit["weights"][0] / fit["std"][0]
    return spark.range(1).select(r6(F.lit(fit["intercept"] - slope * fit["mean"][0]), "intercept"), r6(F.lit(slope), "slope"))


@query("quantiles", f"{_Y} select symbol_id, {', '.join(sql6(f'quantile_cont(amount, {q})', f'p{int(q * 100):02d}') for q in (0.01, 0.05, 0.5, 0.95, 0.99))} from s group by symbol_id")
def quantiles(spark, sf_dir):
    """Exact quantiles with linear interpolation: operator 50."""
    got = scored(spark, sf_dir).groupBy("symbol_id").agg(F.percentile("amount", [0.01, 0.05, 0.5, 0.95, 0.99]).alias("q"))
    return got.select("symbol_id", *(r6(F.col("q")[i], n) for i, n in enumerate(("p01", "p05", "p50", "p95", "p99"))))


@query("bounded_quantiles")
def bounded_quantiles(spark, sf_dir):
    """Quantiles from a sketch of bounded size, in place of a bounded sample: operator 51."""
    return scored(spark, sf_dir).groupBy("symbol_id").agg(F.percentile_approx("amount", [0.1, 0.5, 0.9], 1000).alias("q"))


@query("auc_histogram", f"""{_Y}, r as (select min(amount) as lo, max(amount) as hi from s), b as (select least(floor((amount - lo) / (hi - lo) * 64), 63)::int as bin, y from s, r),
g as (select bin, sum(y) as pos, sum(1 - y) as neg from b group by bin), a as (select pos, neg, pos * (coalesce(sum(neg) over (order by bin rows between unbounded preceding and 1 preceding), 0) + 0.5 * neg) as area from g)
select {sql6("sum(area) / (sum(pos) * sum(neg))", "auc")} from a""")
def auc_histogram(spark, sf_dir):
    """Operator 52."""
    return _all(m.histogram_auc(scored(spark, sf_dir), [], "y", "amount", 64))


@query("auc_exact", f"""{_Y}, r as (select y, rank() over (order by amount) + (count(*) over (partition by amount) - 1) / 2.0 as rk from s)
select {sql6("(sum(rk) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::double * sum(1 - y))", "auc")} from r""")
def auc_exact(spark, sf_dir):
    """Operators 53 and 81."""
    return _all(m.exact_auc(scored(spark, sf_dir), "y", "amount"))


@query("spearman", f"""with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as a, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as b from lineitem)
select {sql6("corr(a, b)", "spearman")} from r""")
def spearman(spark, sf_dir):
    """Operator 54."""
    return _all(m.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"))


@query("grouped_outcomes", f"""{_Y} select coalesce(event_type, 'all') as event_type, coalesce(side_code, -9)::int as side, grouping(event_type)::int as g_type, count(*) as n, {sql6("avg(amount)", "mean")}
from s group by grouping sets ((), (event_type), (side_code), (event_type, side_code))""")
def grouped_outcomes(spark, sf_dir):
    """All rows, and each group by one and by both keys: operator 55."""
    s = scored(spark, sf_dir)
    got = s.groupingSets([[], [s.event_type], [s.side_code], [s.event_type, s.side_code]], s.event_type, s.side_code).agg(F.grouping("event_type").cast("int").alias("g_type"), F.count("*").alias("n"), F.avg("amount").alias("mean"))
    return got.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("side_code", F.lit(-9)).alias("side"), "g_type", "n", r6("mean", "mean"))


@query("family_summary", f"select l_returnflag as split, l_linestatus as family, count(*) as n, {sql6('avg(l_quantity)', 'mean')}, {sql6('quantile_cont(l_extendedprice, 0.5)', 'median')} from lineitem group by all")
def family_summary(spark, sf_dir):
    """Operator 56."""
    got = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("split"), F.col("l_linestatus").alias("family"))
    return _all(got.agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"), F.percentile("l_extendedprice", 0.5).alias("median")))


_P = """, c as (select y, least(greatest(p, 0), 1) as p from s)"""


@query("calibration", f"""{_Y}{_P}, b as (select least(floor(p * 10), 9)::int as bin, count(*) as n, avg(p) as mp, avg(y::double) as r from c group by 1)
select i::int as bin, coalesce(n, 0) as n, {sql6("mp", "mean_p")}, {sql6("r", "positive_rate")} from range(10) t(i) left join b on b.bin = i""")
def calibration(spark, sf_dir):
    """Operator 57."""
    return _all(m.calibration(scored(spark, sf_dir).withColumn("p", k.clip("p", 0, 1)), "y", "p", 10))


@query("classification", f"""{_Y}{_P}, q as (select y, p, least(greatest(p, 1e-12), 1 - 1e-12) as q, (p >= 0.1)::int as h from c),
n as (select count(*) filter (y = 1 and h = 1) as tp, count(*) filter (y = 0 and h = 1) as fp, count(*) filter (y = 0 and h = 0) as tn, count(*) filter (y = 1 and h = 0) as fn,
  avg((y = h)::int) as acc, avg(case when y = 1 then -ln(q) else -ln(1 - q) end) as ll, avg((p - y) * (p - y)) as br from q)
select tp, fp, tn, fn, {sql6("acc", "accuracy")}, {sql6("(tp::double / nullif(tp + fn, 0) + tn::double / nullif(tn + fp, 0)) / 2", "balanced_accuracy")}, {sql6("ll", "log_loss")}, {sql6("br", "brier")} from n""")
def classification(spark, sf_dir):
    """Operator 58."""
    return _all(m.classification(scored(spark, sf_dir).withColumn("p", k.clip("p", 0, 1)), "y", "p", 0.1))


@query("regression_metrics", f"""with e as (select l_quantity as y, l_extendedprice / 1000 as p from lineitem)
select count(*) as n, {sql6("avg(abs(p - y))", "mae")}, {sql6("sqrt(avg((p - y) * (p - y)))", "rmse")}, {sql6("avg(p - y)", "bias")}, {sql6("corr(p, y)", "pearson")}, {sql6("avg(y)", "mean_true")}, {sql6("avg(p)", "mean_pred")} from e""")
def regression_metrics(spark, sf_dir):
    """Operator 59."""
    return _all(m.regression(table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_extendedprice") / 1000), "l_quantity", "p"))


@query("interval_stats", f"""{EV_SQL}, x as (select symbol_id, local_ts_us - lag(local_ts_us) over (partition by symbol_id order by local_ts_us, event_id) as gap from ev)
select symbol_id, count(gap) as n, {sql6("avg(gap) / 1e6", "mean_s")}, {sql6("stddev_pop(gap) / 1e6", "std_s")}, min(gap) as least, max(gap) as most from x where gap is not null group by symbol_id""")
def interval_stats(spark, sf_dir):
    """Time since the event before, the first left out: operator 61."""
    x = o.previous(events(spark, sf_dir), ["symbol_id"], "local_ts_us", ["event_id"], ["local_ts_us"]).where("prev_local_ts_us is not null").withColumn("gap", F.col("local_ts_us") - F.col("prev_local_ts_us"))
    got = x.groupBy("symbol_id").agg(F.count("gap").alias("n"), (F.avg("gap") / 1e6).alias("mean_s"), (F.stddev_pop("gap") / 1e6).alias("std_s"), F.min("gap").alias("least"), F.max("gap").alias("most"))
    return _all(got)


@query("tape_summary", f"""{EV_SQL} select symbol_id, count(*) as n_events, count(*) filter (is_trade = 1) as n_trades, min(local_ts_us) as first_ts, max(local_ts_us) as last_ts, arg_min(event_id, local_ts_us) as first_event, arg_max(event_id, local_ts_us) as last_event from ev group by symbol_id""")
def tape_summary(spark, sf_dir):
    """First and last keys and counts: operator 66."""
    return events(spark, sf_dir).groupBy("symbol_id").agg(F.count("*").alias("n_events"), F.count_if(F.col("is_trade") == 1).alias("n_trades"), F.min("local_ts_us").alias("first_ts"), F.max("local_ts_us").alias("last_ts"), F.min_by("event_id", "local_ts_us").alias("first_event"), F.max_by("event_id", "local_ts_us").alias("last_event"))


@query("fill_turnover", f"{EV_SQL} select symbol_id, side_code, count(*) as n, {sql6('sum(price_tick * 0.1 * amount)', 'notional')} from ev where is_trade = 1 and side_code <> 0 group by symbol_id, side_code")
def fill_turnover(spark, sf_dir):
    """Operator 67."""
    return _all(events(spark, sf_dir).where("is_trade = 1 and side_code <> 0").groupBy("symbol_id", "side_code").agg(F.count("*").alias("n"), F.sum(F.col("price_tick") * 0.1 * F.col("amount")).alias("notional")))


@query("reason_counts", f"{EV_SQL} select event_type, count(*) as n from ev group by event_type")
def reason_counts(spark, sf_dir):
    """Operator 68."""
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))


@query("masked_summary", f"""{EV_SQL} select symbol_id, count(*) as n_rows, count(case when side_code <> 0 then amount end) as n_valid, {sql6("avg(case when side_code <> 0 then amount end)", "mean_valid")}, {sql6("count(case when side_code <> 0 then amount end)::double / count(*)", "valid_share")} from ev group by symbol_id""")
def masked_summary(spark, sf_dir):
    """Means of labels where they are valid: operators 64 and 65."""
    v = F.when(F.col("side_code") != 0, F.col("amount"))
    return _all(events(spark, sf_dir).groupBy("symbol_id").agg(F.count("*").alias("n_rows"), F.count(v).alias("n_valid"), F.avg(v).alias("mean_valid"), (F.count(v) / F.count("*")).alias("valid_share")))


@query("rank_records", """with x as (select l_returnflag as head, l_shipdate::date as d, sum(l_quantity) as v from lineitem group by all)
select head, d::varchar as d, row_number() over (partition by head order by v desc, d) as importance_rank from x""")
def rank_records(spark, sf_dir):
    """Ranks by value, ties by key: operator 82."""
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("head"), F.col("l_shipdate").cast("date").alias("d")).agg(F.sum("l_quantity").alias("v"))
    return x.select("head", F.col("d").cast("string").alias("d"), F.row_number().over(Window.partitionBy("head").orderBy(F.desc("v"), "d")).cast("long").alias("importance_rank"))


@query("top_k_abs", f"""{EV_SQL}, x as (select event_type, symbol_id, sum(amount * side_code) as w from ev group by all)
select event_type, symbol_id, {sql6("w", "w")} from (select *, row_number() over (order by abs(w) desc, event_type, symbol_id) as r from x) t where r <= 5""")
def top_k_abs(spark, sf_dir):
    """The largest coefficients by size: operators 89 and 93."""
    x = events(spark, sf_dir).groupBy("event_type", "symbol_id").agg(F.sum(F.col("amount") * F.col("side_code")).alias("w"))
    return _all(x.orderBy(F.abs("w").desc(), "event_type", "symbol_id").limit(5))


@query("tail_buckets", f"""{_Y}, q as (select quantile_cont(amount, 0.1) as b10, quantile_cont(amount, 0.9) as t10, quantile_cont(amount, 0.2) as b20, quantile_cont(amount, 0.8) as t20 from s),
u as (select s.y, unnest(list_filter([case when amount <= b10 then 'bottom_10' end, case when amount >= t10 then 'top_10' end, case when amount <= b20 then 'bottom_20' end, case when amount >= t20 then 'top_20' end], lambda x: x is not null)) as bucket from s, q)
select bucket, count(*) as n, {sql6("avg(y)", "fill_rate")}, {sql6("avg(y) / (select avg(y) from s)", "lift")} from u group by bucket""")
def tail_buckets(spark, sf_dir):
    """Rates and lift in the tails of a signal: operators 92 and 165."""
    s = scored(spark, sf_dir)
    rate = s.agg(F.avg("y").alias("all_rate"))
    got = m.tails(s, "amount", [10, 20]).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("y").alias("fill_rate"))
    return _all(got.crossJoin(F.broadcast(rate)).select("bucket", "n", "fill_rate", (F.col("fill_rate") / F.col("all_rate")).alias("lift")))


@query("strided_sample", """with x as (select *, row_number() over (order by event_id) - 1 as i, count(*) over () as n from events) select event_id from x where i % greatest(1, (n + 99) // 100) = 0""")
def strided_sample(spark, sf_dir):
    """Every k-th row in order, a hundred at most: operator 86."""
    return m.strided(table(spark, sf_dir, "events").select("event_id"), ["event_id"], 100)


_THIRDS = f"""{EV_SQL}, b as (select min(local_ts_us) as lo, max(local_ts_us) as hi from ev), z as (select ev.*, case when local_ts_us < lo + (hi - lo) // 3 then 'train' when local_ts_us < lo + 2 * ((hi - lo) // 3) then 'val' else 'test' end as role, lo, hi from ev, b)"""


def thirds(ev):
    span = ev.agg(F.min("local_ts_us").alias("lo"), F.max("local_ts_us").alias("hi"))
    third = F.floor((F.col("hi") - F.col("lo")) / 3).cast("long")
    role = F.when(F.col("local_ts_us") < F.col("lo") + third, "train").when(F.col("local_ts_us") < F.col("lo") + 2 * third, "val").otherwise("test")
    return ev.crossJoin(F.broadcast(span)).withColumn("role", role).withColumn("third", third)


@query("split_plan", f"""{_THIRDS}, w as (select *, (hi - lo) // 3 as third, case role when 'train' then lo when 'val' then lo + (hi - lo) // 3 else lo + 2 * ((hi - lo) // 3) end as w0, case role when 'train' then lo + (hi - lo) // 3 when 'val' then lo + 2 * ((hi - lo) // 3) else hi + 1 end as w1 from z)
select role, symbol_id, count(*) as n, min(local_ts_us) as first_ts, max(local_ts_us) as last_ts from w where local_ts_us >= w0 + {2 * HOUR} and local_ts_us < w1 - {2 * HOUR} group by role, symbol_id""")
def split_plan(spark, sf_dir):
    """Windows in time, each cut by purge and embargo of an hour at both ends: operators 168, 169, 25 and 45."""
    from tidebook.operators.splits import purged

    ev = thirds(events(spark, sf_dir))
    start = F.when(F.col("role") == "train", F.col("lo")).when(F.col("role") == "val", F.col("lo") + F.col("third")).otherwise(F.col("lo") + 2 * F.col("third"))
    end = F.when(F.col("role") == "train", F.col("lo") + F.col("third")).when(F.col("role") == "val", F.col("lo") + 2 * F.col("third")).otherwise(F.col("hi") + 1)
    return ev.where(purged("local_ts_us", start, end, HOUR, HOUR)).groupBy("role", "symbol_id").agg(F.count("*").alias("n"), F.min("local_ts_us").alias("first_ts"), F.max("local_ts_us").alias("last_ts"))


@query("feature_drift", " union all ".join(f"""({_THIRDS}, t as (select avg({x}) as m, stddev_samp({x}) as s from z where role = 'train'), u as (select avg({x}) as m, stddev_samp({x}) as s from z where role = 'test')
select '{x}' as feature, {sql6("(u.m - t.m) / t.s", "mean_shift")}, {sql6("u.s / t.s", "std_ratio")}, abs((u.m - t.m) / t.s) >= 1 or u.s / t.s <= 0.5 or u.s / t.s >= 2 as drifted from t, u)""" for x in ("amount", "bid_sz", "local_ts_us")))
def feature_drift(spark, sf_dir):
    """Operators 162 and 163."""
    ev = thirds(events(spark, sf_dir))
    return _all(m.drift(ev.where("role = 'train'"), ev.where("role = 'test'"), ["amount", "bid_sz", "local_ts_us"]))


@query("standardise_train_only", f"""{_THIRDS}, t as (select avg(amount) as m, greatest(stddev_samp(amount), 1e-12) as s from z where role = 'train')
select event_id, role, {sql6("least(greatest((amount - m) / s, -8), 8)", "z")} from z, t where amount is not null""")
def standardise_train_only(spark, sf_dir):
    """Z-scores by the train split's moments, clipped: operators 116 and 154."""
    ev = thirds(events(spark, sf_dir))
    fit = ev.where("role = 'train'").agg(F.avg("amount").alias("m"), F.greatest(F.stddev_samp("amount"), F.lit(1e-12)).alias("s"))
    return ev.where("amount is not null").crossJoin(F.broadcast(fit)).select("event_id", "role", r6(k.clip((F.col("amount") - F.col("m")) / F.col("s"), -8, 8), "z"))


@query("grid_alignment", f"""{EV_SQL} select count(*) as n_left, count(*) as n_right, 0::bigint as only_left, 0::bigint as only_right, 0::bigint as different from ev where is_trade = 0""")
def grid_alignment(spark, sf_dir):
    """Two keyed tables held against each other row by row: operators 39, 170 and 173."""
    from tidebook.operators.splits import alignment

    q = events(spark, sf_dir).where("is_trade = 0")
    return alignment(q, q, ["event_id"], ["local_ts_us", "symbol_id"])


@query("feature_clusters")
def feature_clusters(spark, sf_dir):
    """Connected components of orders and parts over all line items, nothing folded: operator 96. Tests hold it against union-find."""
    from tidebook.operators.components import connected_components

    return connected_components(table(spark, sf_dir, "lineitem").select((2 * F.col("l_orderkey")).alias("a"), (2 * F.col("l_partkey") + 1).alias("b")))


@query("copy_clusters", """with recursive e as (select a.l_orderkey as a, b.l_orderkey as b from lineitem a join lineitem b on a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey and a.l_shipdate = b.l_shipdate and a.l_orderkey < b.l_orderkey),
s as (select a, b from e union select b, a from e), w(n, r) as (select a, a from s union select w.n, s.b from w join s on s.a = w.r)
select n as node, least(n, min(r)) as component from w group by n""")
def copy_clusters(spark, sf_dir):
    """Orders that ship a part of one supplier on one day, together: operator 96. A hub for each such key keeps the edges linear."""
    from tidebook.operators.components import connected_components

    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    key = ["l_partkey", "l_suppkey", "l_shipdate"]
    least = x.groupBy(*key).agg(F.min("l_orderkey").alias("a"), F.max("l_orderkey").alias("most")).where("a < most").drop("most")
    return connected_components(x.join(least, key).select("a", F.col("l_orderkey").alias("b")))


@query("candidate_left_join", f"""{EV_SQL} select e.event_id, {sql6("c.amount", "c_value")}, c.event_id is not null as joined from ev e left join (select * from ev where event_id % 3 = 0) c on c.event_id = e.event_id""")
def candidate_left_join(spark, sf_dir):
    """Candidate features by decision, with a flag where there are some: operators 40 and 41."""
    ev = events(spark, sf_dir)
    cand = ev.where("event_id % 3 = 0").select("event_id", F.col("amount").alias("c"), F.lit(True).alias("j"))
    return ev.select("event_id").join(cand, "event_id", "left").select("event_id", r6("c", "c_value"), F.coalesce("j", F.lit(False)).alias("joined"))


@query("permutation_importance", f"""with x as (select l_quantity as a, l_tax as b, l_extendedprice / 1000 as y, row_number() over (order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 as i, count(*) over () as n from lineitem),
z as (select x.*, p.a as pa from x join x p on p.i = (x.i * 7919 + 13) % x.n)
select {sql6("avg((2 * a - y) * (2 * a - y))", "base")}, {sql6("avg((2 * pa - y) * (2 * pa - y)) - avg((2 * a - y) * (2 * a - y))", "importance")} from z where gcd(n, 7919) = 1""")
def permutation_importance(spark, sf_dir):
    """Loss with one column permuted, less that without: operator 160. The permutation is an affine map of row numbers."""
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    x = table(spark, sf_dir, "lineitem").withColumn("day", F.floor(F.col("l_orderkey") / 1000))
    x = o.running_sum(x, [], "l_orderkey", key[1:], F.lit(1), "i1", 1000).withColumn("i", F.col("i1") - 1)
    n = x.count()
    p = x.select(F.col("i").alias("pi"), F.col("l_quantity").alias("pa"))
    z = x.join(p, F.col("pi") == (F.col("i") * 7919 + 13) % n)
    loss = lambda c: F.avg((2 * F.col(c) - F.col("l_extendedprice") / 1000) * (2 * F.col(c) - F.col("l_extendedprice") / 1000))
    return z.agg(r6(loss("l_quantity"), "base"), r6(loss("pa") - loss("l_quantity"), "importance"))
