"""Hand-made cases of the operators, and folds against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.operators import fills, flows, folds, linear, metrics, ordered, simulation, splits
from tidebook.operators.components import connected_components
from tidebook.plans.registry import labels
from tidebook.sources import tape

BY = ["symbol_id"]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# ordered streams


def test_asof_takes_the_last_fact_up_to_the_probes_sequence(spark):
    facts = spark.createDataFrame([(0, 100, 1, 10.0), (0, 100, 3, 11.0), (0, 500, 1, 12.0), (1, 90, 1, 99.0)], "symbol_id long, ft long, fs long, v double")
    probes = spark.createDataFrame([(0, 99, 9), (0, 100, 0), (0, 100, 2), (0, 100, 3), (0, 499, 0), (0, 10_000, 0), (2, 100, 5)], "symbol_id long, t long, s long")
    for slice_us in (10, 1000, 10**9):
        got = ordered.asof_join(probes, facts, BY, ("t", "s"), ("ft", "fs"), ["v"], slice_us)
        assert rows(got, "symbol_id", "t", "s") == [(0, 99, 9, None), (0, 100, 0, None), (0, 100, 2, 10.0), (0, 100, 3, 11.0), (0, 499, 0, 11.0), (0, 10_000, 0, 12.0), (2, 100, 5, None)]


def test_at_or_after_ties(spark):
    facts = spark.createDataFrame([(0, 100, 1, 10.0), (0, 100, 3, 11.0), (0, 200, 1, 20.0), (0, 200, 2, 21.0)], "symbol_id long, ft long, fs long, v double")
    probes = spark.createDataFrame([(0, 50, 0), (0, 100, 0), (0, 100, 1), (0, 100, 9), (0, 101, 0), (0, 201, 0)], "symbol_id long, t long, s long")
    for slice_us in (10, 10**9):
        got = ordered.at_or_after(probes, facts, BY, ("t", "s"), ("ft", "fs"), "v", "f", slice_us)
        assert rows(got, "t", "s") == [(0, 50, 0, 10.0), (0, 100, 0, 20.0), (0, 100, 1, 10.0), (0, 100, 9, 11.0), (0, 101, 0, 20.0), (0, 201, 0, None)]


def test_windows_do_not_see_later_events_of_one_microsecond(spark):
    df = spark.createDataFrame([(0, 10, 0, 1), (0, 10, 1, 2), (0, 20, 0, 3), (0, 25, 1, 4)], "symbol_id long, local_ts_us long, is_trade int, event_id long")
    for slice_us in (7, 1000):
        got = ordered.range_features(df, BY, "local_ts_us", ordered.key2(), 10, lambda w: {"n": w.count(F.lit(True), 10)}, slice_us)
        assert rows(got.select("event_id", "n"), "event_id") == [(1, 1), (2, 2), (3, 3), (4, 2)]


def test_extremes_of_neighbouring_trades_equal_loops(spark):
    """Dense and sparse tapes, with ties, runs over many stretches, trades without a side, and frames without a trade."""
    from tidebook.operators import features

    rnd = random.Random(11)
    for step, sides in ((3, (1, -1, 0)), (40, (1, 1, 1, -1)), (400, (1, -1))):
        t, data = 1000, []
        for i in range(150):
            t += rnd.choice((0, 1, step, 2 * step))
            data.append((0, i, t, rnd.randrange(2), rnd.choice(sides), float(rnd.randint(1, 9)), 2.0))
        df = spark.createDataFrame(data, "symbol_id long, event_id long, local_ts_us long, is_trade int, side_code int, price double, amount double").withColumn("notional", F.col("price") * F.col("amount"))
        run_us, gap_us = 60, 150
        make = lambda w: {"a": features.longest_run(w, run_us), "b": features.widest_gap(w, gap_us), "c": features.largest_trade(w, run_us)}  # noqa: B023, E731
        want = {}
        for _, e, now, tr, _, _, _ in data:
            seen = lambda us: sorted((x for x in data if now - us <= x[2] and (x[2], x[3]) <= (now, tr) and x[3]), key=lambda x: (x[2], x[1]))  # noqa: B023, E731
            best = run = 0.0
            side = None
            for x in seen(run_us):
                run = 0.0 if x[4] == 0 else run + 2 * x[5] if x[4] == side else 2 * x[5]
                side, best = x[4], max(best, run)
            gaps = [b[2] - a[2] for a, b in zip(seen(gap_us), seen(gap_us)[1:], strict=False)]
            large = max((((2 * x[5]) * abs(x[4]), -x[2], -x[1], 2 * x[5] * x[4]) for x in seen(run_us)), default=(0, 0, 0, 0.0))[3]
            want[e] = (best, max(gaps, default=0), large)
        for slice_us in (200, 10**6):
            prepare = lambda laid, w: features.trade_stretches(laid, w, run_us, gap_us)  # noqa: B023, E731
            # quotes at a trade's microsecond come before it
            got = ordered.range_features(df, BY, "local_ts_us", ordered.key2(), gap_us, make, slice_us, prepare=prepare, carried=["next_trade"])
            assert {r["event_id"]: (r["a"], r["b"], r["c"] + 0.0) for r in got.select("event_id", "a", "b", "c").collect()} == want


def test_slices_change_no_result(spark):
    rnd = random.Random(2)
    data = [(i % 2, 1 + rnd.randrange(500), i, rnd.randrange(10)) for i in range(200)]
    df = spark.createDataFrame(data, "symbol_id long, local_ts_us long, event_id long, v long")
    for f in (lambda s: ordered.running_sum(df, BY, "local_ts_us", ["event_id"], F.col("v"), "x", s), lambda s: ordered.previous(df, BY, "local_ts_us", ["event_id"], ["v"], "p_", s), lambda s: ordered.last_where(df, BY, "local_ts_us", ["event_id"], {"x": F.when(F.col("v") > 7, F.col("v"))}, s)):
        assert rows(f(10), "event_id") == rows(f(10**6), "event_id")


def test_forward_returns_equal_a_loop_and_keep_copies(spark):
    prices = [(0, t, i, 100.0 + t % 7) for i, t in enumerate([10, 10, 20, 35, 35, 60, 61, 90])] + [(1, 15, 50, 200.0)]
    decided = [(0, 10, 0), (0, 10, 1), (0, 35, 3), (0, 35, 3), (0, 90, 7), (1, 15, 50)]
    spark_prices = spark.createDataFrame(prices, "symbol_id long, local_ts_us long, event_id long, mid double")
    asked = spark.createDataFrame(decided, "symbol_id long, local_ts_us long, event_id long")

    def mid(s, t, seq):
        return next((m for a, b, e, m in reversed(sorted(prices)) if a == s and (b, e) <= (t, seq)), None)

    for delay in (0, 5):
        want = []
        for s, t, e in decided:
            entry = mid(s, t + delay, 2**62 if delay else e)
            last = max(b for a, b, _, _ in prices if a == s)
            exits = [mid(s, t + delay + h, 2**62) if t + delay + h <= last else None for h in (25, 50)]
            want.append((s, t, e, entry, *(None if x is None else round(1e4 * math.log(x / entry), 6) for x in exits)))
        for slice_us in (7, 10**6):
            got = labels.forward_returns(asked, spark_prices, delay, {"a": 25, "b": 50}, slice_us)
            got = got.select("symbol_id", "local_ts_us", "event_id", "entry_mid", F.round("ret_a_bps", 6), F.round("ret_b_bps", 6))
            assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want))


def test_ranks_and_auc_equal_loops_on_skewed_values(spark):
    random.seed(4)
    data = [(float(random.choice([0, 0, 0, 0, 1, 10.0 ** random.randint(-9, 9), random.random()])), random.randint(0, 1)) for _ in range(1500)]
    df = spark.createDataFrame(data, "x double, y int")
    values = [x for x, _ in data]
    got = dict(map(tuple, metrics.average_ranks(df, "x", "r").collect()))
    assert got == {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in set(values)}
    positive, negative = [x for x, y in data if y], [x for x, y in data if not y]
    area = sum((a > b) + 0.5 * (a == b) for a in positive for b in negative) / len(positive) / len(negative)
    assert metrics.exact_auc(df, "y", "x").first()["auc"] == pytest.approx(area, abs=1e-12)
    assert metrics.average_ranks(df.where("false"), "x", "r").count() == 0


def test_interval_join_ends(spark):
    left = spark.createDataFrame([(0, 10, 20), (0, 20, 20)], "symbol_id long, lo long, hi long")
    right = spark.createDataFrame([(0, t) for t in (10, 11, 20, 21)], "symbol_id long, t long")
    for bucket in (3, 100):
        assert rows(ordered.interval_join(left, right, BY, "lo", "hi", "t", bucket).select("t"), "t") == [(11,), (20,)]


# folds


def updates(spark, data):
    return spark.createDataFrame([(0, *d, i) for i, d in enumerate(data)], "symbol_id long, local_ts_us long, is_snapshot boolean, side string, price_tick long, amount double, source_row long")


def test_book_skips_repairs_and_resets(spark):
    u = updates(spark, [
        (50, False, "bid", 990, 1.0),  # before any snapshot
        (100, True, "bid", 1000, 1.0), (100, True, "ask", 1002, 2.0), (100, True, "ask", 1004, 3.0),
        (200, False, "bid", 1003, 5.0),  # crosses the ask at 1002: the side updated last stands
        (300, False, "ask", 1001, 4.0),  # crosses the bid at 1003
        (400, False, "ask", 1500, 0.0),  # deletes what isn't there
        (500, True, "bid", 900, 1.0), (500, True, "ask", 910, 1.0),
    ])
    got = rows(folds.rebuild_book(u, BY).select("local_ts_us", "best_bid_tick", "best_ask_tick", "levels", "crossed_removed", "missing_deletes"), "local_ts_us")
    assert got == [(100, 1000, 1002, 3, 0, 0), (200, 1003, 1004, 3, 1, 0), (300, 1000, 1001, 3, 1, 0), (400, 1000, 1001, 3, 0, 1), (500, 900, 910, 2, 0, 0)]


def grid(spark, data, **how):
    df = spark.createDataFrame([(0, i, *d) for i, d in enumerate(data)], "symbol_id long, event_id long, local_ts_us long, is_trade int, best_bid_tick long, best_ask_tick long, bid_sz double, ask_sz double")
    return rows(folds.decision_grid(df, BY, **how).select("local_ts_us", "reason", "flags", "elapsed_us", "events_since", "trades_since"), "local_ts_us")


def test_scheduler_wakes_throttles_and_beats(spark):
    q = lambda t, b=1000, a=1002, bs=1.0: (t, 0, b, a, bs, 1.0)
    t = lambda t: (t, 1, None, None, None, None)
    got = grid(spark, [q(100), t(150), q(160), q(220), q(300, bs=2.0), q(900), q(950, 0, 0)], least_us=100, most_us=500, fraction=0.25)
    assert got == [(100, 8, 8, None, 1, 0), (220, 2, 2, 120, 3, 1), (900, 1, 5, 680, 2, 0)]
    assert grid(spark, [q(100), q(200), q(300, bs=1.1)], fraction=0.25) == [(100, 8, 8, None, 1, 0)]
    assert grid(spark, [q(100), q(200), q(300, bs=1.1)]) == [(100, 8, 8, None, 1, 0), (300, 4, 4, 200, 2, 0)]


def test_ewma_equals_a_loop(spark):
    rnd = random.Random(1)
    data = [(0, i, 1 + 10 * i + rnd.randrange(9), rnd.gauss(0, 3)) for i in range(120)]
    df = spark.createDataFrame(data, "symbol_id long, event_id long, local_ts_us long, x double")
    got = [r[1] for r in rows(folds.ewma_normalise(df, BY, ["local_ts_us"], ["x"], 200.0).select("event_id", "z_x"), "event_id")]
    m, v, last, want = data[0][3], 0.0, data[0][2], [0.0]
    for n, (_, _, t, x) in enumerate(data[1:], 1):
        want.append(max(-8, min(8, (x - m) / math.sqrt(v))) if n >= 20 and v > 1e-6 else 0.0)
        a = 1 - 2 ** (-(t - last) / 200)
        d = x - m
        m, v, last = m + a * d, (1 - a) * (v + a * d * d), t
    assert np.allclose(got, want)


def test_lots_realise_first_in_first_out(spark):
    df = spark.createDataFrame([(0, 1, 1, 1, 2.0, 100.0), (0, 2, 2, 1, 1.0, 110.0), (0, 3, 3, -1, 2.5, 120.0), (0, 4, 4, -1, 1.0, 90.0)], "symbol_id long, event_id long, local_ts_us long, side_code int, qty double, price double")
    got = rows(folds.fifo_lots(df, BY, ["local_ts_us"]).select("event_id", "realised", "closed_qty", "position", "open_lots"), "event_id")
    assert got == [(1, 0.0, 0.0, 2.0, 1), (2, 0.0, 0.0, 3.0, 2), (3, 45.0, 2.5, 0.5, 1), (4, -10.0, 0.5, -0.5, 1)]


def test_conservative_fill_equals_a_replay(spark):
    rnd = random.Random(7)
    trades = [(0, 1000 + i, 5 * i + rnd.randrange(5), rnd.choice([1, -1]), 100 + rnd.randrange(5), float(rnd.randrange(1, 6))) for i in range(400)]
    orders = [(i, 0, 3 + 13 * i, rnd.choice([1, -1]), 102, float(rnd.randrange(6))) for i in range(100)]
    t = spark.createDataFrame(trades, "symbol_id long, event_id long, local_ts_us long, side_code int, price_tick long, amount double")
    o = spark.createDataFrame(orders, "order_id long, symbol_id long, local_ts_us long, side_code int, price_tick long, queue double")
    for delay, weight in ((0, 0.5), (20, 1.0)):
        want = []
        for oid, _, at, side, price, queue in orders:
            hit = (oid, None, None)
            for _, tid, ts, s, p, q in trades:
                if s == -side and at + delay < ts <= at + delay + 200 and (p - price) * side <= 0:
                    through = (p - price) * side < 0
                    queue -= 0 if through else weight * q
                    if through or queue < -1e-12:
                        hit = (oid, ts, "trade_through" if through else "queue_consumed")
                        break
            want.append(hit)
        got = fills.conservative_fills(o, t, BY, 200, delay, weight, 50)
        assert rows(got.select("order_id", "fill_ts", "fill_reason"), "order_id") == want


def test_volume_buckets_equal_filling_one_after_another(spark):
    rnd = random.Random(3)
    data = [(0, i, 10 * i, rnd.choice([1, -1, 0]), rnd.randrange(1, 40)) for i in range(150)]
    df = spark.createDataFrame(data, "symbol_id long, event_id long, local_ts_us long, side_code int, qty long")
    want, buy, sell = [], 0, 0
    for _, _, _, s, q in data:
        while s and q:
            part = min(q, 50 - buy - sell)
            buy, sell, q = buy + part * (s > 0), sell + part * (s < 0), q - part
            if buy + sell == 50:
                want.append((buy, sell))
                buy = sell = 0
    got = flows.volume_buckets(df, BY, "local_ts_us", ["event_id"], "qty", "side_code", 50, 100)
    assert [r[:2] for r in rows(got.select("buy", "sell", "bucket"), "bucket")] == want


def simulated(spark, data, **policy):
    df = spark.createDataFrame([(0, i, *d) for i, d in enumerate(data)], "symbol_id long, event_id long, local_ts_us long, is_trade int, best_bid_tick long, best_ask_tick long, bid_sz double, ask_sz double, side_code int, price_tick long, amount double")
    return [(r["local_ts_us"], r["what"], r["side_code"], r["qty"]) for r in simulation.simulate(df, BY, **policy).collect()]


def test_simulated_queue_and_cancels(spark):
    q = lambda t, b=100, a=102, bs=2.0: (t, 0, b, a, bs, 2.0, 0, None, None)
    t = lambda at, side, price, qty: (at, 1, None, None, None, None, side, price, qty)
    got = simulated(spark, [q(10), t(11, -1, 100, 3.0), t(12, -1, 100, 3.0), q(13), t(14, 1, 103, 0.5)], qty=1.0)
    assert got == [(10, "place", 1, 1.0), (10, "place", -1, 1.0), (12, "fill", 1, 1.0), (13, "place", 1, 1.0), (14, "fill", -1, 1.0)]
    got = simulated(spark, [q(10), q(20, 101, 103), q(30, 101, 103)], qty=1.0, cancel_us=5)
    assert [g[:3] for g in got] == [(10, "place", 1), (10, "place", -1), (20, "cancel", 1), (20, "place", 1), (20, "cancel", -1), (20, "place", -1)]


def test_head_equals_a_loop(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=60) > 0).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "i long, a double, b double, y int")
    w, b = linear.train_head(df, [F.col("a"), F.col("b")], "y", "i", "logistic", 3, 16)
    ww, bb = np.zeros(2), 0.0
    for _ in range(3):
        for s in range(0, 60, 16):
            e = 1 / (1 + np.exp(-(x[s : s + 16] @ ww + bb))) - y[s : s + 16]
            g, gb = e @ x[s : s + 16] / len(e) + linear.L2 * ww, e.mean()
            k = min(1.0, linear.CLIP / np.sqrt((g**2).sum() + gb**2))
            ww, bb = ww - linear.RATE * k * g, bb - linear.RATE * k * gb
    assert np.allclose(w, ww) and np.isclose(b, bb)


def test_ridge_skips_too_few_rows_and_flat_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, 6.0)], "a double, flat double, y double")
    fit = metrics.ridge(df, ["a", "flat"], "y", 1e-9)
    assert fit["std"][1] == 1.0 and math.isclose(fit["weights"][0] / fit["std"][0], 2.0, rel_tol=1e-6)
    assert metrics.ridge(df.limit(1), ["a"], "y") is None


# tables


def test_csv_needs_its_columns_and_kinds(spark, tmp_path):
    (tmp_path / "a.csv").write_text("local_timestamp,side,price\n100,BUY,1.25\n200,,2.5\n")
    got = tape.read_csv(spark, str(tmp_path / "a.csv"), {"local_timestamp": "bigint", "side": "string", "price": "double", "amount": "double"})
    got = got.select(tape.first_alias(got, "local_ts_us").alias("t"), tape.side_code(got).alias("s"), tape.price_ticks(got, 0.5).alias("k"), "amount")
    assert rows(got, "t") == [(100, 1, 2, None), (200, None, 5, None)]
    (tmp_path / "b.csv").write_text("local_timestamp\nx\n")
    with pytest.raises(Exception, match="not a bigint"):
        tape.read_csv(spark, str(tmp_path / "b.csv"), {"local_timestamp": "bigint"}).collect()
    with pytest.raises(ValueError, match="no column"):
        tape.first_alias(got.drop("t"), "ts_us")


def test_saved_tables_are_checked(spark, tmp_path):
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    tape.save_table(df, str(tmp_path / "t"), "t", ["id"])
    again, body = tape.load_table(spark, str(tmp_path / "t"))
    assert body["rows"] == 50 and rows(again, "id") == rows(df, "id")
    df.write.mode("append").parquet(str(tmp_path / "t/rows"))
    with pytest.raises(ValueError, match="have changed"):
        tape.load_table(spark, str(tmp_path / "t"))


def test_windows_must_not_overlap():
    with pytest.raises(ValueError, match="overlap"):
        splits.roles("t", {"train": (0, 10), "val": (9, 20)})


def test_components_of_a_random_graph_and_a_long_chain(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5, 5), (None, 3)]
    up = {x: x for e in edges for x in e if x is not None and e[0] != e[1] and None not in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert rows(got, "node") == sorted((x, top(x)) for x in up)


def test_csv_columns_go_by_each_file_s_header(spark, tmp_path):
    from tidebook.sources import tape

    (tmp_path / "a.csv").write_text("local_ts_us,price,amount\n1,10.5,2\n2,11.5,3\n")
    (tmp_path / "b.csv").write_text("amount,local_ts_us,price\n7,3,12.5\n")
    (tmp_path / "c.csv").write_text("local_ts_us,amount\n4,9\n")
    got = tape.read_csv(spark, str(tmp_path), {"local_ts_us": "bigint", "price": "double", "amount": "double"})
    assert rows(got, "local_ts_us") == [(1, 10.5, 2.0), (2, 11.5, 3.0), (3, 12.5, 7.0), (4, None, 9.0)]
    same = spark.read.option("header", True).csv([str(tmp_path / "a.csv"), str(tmp_path / "c.csv")], schema="local_ts_us string, x string")
    assert rows(tape.with_source_rows(same).select("local_ts_us", "source_row"), "local_ts_us") == [("1", 0), ("2", 1), ("4", 2)]
    big = tmp_path / "big"
    spark.range(0, 5000, 1, 3).selectExpr("id", "id * 2 as v").write.option("header", True).csv(str(big))
    numbered = tape.with_source_rows(spark.read.option("header", True).csv(str(big)))
    assert sorted(r["source_row"] for r in numbered.collect()) == list(range(5000))


def test_fills_meet_no_pairs_of_orders_and_trades(spark):
    """One join, of orders with their fills: a window full of trades costs what its rows cost."""
    t = spark.createDataFrame([(0, 1, 5, -1, 100, 1.0)], "symbol_id long, event_id long, local_ts_us long, side_code int, price_tick long, amount double")
    o = spark.createDataFrame([(1, 0, 3, 1, 102, 1.0)], "order_id long, symbol_id long, local_ts_us long, side_code int, price_tick long, queue double")
    got = fills.conservative_fills(o, t, BY, 200)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and [tuple(r)[-3:] for r in got.collect()] == [(5, 1, "trade_through")]


def test_the_first_mid_of_a_time_judges_a_fill(spark):
    """As in the SQL; two quotes share the microsecond a horizon after the fill."""
    m = spark.createDataFrame([(0, 1, 10, 90.0), (0, 2, 15, 99.0), (0, 3, 15, 97.0), (0, 4, 16, 95.0)], "symbol_id long, event_id long, local_ts_us long, mid double")
    f = spark.createDataFrame([(1, 0, 3, 1, 100, 5, 50), (2, 0, 3, 1, 100, 6, 50), (3, 0, 3, 1, 100, 7, 50), (4, 0, 3, 1, 100, None, 50)], "order_id long, symbol_id long, local_ts_us long, side_code int, price_tick long, fill_ts long, end_ts long")
    for slice_us in (4, 100):
        got = fills.adverse_labels(f, m, BY, 10, "end_ts", slice_us)
        assert [(r["order_id"], r["future_mid"]) for r in got.orderBy("order_id").collect()] == [(1, 99.0), (2, 95.0), (3, None), (4, None)]


def test_advantages_of_a_long_episode(spark):
    """30,000 steps in one episode against a plain loop; the list that was put together step by step grew with their square."""
    import time

    n = 30_000
    steps = spark.range(n).selectExpr("0L as episode", "id as step", "double(id % 11) as reward", "double(id % 7) as value", "double((id + 1) % 7) as next_value", "id % 5000 = 4999 as done", "double(0.9) as discount")
    start, run, want = time.time(), 0.0, {}
    for i in reversed(range(n)):
        go = float(i % 5000 != 4999)
        run = i % 11 + 0.9 * go * ((i + 1) % 7) - i % 7 + 0.9 * go * 0.95 * run
        want[i] = run
    got = {r["step"]: r["advantage"] for r in simulation.advantages(steps, ["episode"], "step", 0.95).collect()}
    assert got == pytest.approx(want) and time.time() - start < 60


def test_every_kth_row_of_many_partitions(spark):
    got = [r[0] for r in metrics.strided(spark.range(0, 600_000, 1, 8).toDF("event_id"), ["event_id"], 100).collect()]
    assert sorted(got) == list(range(0, 600_000, 6000))


def test_equity_of_many_fills_is_exact(spark):
    """Against whole numbers: a running sum of doubles was off by more than half of 1e-7 here."""
    from tidebook.operators import execution

    n = 150_000
    f = spark.range(n).selectExpr("0L as symbol_id", "id as event_id", "int(if(id % 5 = 0, -1, 1)) as side", "(id * 7919 % 50000) / 100 as qty", "1000 + id * 17 % 41 as price")
    got = execution.positions(f, BY, ["event_id"], "side", "qty", "price", -0.5).select("event_id", F.round(F.col("equity") * 1e7).cast("long").alias("e"))
    got = {r["event_id"]: r["e"] for r in got.collect()}
    held = cash = 0  # in hundredths, and in 1e-7
    for i in range(n):
        side, qty, price = (-1 if i % 5 == 0 else 1), i * 7919 % 50000, 1000 + i * 17 % 41
        held, cash = held + side * qty, cash - side * qty * price * 100_000 + qty * price * 5
        assert abs(got[i] - (cash + held * price * 100_000)) <= 64, i
