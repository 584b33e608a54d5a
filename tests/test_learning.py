"""Transforms, replayed fills, rewards and contracts against plain loops and hand-made cases."""

import math

import pytest
from pyspark.sql import functions as F

from tidebook.operators import contracts, fills, transforms
from tidebook.plans import registry  # isort: skip
from tidebook.plans import learning
from tidebook.plans.common import H24, HOUR
from tidebook.plans.features import SCALE
from tidebook.sources.market import events

SF_DIR = "/root/testdata/sf0.001"


def test_all_features_normalised_equal_a_plain_loop(spark):
    rows = sorted((r.asDict() for r in learning.feature_rows(spark, SF_DIR).collect()), key=lambda r: (r["symbol_id"], r["local_ts_us"], r["event_id"]))
    got = {r["event_id"]: r for r in registry.queries()["features_normalised"](spark, SF_DIR).collect()}
    assert len(got) == len(rows) and {s.speed for s in transforms.specs()} == {None, "fast", "medium", "slow"}
    base = {
        "identity": lambda x: max(-1e9, min(1e9, x)), "log1p_pos": lambda x: math.log1p(max(x, 0.0)), "time_log1p": lambda x: math.log1p(max(x, 0.0)),
        "signed_log1p": lambda x: math.copysign(math.log1p(abs(x)), x), "ratio_bounded": lambda x: max(-10.0, min(10.0, x)), "sign": lambda x: max(-1.0, min(1.0, x)),
    }
    nonzero = 0
    for s in transforms.specs():
        symbol = mean = var = last = n = None
        for r in rows:
            x = base[s.scale](float(r[s.name] or 0.0))
            if s.speed is None:
                want = x
            elif r["symbol_id"] != symbol:
                symbol, mean, var, last, n, want = r["symbol_id"], x, 0.0, r["local_ts_us"], 1, 0.0
            else:
                want = max(-8.0, min(8.0, (x - mean) / math.sqrt(var))) if n >= 20 and var > 1e-6 else 0.0
                a = 1 - 0.5 ** ((r["local_ts_us"] - last) / (transforms.HALF_LIVES[s.speed] * SCALE))
                d = x - mean
                mean, var, last, n = mean + a * d, (1 - a) * (var + a * d * d), r["local_ts_us"], n + 1
            assert got[r["event_id"]][s.name] == pytest.approx(want, abs=1e-6), (s, r["event_id"])
            nonzero += s.speed is not None and want != 0
    assert nonzero > 1000


def test_diagnostics_count_what_the_scale_changes(spark):
    df = spark.createDataFrame([(float("nan"), 20.0), (1.0, -11.0), (2e9, None)], "mid_slope_bps_per_sec_1000000us double, obi_l1 double")
    got = {r["feature"]: (r["n_rows"], r["n_nonfinite"], r["n_clipped"]) for r in transforms.diagnostics(df, list(df.columns)).collect()}
    assert got["mid_slope_bps_per_sec_1000000us"] == (3, 1, 1) and got["obi_l1"][:2] == (3, 1)


def replayed(tape, orders, wait, delay, trade_weight, shrink_weight, unknown):
    """One order at a time through the whole tape."""
    out = {}
    for o in orders:
        seen, left, top, printed, live_from = False, None, None, 0.0, None
        out[o["order_id"]] = None
        for r in tape:
            now = r["local_ts_us"]
            if seen:
                if now > live_from + wait:
                    break
                if left is None and now > live_from:
                    if not (o["price_tick"] < top[1] if o["side_code"] > 0 else o["price_tick"] > top[0]):
                        out[o["order_id"]] = "rejected"
                        break
                    touch, size = (top[0], top[2]) if o["side_code"] > 0 else (top[1], top[3])
                    left = size if touch == o["price_tick"] else 0.0 if (o["price_tick"] - touch) * o["side_code"] > 0 else unknown
            if r["is_trade"]:
                if r["side_code"] == -o["side_code"] and r["price_tick"] == o["price_tick"]:
                    printed += r["amount"]
                if left is not None and r["side_code"] == -o["side_code"]:
                    if (r["price_tick"] - o["price_tick"]) * o["side_code"] < 0:
                        out[o["order_id"]] = ("trade_through", now)
                        break
                    if r["price_tick"] == o["price_tick"]:
                        left -= trade_weight * r["amount"]
                        if left < -1e-12:
                            out[o["order_id"]] = ("queue_consumed", now)
                            break
                continue
            new = (r["best_bid_tick"], r["best_ask_tick"], r["bid_sz"], r["ask_sz"])
            i = 0 if o["side_code"] > 0 else 1
            if left is not None and top[i] == new[i] == o["price_tick"]:
                left = max(0.0, left - shrink_weight * max(0.0, top[2 + i] - new[2 + i] - printed))
            top, printed = new, 0.0
            if r["event_id"] == o["event_id"]:
                seen, live_from = True, now + delay
                if not delay:
                    touch, size = (top[0], top[2]) if o["side_code"] > 0 else (top[1], top[3])
                    left = size if touch == o["price_tick"] else 0.0 if (o["price_tick"] - touch) * o["side_code"] > 0 else unknown
    return out


@pytest.mark.parametrize("delay", [0, 3])
def test_replayed_fills_equal_one_order_at_a_time(spark, delay):
    import random

    rnd = random.Random(9)
    tape, t = [], 0
    for i in range(400):
        t += rnd.choice((1, 1, 2, 5))
        bid = 100 + rnd.randrange(3)
        tape.append((0, i, t, int(rnd.random() < 0.4), rnd.choice((1, -1)), bid, bid + rnd.choice((1, 1, 2)), float(rnd.randint(1, 9)), float(rnd.randint(1, 9)), 99 + rnd.randrange(6), float(rnd.randint(1, 4))))
    df = spark.createDataFrame(tape, "symbol_id long, event_id long, local_ts_us long, is_trade int, side_code int, best_bid_tick long, best_ask_tick long, bid_sz double, ask_sz double, price_tick long, amount double")
    orders = fills.candidate_orders(df.where("is_trade = 0"), ["symbol_id"], ["touch", "inside_1", "away_1"], lambda n, s: F.lit(0.0))
    got = fills.replayed_fills(orders.drop("queue"), df, ["symbol_id"], wait_us=40, delay_us=delay, trade_weight=0.5, shrink_weight=0.25, unknown=6.0)
    rows = sorted((r.asDict() for r in df.collect()), key=lambda r: (r["local_ts_us"], r["is_trade"], r["event_id"]))
    want = replayed(rows, [r.asDict() for r in orders.collect()], 40, delay, 0.5, 0.25, 6.0)
    have = {r["order_id"]: r["fill_reason"] if r["fill_ts"] is None else (r["fill_reason"], r["fill_ts"]) for r in got.collect()}
    assert have == want
    kinds = {x if x is None or isinstance(x, str) else x[0] for x in want.values()}
    assert kinds >= {None, "trade_through", "queue_consumed"} and ("rejected" in kinds) == bool(delay)


def test_replay_without_shrinking_equals_the_closed_form(spark):
    """Orders at the touch without a delay have the queue that they see: both ways must find the same fills."""
    ev = events(spark, SF_DIR).where("is_trade = 0 or amount > 0")
    orders = fills.candidate_orders(ev.where("is_trade = 0"), ["symbol_id"], ["touch"], lambda n, s: F.col("bid_sz" if s > 0 else "ask_sz"))
    closed = fills.conservative_fills(orders, ev.where("is_trade = 1"), ["symbol_id"], H24, 0, 0.5)
    replay = fills.replayed_fills(orders.drop("queue"), ev, ["symbol_id"], wait_us=H24, shrink_weight=0.0)
    one, two = ({r["order_id"]: (r["fill_ts"], r["fill_reason"]) for r in df.collect()} for df in (closed, replay))
    assert one == two and any(x[0] for x in one.values())
    assert registry.queries()["adverse_labels_balanced"](spark, SF_DIR).count() == ev.where("is_trade = 0").count() and HOUR


def test_contracts(spark):
    grid = spark.createDataFrame([(i * 10,) for i in range(9)], "event_id long")
    assert contracts.grid_start(grid, "event_id", 30, 6) == {"event": 30, "row": 3, "rows_available": 6}
    for wrong in (dict(event=31), dict(event=30, least_rows=7)):
        with pytest.raises(ValueError):
            contracts.grid_start(grid, "event_id", **wrong)
    made = contracts.split_contract(grid, "event_id", {"train": [(0, 3), (4, 5)], "val": [(5, 7)], "test": [(7, 9)]}, {})
    assert made["counts"] == {"train": 4, "val": 2, "test": 2} and contracts.check_contract(made, grid, "event_id") == made
    with pytest.raises(ValueError):
        contracts.check_contract(made | {"rows": 8}, grid, "event_id")
    with pytest.raises(ValueError):
        contracts.check_contract(made, grid.where("event_id > 0"), "event_id")
    with pytest.raises(ValueError):
        contracts.split_contract(grid, "event_id", {"train": [(0, 5)], "val": [(4, 7)], "test": [(7, 9)]}, {})
    with pytest.raises(ValueError):
        contracts.require_edge_targets(["bid_touch_filled"], ["touch"])
    with pytest.raises(ValueError):
        contracts.head_columns(["a"], {"direction": ["b"]})
    with pytest.raises(Exception, match="no finite number"):
        contracts.matrix(spark.createDataFrame([(1.0,), (float("nan"),)], "a double"), ["a"], []).collect()
    assert contracts.environment({"a": 1, "b": 2}, {"b": 3}) == {"a": 1, "b": 3} and contracts.utc_now().endswith("+00:00")
    off = spark.createDataFrame([("price", 3, 1), ("qty", 3, 0)], "rule string, n_rows long, n_off long")
    assert contracts.rule_report(off, "warn") == {"mode": "warn", "compatible": False, "off": {"price": 1}} and contracts.rule_report(off, "off")["compatible"]
    with pytest.raises(ValueError):
        contracts.rule_report(off, "strict")
    rules = spark.sql("select 'B' as symbol, cast(0.50 as decimal(38,18)) as tick_size union all select 'A', cast(null as decimal(38,18))")
    assert contracts.rules_json(rules) == '[{"symbol":"A","tick_size":null},{"symbol":"B","tick_size":"0.5"}]'


def test_an_event_costs_no_more_for_many_resting_orders():
    """20,000 orders rest while 20,000 trades pass them by: that was a step for each pair."""
    import time

    machine, start, found = fills.Resting(wait_us=10**9), time.process_time(), []
    for i in range(40_000):
        row = {"local_ts_us": i, "event_id": i, "is_trade": int(i >= 20_000), "side_code": -1, "price_tick": 101, "amount": 1.0, "best_bid_tick": 100, "best_ask_tick": 102, "bid_sz": 3.0, "ask_sz": 3.0}
        found += machine.step({**row, "orders": [{"order_id": i, "side_code": 1, "price_tick": 100}]})
    found += machine.step({**row, "local_ts_us": 50_000, "price_tick": 99})
    assert len(found) == 20_000 and {r["fill_reason"] for r in found} == {"trade_through"} and time.process_time() - start < 30
