"""Queries over whole tables that have no SQL, against plain loops over all rows."""

import bisect
import collections

import pytest

from tidebook.plans import registry
from tidebook.plans.common import H6, H24, HOUR
from tidebook.sources.market import events, l2_updates

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tape(spark):
    return events(spark, SF_DIR).collect()


def test_every_quote_gets_its_trades(spark, tape):
    trades = collections.defaultdict(list)
    for r in tape:
        if r["is_trade"]:
            trades[r["symbol_id"]].append((r["local_ts_us"], r["amount"]))
    want = {}
    for r in tape:
        if not r["is_trade"]:
            hit = [x for t, x in trades[r["symbol_id"]] if r["local_ts_us"] + HOUR < t <= r["local_ts_us"] + H6]
            want[r["event_id"]] = (len(hit), pytest.approx(sum(x or 0 for x in hit), abs=2e-6))
    got = registry.queries()["interval_trades_in_window"](spark, SF_DIR).collect()
    assert len(got) == len(want) and {r["event_id"]: (r["n_trades"], r["volume"]) for r in got} == want


def test_every_quote_gets_its_rewards(spark, tape):
    later = collections.defaultdict(dict)
    mid = lambda r: (r["best_bid_tick"] + r["best_ask_tick"]) * 0.5
    quotes = [r for r in tape if not r["is_trade"]]
    for r in sorted(quotes, key=lambda r: -r["event_id"]):  # the smallest id of a time stays
        later[r["symbol_id"]][r["local_ts_us"]] = mid(r)
    times = {s: sorted(x) for s, x in later.items()}

    def reward(r, h):
        own = times[r["symbol_id"]]
        k = bisect.bisect_left(own, r["local_ts_us"] + h)
        return later[r["symbol_id"]][own[k]] - mid(r) if k < len(own) else None

    got = registry.queries()["path_rewards"](spark, SF_DIR).collect()
    assert len(got) == len(quotes)
    assert {r["event_id"]: (r["reward_6h"], r["reward_24h"]) for r in got} == {r["event_id"]: (reward(r, H6), reward(r, H24)) for r in quotes}


def test_every_batch_gets_its_best_levels(spark):
    batches = collections.defaultdict(list)
    for r in l2_updates(spark, SF_DIR).collect():
        batches[r["local_ts_us"]].append(r)
    book, want = {"bid": {}, "ask": {}}, set()
    for t in sorted(batches):
        for r in batches[t]:
            book[r["side"]][r["price_tick"]] = r["amount"]
        for side, held in book.items():
            best = sorted((p for p, x in held.items() if x > 0), reverse=side == "bid")[:5]
            want |= {(t, side, i, p, held[p]) for i, p in enumerate(best)}
    got = registry.queries()["book_top_levels"](spark, SF_DIR)
    got = [tuple(r) for r in got.select("local_ts_us", "side", "level", "price_tick", "amount").collect()]
    assert len(got) == len(want) and set(got) == want
    assert len({r[0] for r in got}) > 50


def test_components_of_all_line_items(spark):
    from tidebook.sources.tables import table

    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for r in table(spark, SF_DIR, "lineitem").select("l_orderkey", "l_partkey").collect():
        a, b = sorted((top(2 * r[0]), top(2 * r[1] + 1)))
        up[b] = a
    got = {r["node"]: r["component"] for r in registry.queries()["feature_clusters"](spark, SF_DIR).collect()}
    assert got == {x: top(x) for x in list(up)}


def test_linear_head_equals_a_plain_loop(spark):
    """Train rows alone set the scale and the weights; the whole result is recomputed without Spark."""
    import numpy as np

    from tidebook.operators import linear
    from tidebook.plans.metrics import thirds

    rows = thirds(events(spark, SF_DIR)).select("event_id", "role", "event_type", "bid_sz", "ask_sz", "best_bid_tick").orderBy("event_id").collect()
    x = np.array([[r["bid_sz"], r["ask_sz"], r["best_bid_tick"]] for r in rows], float)
    y = np.array([r["event_type"] == "purchase" for r in rows], float)
    train = np.array([r["role"] == "train" for r in rows])
    z = np.clip((x - x[train].mean(0)) / x[train].std(0, ddof=1), -8, 8)
    block = np.array([r["event_id"] // linear.BATCH for r in rows])
    w, b = np.zeros(3), 0.0
    for _ in range(linear.EPOCHS):
        for k in np.unique(block[train]):
            m = train & (block == k)
            e = 1 / (1 + np.exp(-(z[m] @ w + b))) - y[m]
            step, mean = (e[:, None] * z[m]).mean(0) + linear.L2 * w, e.mean()
            shrink = min(1.0, linear.CLIP / max(np.sqrt((step**2).sum() + mean**2), 1e-300))
            w, b = w - linear.RATE * shrink * step, b - linear.RATE * shrink * mean
    want = {r["event_id"]: p for r, p in zip(rows, 1 / (1 + np.exp(-(z @ w + b))), strict=True)}
    got = registry.queries()["linear_head"](spark, SF_DIR).collect()
    assert {r["event_id"]: r["p"] for r in got} == pytest.approx(want, abs=2e-6)
    found = {r["role"]: r for r in registry.queries()["linear_evaluation"](spark, SF_DIR).collect()}
    for role, r in found.items():
        own = [(want[a["event_id"]], t) for a, t in zip(rows, y, strict=True) if a["role"] == role]
        assert r["n_rows"] == len(own) and r["n_positive"] == sum(t for _, t in own)
        assert r["log_loss"] == pytest.approx(-np.mean([np.log(p if t else 1 - p) for p, t in own]), abs=1e-5)
