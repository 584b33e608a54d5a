"""Queue-aware execution of resting quotes against a tape, as a fold, and the data operators around learning from it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions.kernels import c
from tidebook.operators.folds import fold

EPS = 1e-12


@dataclass
class Order:
    """A resting order: the queue ahead of it, and when it becomes live and stops being so."""

    side: int
    tick: int
    qty: float
    live_at: int
    queue: float
    cancel_at: int | None = None
    live: bool = False


@dataclass(frozen=True)
class QueueModel:
    """How prints and shrinking levels move an order forward.

    ``balanced`` also counts what leaves the level without a print, each by its weight.
    """

    at_level_weight: float = 0.5
    shrink_weight: float = 0.25
    balanced: bool = False
    unknown_queue: float = 1e9

    def ahead(self, side: int, tick: int, bid: int, ask: int, bid_sz: float, ask_sz: float) -> float:
        """Inside the spread nobody is ahead; at the touch all its size is; deeper than is seen, a constant."""
        if bid < tick < ask:
            return 0.0
        if side > 0:
            return bid_sz if tick == bid else self.unknown_queue
        return ask_sz if tick == ask else self.unknown_queue

    def trade(self, order: Order, side: int, tick: int, qty: float) -> float:
        """What a print fills of an order: all of it if it goes through its price, else what is left after the queue."""
        if side != -order.side:
            return 0.0
        gap = (tick - order.tick) * order.side
        if gap < 0:
            return order.qty
        if gap > 0:
            return 0.0
        worn = self.at_level_weight * qty
        left = worn - order.queue
        order.queue = max(0.0, order.queue - worn)
        return min(order.qty, left) if left > EPS else 0.0

    def shrink(self, order: Order, less: float) -> None:
        """Size that left the level without a print: some of it stood ahead."""
        if self.balanced and less > 0:
            order.queue = max(0.0, order.queue - self.shrink_weight * less)


@dataclass
class QuoteSimulator:
    """Keeps one order a side at a fixed distance from the touch, as a policy with a fixed action would.

    Orders become live after all events of the microsecond at which their delay ends, and cancels take effect before those of
    theirs. An order that would take liquidity when it becomes live is rejected. An unchanged quote keeps its order and its
    place in the queue; a changed one is cancelled and replaced.
    """

    qty: float = 1.0
    away: int = 0
    delay_us: int = 0
    cancel_us: int = 0
    most_position: float = 1e9
    fee_bps: float = -0.5
    model: QueueModel = QueueModel()
    orders: list = field(default_factory=list)
    top: tuple | None = None
    position: float = 0.0
    cash: float = 0.0
    prints: dict = field(default_factory=dict)

    def _advance(self, now: int):
        for o in list(self.orders):
            if o.cancel_at is not None and o.cancel_at <= now:
                self.orders.remove(o)
            elif not o.live and o.live_at < now and self.top:
                bid, ask, bs, az = self.top
                safe = o.tick < ask if o.side > 0 else o.tick > bid
                if not safe:
                    self.orders.remove(o)
                    yield self._event(now, o, "rejected", 0.0)
                else:
                    o.live, o.queue = True, self.model.ahead(o.side, o.tick, bid, ask, bs, az)

    def _event(self, now: int, o: Order, what: str, qty: float) -> dict:
        return {"local_ts_us": now, "what": what, "side_code": o.side, "price_tick": o.tick, "qty": qty, "position": self.position, "cash": self.cash}

    def step(self, row: dict):
        now = row["local_ts_us"]
        yield from self._advance(now)
        if row["is_trade"]:
            key = (-row["side_code"], row["price_tick"])
            self.prints[key] = self.prints.get(key, 0.0) + row["amount"]
            for o in [o for o in self.orders if o.live]:
                got = self.model.trade(o, row["side_code"], row["price_tick"], row["amount"])
                if got > EPS:
                    self.position += o.side * got
                    self.cash -= o.side * got * o.tick + got * o.tick * self.fee_bps / 1e4
                    o.qty -= got
                    yield self._event(now, o, "fill", got)
                    if o.qty <= EPS:
                        self.orders.remove(o)
            return
        top = (row["best_bid_tick"], row["best_ask_tick"], row["bid_sz"], row["ask_sz"])
        if self.top:
            for o in [o for o in self.orders if o.live]:
                i = 0 if o.side > 0 else 1
                if o.tick == top[i] == self.top[i]:  # what prints took is no further loss of the level
                    self.model.shrink(o, self.top[2 + i] - top[2 + i] - self.prints.get((o.side, o.tick), 0.0))
        self.prints.clear()
        self.top = top
        for side in (1, -1):
            tick = top[0] - self.away if side > 0 else top[1] + self.away
            wanted = self.position * side < self.most_position
            own = [o for o in self.orders if o.side == side and o.cancel_at is None]
            keep = [o for o in own if wanted and o.tick == tick]
            for o in own:
                if o not in keep:
                    o.cancel_at = now + self.cancel_us
                    yield self._event(now, o, "cancel", o.qty)
            if wanted and not keep:
                o = Order(side, tick, self.qty, now + max(self.delay_us, self.cancel_us if own else 0), 0.0)
                self.orders.append(o)
                yield self._event(now, o, "place", o.qty)

    def finish(self):
        return ()


JOURNAL = T.StructType([T.StructField("local_ts_us", T.LongType()), T.StructField("what", T.StringType()), T.StructField("side_code", T.IntegerType()), T.StructField("price_tick", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("qty", "position", "cash"))])


def simulate(tape: DataFrame, by: list[str], **policy) -> DataFrame:
    """A journal of placed, cancelled, rejected and filled orders of a fixed policy; episodes (keys) run in parallel."""
    return fold(tape, by, ["local_ts_us", "is_trade", "event_id"], lambda: QuoteSimulator(**policy), JOURNAL)


# learning data


def discounts(dt_us, factor: float, horizon_us: float) -> Column:
    """A discount factor for so much time, from one for a horizon."""
    return F.pow(F.lit(factor), c(dt_us) / F.lit(float(horizon_us)))


@dataclass
class Backwards:
    """Generalised advantages of an episode's steps, the last step first."""

    order: str
    gae_lambda: float
    run: float | None = 0.0

    def step(self, row: dict):
        reward, value, discount = row["reward"], row["value"], row["discount"]
        go = 0.0 if row["done"] else 1.0
        known = None not in (reward, value, discount, row["next_value"], self.run)
        self.run = reward + discount * go * row["next_value"] - value + discount * self.gae_lambda * go * self.run if known else None
        yield {self.order: row[self.order], "advantage": self.run, "return": self.run + value if known else None}

    def finish(self):
        return ()


def advantages(steps: DataFrame, by: list[str], order: str, gae_lambda: float) -> DataFrame:
    """Generalised advantages and returns of each episode, scanned backwards by a fold; episodes run in parallel.

    ``steps`` has reward, value, next_value, done and discount. An episode may have any length.
    """
    numbers = {n: F.col(n).cast("double") for n in ("reward", "value", "next_value", "discount")}
    rows = steps.select(*by, F.col(order).cast("long").alias(order), *(x.alias(n) for n, x in numbers.items()), "done")
    out = T.StructType([T.StructField(order, T.LongType()), T.StructField("advantage", T.DoubleType()), T.StructField("return", T.DoubleType())])
    back = F.struct(order, "reward", "value", "next_value", "done", "discount").desc()
    return fold(rows, by, [back], lambda: Backwards(order, gae_lambda), out)


def normalised(df: DataFrame, value: str, name: str, eps: float = 1e-8) -> DataFrame:
    """``df`` with centred values over their population deviation, or centred alone if that is next to nothing."""
    fit = df.agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    centred = c(value) - F.col("__m")
    return df.crossJoin(F.broadcast(fit)).withColumn(name, F.when(F.col("__s") > eps, centred / F.col("__s")).otherwise(centred)).drop("__m", "__s")


def window_starts(n_rows: int, length: int, n: int, kind: str = "cyclic_spread", seed: int = 0) -> list[int]:
    """Start rows of training windows: one at random in each equal part, evenly spread, or one after another."""
    import numpy as np

    room = n_rows - length
    if room < 0:
        raise ValueError("a window is longer than the rows")
    if kind == "stratified_random":
        edges = np.linspace(0, room + 1, n + 1)
        rng = np.random.default_rng(seed)
        return [int(rng.integers(int(a), max(int(a) + 1, int(b)))) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    if kind == "cyclic_spread":
        return [int(round(x)) for x in np.linspace(0, room, n)]
    return [(i * length) % (room + 1) for i in range(n)]


def path_rewards(anchors: DataFrame, equity: DataFrame, by: list[str], horizons: dict[str, int]) -> DataFrame:
    """``anchors`` with the change of equity to each horizon, read at the first row at or after it; null past the end."""
    from tidebook.operators.ordered import at_or_after

    out = anchors
    facts = equity.select(*by, F.col("local_ts_us").alias("e_ts"), F.col("event_id").alias("e_seq"), F.col("equity").alias("e_equity"))
    for name, h in horizons.items():
        probes = out.withColumn("__at", F.col("local_ts_us") + h).withColumn("__seq", F.lit(2**62))
        got = at_or_after(probes, facts, by, ("__at", "__seq"), ("e_ts", "e_seq"), "e_equity", "__later").drop("__at", "__seq")
        out = got.withColumn(f"reward_{name}", F.col("__later") - F.col("equity")).drop("__later")
    return out
