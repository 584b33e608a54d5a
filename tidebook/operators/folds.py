"""True recursions: folds over ordered rows of a key, with bounded state.

Rows are dealt out by key and sorted within their partition, and a task goes through them in order, holding the state of one
key at a time and no group's rows. So a key of any length takes the memory of its state; keys run in parallel. Where a closed
form exists (book without crossings, volume buckets) the window operators are used instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.operators.ordered import previous, running_sum
from tidebook.session import ship_package


def fold(df: DataFrame, by: list[str], order: list[str | Column], make: Callable[[], object], out: T.StructType) -> DataFrame:
    """Rows that a state machine emits over each key's rows in order.

    ``make()`` gives a fresh machine with ``step(row: dict) -> iterable of dicts`` and ``finish() -> iterable of dicts``;
    the key's columns are added to what it emits.
    """
    ship_package(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in by), *out.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, machine, rows = None, None, []

        def put(found) -> None:
            rows.extend({**dict(zip(by, key, strict=True)), **r} for r in found)

        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[c] for c in by)
                if machine is None or own != key:
                    if machine is not None:
                        put(machine.finish())
                    key, machine = own, make()
                put(machine.step(row))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows.clear()
        if machine is not None:
            put(machine.finish())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


# the book


def l2_batches(updates: DataFrame, by: list[str]) -> DataFrame:
    """Updates of one microsecond as one row, in source order, with the epoch of the snapshot they belong to.

    An epoch begins at a snapshot batch after one that wasn't; before the first it is 0, and a book can't be known there.
    """
    level = F.struct("source_row", "side", "price_tick", "amount", "is_snapshot")
    got = updates.groupBy(*by, "local_ts_us").agg(F.sort_array(F.collect_list(level)).alias("updates"), F.max("is_snapshot").alias("snapshot"))
    got = previous(got, by, "local_ts_us", [], ["snapshot"])
    starts = F.col("snapshot") & ~F.coalesce("prev_snapshot", F.lit(False))
    return running_sum(got, by, "local_ts_us", [], starts.cast("long"), "epoch").drop("prev_snapshot")


@dataclass
class Book:
    """Rebuilds a book from batches of absolute level sizes; emits the top of it after each batch."""

    depth: int = 25
    sides: dict = field(default_factory=lambda: {"bid": {}, "ask": {}})
    snapshot: bool = False
    known: bool = False

    def step(self, row: dict):
        removed, last, skipped, missing = 0, None, 0, 0
        for u in row["updates"]:
            if u["is_snapshot"] and not self.snapshot:
                self.sides = {"bid": {}, "ask": {}}
                self.known = True
            self.snapshot = u["is_snapshot"]
            if not self.known:
                skipped += 1
                continue
            levels = self.sides[u["side"]]
            if u["amount"] > 0:
                levels[u["price_tick"]] = u["amount"]
                last = u["side"]
            elif levels.pop(u["price_tick"], None) is None:
                missing += 1
        if not self.known:
            return
        bids, asks = self.sides["bid"], self.sides["ask"]
        while last and bids and asks and max(bids) >= min(asks):  # the side updated last stands, the other gives way
            (asks.pop(min(asks)) if last == "bid" else bids.pop(max(bids)))
            removed += 1
        top_b, top_a = sorted(bids, reverse=True)[: self.depth], sorted(asks)[: self.depth]
        yield {
            "local_ts_us": row["local_ts_us"], "best_bid_tick": top_b[0] if top_b else None, "best_ask_tick": top_a[0] if top_a else None,
            "levels": len(bids) + len(asks), "total_size": math.fsum([*bids.values(), *asks.values()]),
            "bid_px": top_b, "bid_sz": [bids[p] for p in top_b], "ask_px": top_a, "ask_sz": [asks[p] for p in top_a],
            "crossed_removed": removed, "missing_deletes": missing, "skipped": skipped,
        }

    def finish(self):
        return ()


BOOK = T.StructType([T.StructField(n, t) for n, t in (
    ("local_ts_us", T.LongType()), ("best_bid_tick", T.LongType()), ("best_ask_tick", T.LongType()), ("levels", T.LongType()), ("total_size", T.DoubleType()),
    ("bid_px", T.ArrayType(T.LongType())), ("bid_sz", T.ArrayType(T.DoubleType())), ("ask_px", T.ArrayType(T.LongType())), ("ask_sz", T.ArrayType(T.DoubleType())),
    ("crossed_removed", T.IntegerType()), ("missing_deletes", T.IntegerType()), ("skipped", T.IntegerType()),
)])


def rebuild_book(updates: DataFrame, by: list[str], depth: int = 25) -> DataFrame:
    """The book after each batch, with crossings repaired; epochs of snapshots run in parallel."""
    return fold(l2_batches(updates, by), [*by, "epoch"], ["local_ts_us"], lambda: Book(depth), BOOK)


def book_by_intervals(updates: DataFrame, by: list[str]) -> DataFrame:
    """Best quotes, levels and size after each batch of a book that never crosses, without a fold.

    A level is worth its size from its update to the next; changes of counts are summed along time, and best prices are read
    over the batches that each level's interval meets.
    """
    w = Window.partitionBy(*by, "side", "price_tick").orderBy("local_ts_us")
    iv = updates.withColumn("until", F.lead("local_ts_us").over(w)).where("amount > 0")
    batches = updates.select(*by, "local_ts_us").distinct()
    end = batches.groupBy(*by).agg((F.max("local_ts_us") + 1).alias("end")) if by else batches.agg((F.max("local_ts_us") + 1).alias("end"))
    iv = iv.join(F.broadcast(end), by) if by else iv.crossJoin(F.broadcast(end))  # one row a symbol
    day = 86_400_000_000
    spread = iv.withColumn("until", F.coalesce("until", "end")).withColumnRenamed("local_ts_us", "since")
    spread = spread.withColumn("__day", F.explode(F.sequence(F.floor(F.col("since") / day).cast("long"), F.floor((F.col("until") - 1) / day).cast("long"))))
    dealt = batches.withColumn("__day", F.floor(F.col("local_ts_us") / day).cast("long"))
    live = dealt.join(spread, [*by, "__day"]).where((F.col("since") <= F.col("local_ts_us")) & (F.col("local_ts_us") < F.col("until")))
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    return live.groupBy(*by, "local_ts_us").agg(F.max(F.when(bid, F.col("price_tick"))).alias("best_bid_tick"), F.min(F.when(ask, F.col("price_tick"))).alias("best_ask_tick"), F.count("*").alias("levels"), F.sum("amount").alias("total_size"))


# decisions

HEARTBEAT, TRADE_WAKE, TOP_WAKE, FIRST = 1, 2, 4, 8


@dataclass
class Scheduler:
    """Decides at valid books: the first, those that a trade or a change of the top woke, and after a silence.

    A wake is kept until the least interval has passed; a heartbeat fires after the most. Of reasons at once the heartbeat
    leads, then the trade, then the top of the book; the flags hold them all.
    """

    least_us: int = 0
    most_us: int = 500_000
    fraction: float = 0.0
    last: int | None = None
    top: tuple | None = None
    armed: int = 0
    events: int = 0
    books: int = 0
    trades: int = 0

    def step(self, row: dict):
        self.events += 1
        if row["is_trade"]:
            self.trades += 1
            if self.top is not None:
                self.armed |= TRADE_WAKE
            return
        self.books += 1
        bid, ask = row["best_bid_tick"], row["best_ask_tick"]
        if bid is None or ask is None or not 0 < bid < ask:
            return
        top = (bid, ask, row["bid_sz"], row["ask_sz"])
        if self.top is not None and self._woken(top):
            self.armed |= TOP_WAKE
        self.top = top
        now = row["local_ts_us"]
        if self.last is None:
            flags = FIRST
        else:
            waited = now - self.last
            flags = (HEARTBEAT if waited >= self.most_us else 0) | (self.armed if waited >= self.least_us else 0)
        if not flags:
            return
        reason = next(r for r in (FIRST, HEARTBEAT, TRADE_WAKE, TOP_WAKE) if flags & r)
        since = None if self.last is None else now - self.last
        yield {"event_id": row["event_id"], "local_ts_us": now, "reason": reason, "flags": flags, "elapsed_us": since, "events_since": self.events, "books_since": self.books, "trades_since": self.trades}
        self.last, self.armed, self.events, self.books, self.trades = now, 0, 0, 0, 0

    def _woken(self, top: tuple) -> bool:
        if top[:2] != self.top[:2]:
            return True
        change = [abs(a - b) / max(abs(b), 1e-12) for a, b in zip(top[2:], self.top[2:], strict=True)]
        return any(x >= self.fraction if self.fraction > 0 else x > 0 for x in change)

    def finish(self):
        return ()


GRID = T.StructType([T.StructField(n, T.LongType()) for n in ("event_id", "local_ts_us")] + [T.StructField(n, T.IntegerType()) for n in ("reason", "flags")] + [T.StructField(n, T.LongType()) for n in ("elapsed_us", "events_since", "books_since", "trades_since")])


def decision_grid(tape: DataFrame, by: list[str], least_us: int = 0, most_us: int = 500_000, fraction: float = 0.0) -> DataFrame:
    """One row for each decision over the merged tape, in its order."""
    return fold(tape, by, ["local_ts_us", "is_trade", "event_id"], lambda: Scheduler(least_us, most_us, fraction), GRID)


# normalisation


@dataclass
class Ewma:
    """Z-scores against time-decayed mean and variance as they stood before the row: causal, with a warm-up of zeros."""

    names: tuple
    half_life_us: float = 30_000_000
    least_rows: int = 20
    floor: float = 1e-6
    clip: float = 8.0
    mean: list | None = None
    var: list | None = None
    rows: int = 0
    last: int = 0

    def step(self, row: dict):
        x = [v if (v := row[n]) is not None and math.isfinite(v) else 0.0 for n in self.names]
        now = row["local_ts_us"]
        if self.mean is None:
            self.mean, self.var, z = list(x), [0.0] * len(x), [0.0] * len(x)
        else:
            warm = self.rows >= self.least_rows
            z = [max(-self.clip, min(self.clip, (v - m) / math.sqrt(s))) if warm and s > self.floor else 0.0 for v, m, s in zip(x, self.mean, self.var, strict=True)]
            a = 1 - 2.0 ** (-(now - self.last) / self.half_life_us)
            for i, v in enumerate(x):
                d = v - self.mean[i]
                self.mean[i] += a * d
                self.var[i] = (1 - a) * (self.var[i] + a * d * d)
        self.rows += 1
        self.last = now
        yield {"event_id": row["event_id"], **{f"z_{n}": v for n, v in zip(self.names, z, strict=True)}}

    def finish(self):
        return ()


def ewma_normalise(df: DataFrame, by: list[str], order: list[str], names: list[str], half_life_us: float, least_rows: int = 20) -> DataFrame:
    out = T.StructType([T.StructField("event_id", T.LongType()), *(T.StructField(f"z_{n}", T.DoubleType()) for n in names)])
    return fold(df, by, order, lambda: Ewma(tuple(names), half_life_us, least_rows), out)


# lots


@dataclass
class Lots:
    """First-in first-out matching of fills: what each closing fill realises against the lots it closes, fees pro rata."""

    fee_bps: float = 0.0
    open: list = field(default_factory=list)

    def step(self, row: dict):
        side, qty, price = row["side_code"], row["qty"], row["price"]
        realised, closed = 0.0, 0.0
        while qty > 1e-12 and self.open and self.open[0][0] != side:
            s, q, p = self.open[0]
            part = min(q, qty)
            realised += part * (price - p) * s - part * (price + p) * self.fee_bps / 1e4
            closed += part
            qty -= part
            if q - part <= 1e-12:
                self.open.pop(0)
            else:
                self.open[0] = (s, q - part, p)
        if qty > 1e-12:
            self.open.append((side, qty, price))
        position = math.fsum(s * q for s, q, _ in self.open)
        yield {"event_id": row["event_id"], "realised": realised, "closed_qty": closed, "position": position, "open_lots": len(self.open)}

    def finish(self):
        return ()


def fifo_lots(fills: DataFrame, by: list[str], order: list[str], fee_bps: float = 0.0) -> DataFrame:
    out = T.StructType([T.StructField("event_id", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("realised", "closed_qty", "position")), T.StructField("open_lots", T.IntegerType())])
    return fold(fills, by, order, lambda: Lots(fee_bps), out)


# labels as they mature


@dataclass
class Maturing:
    """Forward returns of decisions, each given out when all its horizons have passed.

    A price in force at a time is known once a later quote comes, so a label matures when time has passed its horizon, or at
    the end when the last quote stands at it. Decisions that never mature are not given out.
    """

    delay_us: int
    horizons: dict
    waiting: list = field(default_factory=list)  # a heap of (time, number, decision, what)
    open: dict = field(default_factory=dict)
    last: tuple | None = None
    n: int = 0

    def _settle(self, until: int, closed: bool):
        import heapq

        while self.waiting and (self.waiting[0][0] < until or closed and self.waiting[0][0] <= until):
            _, _, event, what = heapq.heappop(self.waiting)
            d = self.open[event]
            d[what] = self.last[1]
            if all(h in d for h in ("entry", *self.horizons)):
                del self.open[event]
                yield {"event_id": event, "local_ts_us": d["at"], **{f"ret_{h}_bps": 1e4 * math.log(d[h] / d["entry"]) for h in self.horizons}}

    def step(self, row: dict):
        import heapq

        now = row["local_ts_us"]
        if self.last is not None:
            yield from self._settle(now, False)
        self.last = (now, row["mid"])
        if row["decides"]:
            event = row["event_id"]
            self.open[event] = {"at": now}
            entry = now + self.delay_us
            for what, at in (("entry", entry), *((h, entry + us) for h, us in self.horizons.items())):
                self.n += 1
                heapq.heappush(self.waiting, (at, self.n, event, what))

    def finish(self):
        if self.last is not None:
            yield from self._settle(self.last[0], True)


def matured_labels(quotes: DataFrame, by: list[str], delay_us: int, horizons: dict[str, int]) -> DataFrame:
    """``quotes`` has event_id, local_ts_us, mid and whether a decision falls on it."""
    out = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("local_ts_us", T.LongType()), *(T.StructField(f"ret_{h}_bps", T.DoubleType()) for h in horizons)])
    return fold(quotes, by, ["local_ts_us", "event_id"], lambda: Maturing(delay_us, horizons), out)
