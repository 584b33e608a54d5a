"""Which columns a head reads, what must exist for an edge, where a grid starts, and contracts between tables."""

from __future__ import annotations

import hashlib
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.sources.tape import canonical_json, content_hash

#: The heads of the linear model.
HEADS = ("no_move", "direction", "magnitude_up", "magnitude_down")


def head_columns(available: list[str], by_head: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """The columns of each head in the order of the table: all, or those that are named for it."""
    out = {}
    for head in HEADS:
        wanted = (by_head or {}).get(head, available)
        if lacking := [x for x in wanted if x not in available]:
            raise ValueError(f"{head} asks for unknown columns: {', '.join(lacking)}")
        out[head] = [x for x in available if x in set(wanted)]
        if not out[head]:
            raise ValueError(f"{head} has no columns")
    return out


def matrix(df: DataFrame, columns: list[str], keep: list[str], kind: str = "double", finite: bool = True) -> DataFrame:
    """``keep`` and ``x``, an array of the columns in order; with ``finite``, a row with anything else is an error."""
    if lacking := [x for x in columns if x not in df.columns]:
        raise ValueError(f"unknown columns: {', '.join(lacking)}")
    x = F.array(*(F.col(f"`{n}`").cast(kind) for n in columns))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.select(*keep, (F.when(odd, F.raise_error(F.lit("a row has a value that is no finite number"))).otherwise(x) if finite else x).alias("x"))


def edge_targets(candidates: list[str]) -> list[str]:
    """The adverse targets that an executable edge needs of each candidate."""
    return [f"{side}_{n}_{what}" for n in candidates for what in ("filled", "toxic_cost_bps") for side in ("bid", "ask")]


def require_edge_targets(available: list[str], candidates: list[str]) -> None:
    if lacking := sorted(set(edge_targets(candidates)) - set(available)):
        raise ValueError(f"targets for the executable edge lack: {', '.join(lacking)}")


def grid_start(grid: DataFrame, order: str, event: int | None = None, least_rows: int = 0) -> dict:
    """The row of a grid that a start stands for, its first without one, and how many rows follow, itself included."""
    rows = grid.agg(F.min(order).alias("first"), F.count("*").alias("n")).first()
    start = rows["first"] if event is None else event
    found = grid.agg(F.count_if(F.col(order) == start).alias("hit"), F.count_if(F.col(order) < start).alias("before")).first()
    if not found["hit"]:
        raise ValueError(f"{start} is no row of the grid")
    left = rows["n"] - found["before"]
    if left < least_rows:
        raise ValueError(f"{left} rows from {start} on, {least_rows} are needed")
    return {"event": start, "row": found["before"], "rows_available": left}


def gathered(events: DataFrame, books: DataFrame, trades: DataFrame, pointer: str, key: str) -> DataFrame:
    """Events with the columns of the book or trade that their pointer names: equal joins, as a pointer is a key."""
    add = lambda df, prefix: df.select(F.col(key).alias("__key"), *(F.col(x).alias(f"{prefix}{x}") for x in df.columns if x != key))
    out = events.join(add(books, "book_"), F.col(pointer) == F.col("__key"), "left").drop("__key")
    return out.join(add(trades, "trade_"), F.col(pointer) == F.col("__key"), "left").drop("__key")


def split_contract(grid: DataFrame, order: str, ranges: dict[str, list[tuple[int, int]]], lineage: dict) -> dict:
    """Ranges of grid rows (from, to without it) for each role, with the grid's hash and rows, and the contract's own hash."""
    if lacking := [r for r in ("train", "val", "test") if not ranges.get(r)]:
        raise ValueError(f"no ranges for {', '.join(lacking)}")
    spans = sorted(x for xs in ranges.values() for x in xs)
    n = grid.count()
    if any(a[1] > b[0] for a, b in zip(spans, spans[1:], strict=False)) or any(not 0 <= a < b <= n for a, b in spans):
        raise ValueError("ranges overlap or lie outside the grid")
    body = {"grid": content_hash(grid, [order]), "rows": n, "ranges": {r: [list(x) for x in xs] for r, xs in ranges.items()}, "counts": {r: sum(b - a for a, b in xs) for r, xs in ranges.items()}, **lineage}
    return body | {"sha256": hashlib.sha256(canonical_json(body).encode()).hexdigest()}


def check_contract(contract: dict, grid: DataFrame, order: str) -> dict:
    """The contract, if its hash, counts and grid hold."""
    own = hashlib.sha256(canonical_json({k: v for k, v in contract.items() if k != "sha256"}).encode()).hexdigest()
    counts = {r: sum(b - a for a, b in xs) for r, xs in contract["ranges"].items()}
    if own != contract["sha256"] or counts != contract["counts"]:
        raise ValueError("the split contract has been changed")
    if contract["rows"] != grid.count() or contract["grid"] != content_hash(grid, [order]):
        raise ValueError("the split contract is of another grid")
    return contract


def rules_json(rules: DataFrame) -> str:
    """Symbol rules as canonical JSON, numbers as plain decimals, in the order of the symbols: a row a symbol."""
    text = lambda v: v if v is None or isinstance(v, str) else format(v.normalize(), "f")
    return canonical_json([{k: text(v) for k, v in r.asDict().items()} for r in rules.orderBy("symbol").toLocalIterator()])


def rule_report(violations: DataFrame, mode: str) -> dict:
    """``off``: nothing is checked; ``warn``: what is off the grid is reported; ``strict``: it is an error. ``violations`` as of ``grid_violations``."""
    if mode not in ("off", "warn", "strict"):
        raise ValueError(f"no such mode: {mode}")
    found = {} if mode == "off" else {r["rule"]: r["n_off"] for r in violations.collect() if r["n_off"]}
    if found and mode == "strict":
        raise ValueError(f"rows are off the grid: {canonical_json(found)}")
    return {"mode": mode, "compatible": not found, "off": found}


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def golden(outputs: dict) -> dict[str, dict]:
    """Rows, content hash and seconds of each result: what a later run must give again, but for the seconds."""
    out = {}
    for name, make in outputs.items():
        start = time.perf_counter()
        df = make()
        out[name] = {"sha256": content_hash(df), "rows": df.count(), "seconds": round(time.perf_counter() - start, 3)}
    return out


def environment(defaults: dict, given: dict) -> dict:
    """A configuration: defaults, what is given, and no name that the defaults lack."""
    if odd := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(odd)}")
    return {k: given.get(k, v) for k, v in defaults.items()}
