"""Benchmark decontamination by SimHash over item-sized windows.

For every benchmark item, windows of a document with as many words as the item are fingerprinted: each five-word shingle
votes on 768 bits, and running sums of the votes give all windows of a stretch at once. A multi-index holds the items'
fingerprints by their size, cut into 48 blocks of 16 bits. A window looks up its own blocks, and those one bit away, in
sorted keys; what it finds are the candidates. Each is verified by the exact weighted similarity of shingle multisets
(sum of the smaller counts over the sum of the larger), 0.75 or more, at every window of the stretch.

Two fingerprints within a radius of 95 bits always agree in some block up to one bit, so none within it is missed. At a
similarity of exactly 0.75 fingerprints differ in 132 bits on average, and some block agrees with a probability of
1 - 1e-5 for each window; above it with more. Of unrelated items a window selects one in a hundred.

Windows are laid at every word of the stretches that could qualify: those around a shingle that some item of that size
has. A window without any common shingle has similarity 0, so leaving it out loses nothing; all others are fingerprinted.

Items are read by the driver in blocks of bounded size, and each block is one pass over the documents, with no shuffle.

Results, by case: null or empty text and items without words match nothing. A document shorter than an item is one window.
Items with fewer words than a shingle are one shingle, which only a document of those words alone has. Rows are judged by
themselves, so repeated rows, null or repeated ids do no harm; repeated items are items of their own. Ties between windows
go to the first. Empty tables give no rows. Other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.llm.arrow import col, map_out, map_rows, plain
from tidebook.llm.kernels import Words, mix

SHINGLE, SIMILARITY = 5, 0.75
#: Bits of a fingerprint, in blocks of sixteen, and the radius within which some block agrees up to one bit.
BITS, BLOCKS = 768, 48
RADIUS = 2 * BLOCKS - 1
#: Bytes of item texts that one pass holds.
MOST_ITEM_BYTES = 4_000_000
#: Windows that are fingerprinted at once.
WINDOWS = 512

_SEEDS = np.random.default_rng(2).integers(1, 2**63, BITS // 64, dtype=np.uint64)
#: What a block may differ by: nothing, or one of its bits.
_FLIPS = np.array([0, *(1 << i for i in range(16))], np.uint16)
_FILTER_BITS = 22


def votes(shingles: np.ndarray) -> np.ndarray:
    """A row of votes, 1 or -1, for each shingle."""
    words = np.stack([mix(shingles ^ seed) for seed in _SEEDS], 1)
    return np.unpackbits(words.view(np.uint8).reshape(len(shingles), BITS // 8), axis=1).astype(np.int8) * 2 - 1


def fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A row of blocks for each window of ``size`` shingles that begins at one of the ascending ``starts``."""
    lo, hi = int(starts[0]), int(starts[-1]) + size
    sums = np.zeros((hi - lo + 1, BITS), np.int32)
    np.cumsum(votes(shingles[lo:hi]), axis=0, out=sums[1:])
    return np.packbits(sums[starts - lo + size] > sums[starts - lo], axis=1).view(np.uint16)


def block_keys(sizes: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """A 64-bit key for each block of each fingerprint: its items' size, its place and its value."""
    place = np.arange(BLOCKS, dtype=np.uint64) << np.uint64(16)
    return (sizes.astype(np.uint64)[:, None] << np.uint64(32)) | place | prints.astype(np.uint64)


class Index:
    """Items by their number of shingles, with the multi-index of their fingerprints, all in flat arrays."""

    def __init__(self, items: list[tuple[object, str]]):
        words = Words(pa.array([t for _, t in items], pa.string()))
        s, bounds = words.shingles(SHINGLE)
        self.ids = [i for i, _ in items]
        self.words = words.counts
        self.sizes = np.diff(bounds)
        own = [np.unique(s[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.first = np.concatenate([[0], np.cumsum([len(k) for k, _ in own])]).astype(np.int64)
        self.shingles = np.concatenate([k for k, _ in own]) if own else np.zeros(0, np.uint64)
        self.counts = np.concatenate([c for _, c in own]).astype(np.int64) if own else np.zeros(0, np.int64)
        some = np.flatnonzero(self.sizes > 0)
        prints = np.concatenate([fingerprints(s[bounds[k] : bounds[k + 1]], np.zeros(1, np.int64), int(self.sizes[k])) for k in some]) if len(some) else np.zeros((0, BLOCKS), np.uint16)
        keys = block_keys(self.sizes[some], prints).reshape(-1)
        order = np.argsort(keys, kind="stable")
        self.keys, self.item_of = keys[order], np.repeat(some, BLOCKS).astype(np.int32)[order]
        # which blocks have a value for any size: most look-ups end here
        self.values = np.zeros((BLOCKS, 1 << 13), np.uint8)
        for b in range(BLOCKS):
            taken = np.zeros(1 << 16, bool)
            taken[prints[:, b]] = True
            self.values[b] = np.packbits(taken, bitorder="little")
        # which sizes have each shingle: a size is at most 2^31, and pairs of both are sorted by shingle, then size
        size = np.repeat(self.sizes, np.diff(self.first))
        order = np.lexsort((size, self.shingles))
        h, z = self.shingles[order], size[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (z[1:] != z[:-1])
        self.held, self.size_of = h[new], z[new]
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[self.held >> np.uint64(64 - _FILTER_BITS)] = True
        self.filter = np.packbits(bits, bitorder="little")

    def hits(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles that items have, and the sizes of those items; once for each size."""
        place = s >> np.uint64(64 - _FILTER_BITS)
        at = np.flatnonzero((self.filter[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
        return _ranges(self.held, s[at], at, self.size_of)

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of the fingerprints and the items of a size that agree in some block up to one bit."""
        near = prints[:, :, None] ^ _FLIPS  # window, block, flip
        held = self.values[np.arange(BLOCKS)[:, None], near >> 3] >> (near & 7).astype(np.uint8)
        row, block, flip = np.nonzero(held & 1)
        keys = np.uint64(size << 32) | (block.astype(np.uint64) << np.uint64(16)) | near[row, block, flip].astype(np.uint64)
        return _ranges(self.keys, keys, row, self.item_of)

    def similarities(self, k: int, s: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """The exact weighted similarity of an item and each window of a stretch."""
        a, b = self.first[k], self.first[k + 1]
        keys, counts = self.shingles[a:b], self.counts[a:b]
        lo, hi = int(starts[0]), int(starts[-1]) + size
        where = np.minimum(np.searchsorted(keys, s[lo:hi]), len(keys) - 1)
        found = np.flatnonzero(keys[where] == s[lo:hi])
        seen = np.zeros((hi - lo + 1, len(keys)), np.int32)
        seen[found + 1, where[found]] = 1
        np.cumsum(seen, axis=0, out=seen)
        same = np.minimum(seen[starts - lo + size] - seen[starts - lo], counts).sum(1)
        return same / (size + self.sizes[k] - same)

    def match(self, s: np.ndarray, at: np.ndarray, own: int) -> dict[int, tuple[float, int]]:
        """The best (similarity, start) of each item of the size ``own`` in a document with shingles ``s`` and hits ``at``."""
        size = min(own, len(s))
        last = len(s) - size
        spread = np.zeros(last + 2, np.int64)  # windows that reach a hit
        np.add.at(spread, np.clip(at - size + 1, 0, last), 1)
        np.add.at(spread, np.minimum(at, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(spread[:-1]) > 0)
        best: dict[int, tuple[float, int]] = {}
        cuts = np.flatnonzero((np.diff(starts) > size) | (np.arange(1, len(starts)) % WINDOWS == 0)) + 1
        for part in np.split(starts, cuts):
            _, items = self.candidates(fingerprints(s, part, size), own)
            for k in np.unique(items).tolist():
                similarity = self.similarities(k, s, part, size)
                j = int(similarity.argmax())
                if similarity[j] >= SIMILARITY and similarity[j] > best.get(k, (0.0, 0))[0]:
                    best[k] = (float(similarity[j]), int(part[j]))
        return best


def _ranges(keys: np.ndarray, wanted: np.ndarray, rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted key, its row with each of the values that stand under it in the sorted keys."""
    lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
    n = hi - lo
    if not n.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.repeat(rows, n), values[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _search(index: Index, column: pa.Array) -> list[list[tuple[int, float, int]]]:
    """For each text its (item, similarity, start) matches, by item."""
    s, bounds = Words(column).shingles(SHINGLE)
    at, z = index.hits(s)
    out: list[list[tuple[int, float, int]]] = [[] for _ in range(len(bounds) - 1)]
    if not len(at):
        return out
    doc = np.searchsorted(bounds, at, "right") - 1
    for d in np.unique(doc):
        own = doc == d
        lo, hi = bounds[d], bounds[d + 1]
        found: dict[int, tuple[float, int]] = {}
        for size in np.unique(z[own]).tolist():
            found |= index.match(s[lo:hi], at[own & (z == size)] - lo, size)
        out[d] = [(k, *found[k]) for k in sorted(found)]
    return out


def item_blocks(items: DataFrame, item_id: str, text: str, most: int = MOST_ITEM_BYTES):
    """The items as lists of (id, text), each of bounded size: a block is read only when the last is done with."""
    named = items.select(col(item_id).alias("id"), F.coalesce(col(text), F.lit("")).alias("text"))
    total = named.agg(F.sum(F.octet_length("text") + 200)).first()[0] or 0
    n = -(-total // most)
    part = F.pmod(F.xxhash64("text", "id"), F.lit(max(n, 1)))
    for k in range(n):
        rows = named.where(part == k).collect() if n > 1 else named.collect()
        yield sorted(((r["id"], r["text"]) for r in rows), key=lambda r: (r[0] is not None, r[0], r[1]))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = MOST_ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words) of each item in each row of ``docs`` that holds it."""
    ids, own = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    out = T.StructType([T.StructField("doc_id", ids), T.StructField("item_id", own), T.StructField("similarity", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType())])
    spark = docs.sparkSession
    result = spark.createDataFrame([], out)
    for k, block in enumerate(item_blocks(items, item_id, item_text, most)):
        shared = spark.sparkContext.broadcast(Index(block))

        def make(shared=shared):
            index = shared.value

            def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                rows = [(d, *m) for d, found in zip(batch.column(doc_id).to_pylist(), _search(index, batch.column(text)), strict=True) for m in found]
                if not rows:
                    return None
                d, item, similarity, start = zip(*rows, strict=True)
                columns = [list(d), [index.ids[i] for i in item], similarity, start, [int(index.words[i]) for i in item]]
                return pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(out.names, columns, strict=True)}, schema=to_arrow_schema(out))

            return work

        found = map_out(docs, text, [doc_id], make, out)
        result = found if k == 0 else result.unionByName(found)
    return result


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = MOST_ITEM_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no item."""
    names, body = docs.columns, f"c{docs.columns.index(text)}"
    rest = plain(docs)
    for block in item_blocks(items, item_id, item_text, most):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block))

        def make(shared=shared):
            index = shared.value
            return lambda batch: {"items": [len(found) for found in _search(index, batch.column(body))]}

        rest = map_rows(rest, body, rest.columns, make, [T.StructField("items", T.IntegerType())]).where("items = 0").drop("items")
    return rest.toDF(*names)
