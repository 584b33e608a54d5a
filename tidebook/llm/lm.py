"""Language-model scoring with a log-frequency Bloom filter.

Counts of word pairs are quantised on a logarithmic scale, and a pair of level j is put into a Bloom filter j times, as
(pair, 1) to (pair, j). Probing (pair, 1), (pair, 2) and so on until the first miss gives the level back; errors are
one-sided and grow rarer with each level. The filter holds one small number of bits a pair, whatever the words are.
Word counts are kept exactly, as 64-bit hashes with counts, for the base score and the smoothing:

    P(w | h) = (c(h w) + MU * P(w)) / (c(h) + MU),   P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

with c(h w) the mean count of its level, at most c(h). A text begins after a start mark and closes with an end token.

Training gathers, in every task, the distinct words and pairs with their counts and hands them on by segment, a range of
hashes; each segment is merged by itself. Segments grow in number with the corpus, not in size. A model (filter and counts)
of bounded size goes to every executor as files, which its workers map: it is in no process's own memory, and the driver
passes it on a segment at a time. A larger one stays where it is: blocks of documents are written with their distinct words
and pairs, these go to the bucket of segments that knows them, and the answers come back to the block. That is two
shuffles, whatever the size of the model.

Results, by case: null text is empty, and an empty text has the end token alone. Ids matter only for the hold-out: a null
id counts as the empty text. Repeated rows count as often as they occur. Without training tokens all probabilities are
1 / 1. Texts are read whole. Words of equal 64-bit hash count as one; a billion words have such a pair with 3 percent.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.llm.arrow import chunks, col, map_rows
from tidebook.llm.kernels import Words, mix
from tidebook.session import ship_package, written

#: Text bytes for which there is one segment.
SEGMENT_BYTES = 8_000_000
#: Most segments; beyond so many times the bytes they grow.
MOST_SEGMENTS = 100_000
#: Tokens that a training task gathers before it hands them on.
FLUSH_TOKENS = 600_000
#: Base of the logarithmic scale, bits of the filter for each entry, and its hash functions.
SCALE, ENTRY_BITS, HASHES = 1.5, 6, 4
#: Weight of the word distribution against that of pairs.
MU = 100.0
#: Bytes of the largest model that goes to all executors; beyond it, bytes of model in a bucket, and of text in a block of documents.
MOST_MODEL_BYTES = 4_000_000_000
BUCKET_BYTES, BLOCK_BYTES = 24_000_000, 2_000_000

#: Hashes of the end token and of the start mark, which no word has.
END, START = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)

_LEVELS = 110
_LOW = np.ceil(SCALE ** np.arange(_LEVELS))
#: The mean count of each level; level 0 is unseen.
MEAN = np.concatenate([[0.0], (_LOW + np.maximum(np.ceil(SCALE ** np.arange(1, _LEVELS + 1)) - 1, _LOW)) / 2])
#: The arrays of a model and what they hold.
_ARRAYS = {"words": np.uint64, "counts": np.uint64, "bits": np.uint8}
#: Entries of the segment tables: words, their counts, filter bits, and figures.
_PARTS = T.StructType([T.StructField("segment", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("word_counts", T.BinaryType()), T.StructField("pairs", T.BinaryType()), T.StructField("pair_counts", T.BinaryType())])
_MODEL = T.StructType([T.StructField("segment", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("bits", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("v", T.LongType()), T.StructField("bytes", T.LongType())])


def held_out(doc_id: str, modulus: int = 10, remainder: int = 0) -> Column:
    return F.crc32(F.coalesce(col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def level(counts: np.ndarray) -> np.ndarray:
    """The level of each count, 1 for a count of 1."""
    return np.searchsorted(_LOW, counts, "right").astype(np.int64)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens of some texts, of the pair that each closes, and the bounds of each text."""
    words = Words(column)
    ends = words.first[1:]
    h = np.insert(words.hashes, ends, END)
    bounds = words.first + np.arange(len(words.first))
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[bounds[:-1]] = START
    return h, mix(mix(before) + h * np.uint64(0x9E3779B97F4A7C15)), bounds


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    """Segments are ranges of hashes in order, so their sorted tables one after another are sorted too."""
    return (((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, with the sums of their counts."""
    h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], (np.add.reduceat(n, first) if len(h) else n)


def _places(pairs: np.ndarray, levels: np.ndarray, t: int, size: int | np.ndarray) -> np.ndarray:
    """The place of (pair, level) under hash function ``t`` among ``size`` bits."""
    h = mix(pairs + levels.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    x = (low + np.uint64(t) * high) & np.uint64(0xFFFFFFFF)
    return ((x * np.asarray(size, np.uint64)) >> np.uint64(32)).astype(np.int64)


def fill_bits(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The packed filter of a segment: each pair under each of its levels."""
    top = level(counts)
    h = np.repeat(pairs, top)
    first = np.cumsum(top) - top
    levels = np.arange(len(h)) - np.repeat(first, top) + 1
    size = max(64, -(-len(h) * ENTRY_BITS // 8) * 8)
    bits = np.zeros(size, bool)
    for t in range(HASHES):
        bits[_places(h, levels, t, size)] = True
    return np.packbits(bits, bitorder="little")


def segments_of(docs: DataFrame, text: str) -> int:
    size = docs.agg(F.sum(F.octet_length(col(text)))).first()[0] or 0
    return int(min(max(8, -(-size // SEGMENT_BYTES)), MOST_SEGMENTS))


def train(docs: DataFrame, text: str, segments: int) -> DataFrame:
    """A written table with one row for each segment: its words and counts, its filter, and its totals."""
    ship_package(docs.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[tuple[np.ndarray, np.ndarray]] = []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        seen = 0

        def flush() -> pa.RecordBatch:
            columns = []
            cuts = np.arange(segments + 1)
            for parts in (words, pairs):
                h, n = _counted(parts)
                at = np.searchsorted(segment_of(h, segments), cuts)
                small = n.astype(np.uint32 if not len(n) or n.max() < 2**32 else np.uint64)
                kind = b"\4" if small.dtype == np.uint32 else b"\10"
                columns += [[h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], [kind + small[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]]
            return pa.RecordBatch.from_arrays([pa.array(cuts[:-1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=_PARTS.names)

        for batch in batches:
            for part in chunks(batch, "text"):
                h, p, _ = tokens(part.column("text"))
                words.append(_counted([(h, np.ones(len(h), np.int64))]))
                pairs.append(_counted([(p, np.ones(len(p), np.int64))]))
                seen += len(h)
                if seen >= FLUSH_TOKENS:
                    yield flush()
                    words, pairs, seen = [], [], 0
        if seen:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, ([], [])

        def read(blob: bytes) -> np.ndarray:
            return np.frombuffer(blob, np.uint32 if blob[:1] == b"\4" else np.uint64, offset=1).astype(np.int64)

        def finish() -> pa.RecordBatch:
            (h, n), (p, c) = map(_counted, parts)
            bits = fill_bits(p, c)
            counts = n.astype(np.uint64)
            return pa.RecordBatch.from_pydict({"segment": [at], "words": [h.tobytes()], "counts": [counts.tobytes()], "bits": [bits.tobytes()], "n": [int(n.sum())], "v": [len(h)], "bytes": [16 * len(h) + len(bits)]}, schema=pa.schema([("segment", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("bits", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for s, *blobs in ([x.as_py() for x in row] for row in zip(*batch.columns, strict=True)):
                if s != at:
                    if at is not None:
                        yield finish()
                    at, parts = s, ([], [])
                parts[0].append((np.frombuffer(blobs[0], np.uint64), read(blobs[1])))
                parts[1].append((np.frombuffer(blobs[2], np.uint64), read(blobs[3])))
        if at is not None:
            yield finish()

    found = docs.select(col(text).alias("text")).mapInArrow(gather, _PARTS)
    return written(found.repartition(segments, "segment").sortWithinPartitions("segment").mapInArrow(merge, _MODEL), "lm")


class Group:
    """Some neighbouring segments of a model, as arrays."""

    def __init__(self, rows: list, segments: int):
        sizes = np.zeros(rows[-1]["segment"] - rows[0]["segment"] + 1, np.int64)
        for r in rows:
            sizes[r["segment"] - rows[0]["segment"]] = len(r["bits"])
        arrays = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in _ARRAYS.items())
        self._hold(rows[0]["segment"], sizes, segments, *arrays)

    def _hold(self, first: int, sizes: np.ndarray, segments: int, words: np.ndarray, counts: np.ndarray, bits: np.ndarray) -> None:
        self.segments, self.first, self.last = segments, first, first + len(sizes) - 1
        self.words, self.counts, self.bits = words, counts, bits
        self.size = sizes * 8
        self.base = (np.cumsum(sizes) - sizes) * 8

    @classmethod
    def mapped(cls, name: str, sizes: np.ndarray) -> Group:
        """All segments, from the files that ``_handed_out`` named."""
        group = cls.__new__(cls)
        group._hold(0, sizes, len(sizes), *(np.asarray(np.memmap(SparkFiles.get(f"{name}.{c}"), t, "r")) for c, t in _ARRAYS.items()))
        return group

    def count(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the group's range has each hash, and its exact count."""
        s = segment_of(h, self.segments)
        own = (s >= self.first) & (s <= self.last)
        found = np.zeros(len(h), np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            ok = own & (self.words[at] == h)
            found[ok] = self.counts[at[ok]]
        return own, found

    def levels(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the group's range has each pair, and its level, by probes for 1, 2 and so on until the first miss."""
        s = segment_of(pairs, self.segments)
        own = (s >= self.first) & (s <= self.last)
        found = np.zeros(len(pairs), np.int64)
        left = np.flatnonzero(own)
        left = left[self.size[s[left] - self.first] > 0]
        j = 0
        while len(left):
            j += 1
            for t in range(HASHES):
                seg = s[left] - self.first
                at = self.base[seg] + _places(pairs[left], np.full(len(left), j), t, self.size[seg])
                left = left[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
            found[left] = j
        return own, found


_SCORES = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]


def scores(counts: np.ndarray, levels: np.ndarray, bounds: np.ndarray, n: int, v: int) -> dict[str, np.ndarray]:
    """The figures of some texts from their tokens' counts and pairs' levels; ``n`` tokens and ``v`` words were trained on."""
    word = (counts + 0.1) / (n + 0.1 * (v + 1))
    before = np.empty_like(counts)  # how often the word before was trained on; the start mark once a text
    before[1:] = counts[:-1]
    before[bounds[:-1]] = counts[bounds[1:] - 1]
    pair = np.minimum(MEAN[levels], before)
    smoothed = (pair + MU * word) / (before + MU)
    sums = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every text has its end token
    return {"n_tokens": np.diff(bounds), "n_known": sums((counts > 0).astype(np.int64)), "train_tokens": np.full(len(bounds) - 1, n), "base_score": sums(np.log10(word)), "score": sums(np.log10(smoothed))}


def score(docs: DataFrame, model: DataFrame, segments: int, doc_id: str, text: str, most: int = MOST_MODEL_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    n, v, size = (x or 0 for x in model.agg(F.sum("n"), F.sum("v"), F.sum("bytes")).first())
    if size > most:
        return _score_by_bucket(docs, model, segments, doc_id, text, n, v, -(-size // min(BUCKET_BYTES, most)))
    mapped = _handed_out(model, segments)

    def make():
        group = mapped()

        def work(batch: pa.RecordBatch) -> dict:
            h, p, bounds = tokens(batch.column(text))
            counts, levels = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
            if group is not None:
                for values, hashes, ask in ((counts, h, group.count), (levels, p, group.levels)):
                    distinct, where = np.unique(hashes, return_inverse=True)
                    values[:] = ask(distinct)[1][where]
            return scores(counts, levels, bounds, n, v)

        return work

    return map_rows(docs, text, [doc_id], make, _SCORES)


def _handed_out(model: DataFrame, segments: int) -> Callable[[], Group | None]:
    """Puts a model on every executor's disk, one copy each; the function returned maps it there, in a task."""
    name, folder = f"lm-{uuid.uuid4().hex}", tempfile.mkdtemp(prefix="tidebook-")
    atexit.register(shutil.rmtree, folder, True)  # executors may fetch the files as long as the application runs
    paths = {c: os.path.join(folder, f"{name}.{c}") for c in _ARRAYS}
    sizes = np.zeros(segments, np.int64)
    with contextlib.ExitStack() as stack:
        files = {c: stack.enter_context(open(path, "wb")) for c, path in paths.items()}
        for r in model.orderBy("segment").toLocalIterator():
            sizes[r["segment"]] = len(r["bits"])
            for c, file in files.items():
                file.write(r[c])
    if not os.path.getsize(paths["words"]):
        return lambda: None
    for path in paths.values():
        model.sparkSession.sparkContext.addFile(path)
    return lambda: Group.mapped(name, sizes)


def _score_by_bucket(docs: DataFrame, model: DataFrame, segments: int, doc_id: str, text: str, n: int, v: int, buckets: int) -> DataFrame:
    """``score`` with a model that isn't broadcast: questions are dealt to ``buckets`` of segments, and answers to the blocks that asked."""
    ship_package(docs.sparkSession)
    buckets = min(buckets, segments)
    binary = ("a", "b", "c", "d")
    mail = T.StructType([T.StructField("to", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("place", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in binary)])
    mailed = pa.schema([("to", pa.string()), ("kind", pa.int32()), ("place", pa.int64()), *((c, pa.binary()) for c in binary)])
    ids = T.StructType([T.StructField("ids", T.ArrayType(docs.schema[doc_id].dataType))])
    block = T.StructType([T.StructField("block", T.StringType()), *ids.fields, T.StructField("sizes", T.BinaryType()), *(T.StructField(c, T.BinaryType()) for c in binary)])
    blocked = to_arrow_schema(block)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", BLOCK_BYTES):
                h, p, bounds = tokens(part.column("text"))
                blobs = []
                for x in (h, p):
                    distinct, where = np.unique(x, return_inverse=True)
                    blobs += [distinct.tobytes(), where.astype(np.uint32).tobytes()]
                row = [uuid.uuid4().hex, part.column("id").to_pylist(), np.diff(bounds).tobytes(), *blobs]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, blocked.types, strict=True)], schema=blocked)

    # written, so a block keeps its name and its documents when a task runs again
    asked = written(docs.select(col(doc_id).alias("id"), col(text).alias("text")).mapInArrow(ask, block), "lm-blocks")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *blobs in ([x.as_py() for x in row] for row in zip(*batch.columns, strict=True)):
                parts = []
                for blob in blobs:
                    x = np.frombuffer(blob, np.uint64)
                    at = np.searchsorted(segment_of(x, segments) * buckets // segments, np.arange(buckets + 1))
                    parts.append([x[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)])
                some = [k for k in range(buckets) if parts[0][k] or parts[1][k]]
                m = len(some)
                rows = [[str(k) for k in some], [1] * m, [0] * m, *([x[k] for k in some] for x in parts), [name.encode()] * m, [None] * m]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, mailed.types, strict=True)], schema=mailed)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, group = None, [], None
        for batch in batches:
            for to, kind, place, a, b, c, _ in ([x.as_py() for x in row] for row in zip(*batch.columns, strict=True)):
                if to != at:
                    at, rows, group = to, [], None
                if kind == 0:
                    rows.append({"segment": place, "words": a, "counts": b, "bits": c})
                    continue
                if group is None and rows:
                    group, rows = Group(rows, segments), []
                h, p = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                counts, levels = (group.count(h)[1], group.levels(p)[1]) if group else (np.zeros(len(h), np.int64), np.zeros(len(p), np.int64))
                row = [c.decode(), 1, int(to), counts.tobytes(), levels.astype(np.uint8).tobytes(), None, None]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, mailed.types, strict=True)], schema=mailed)

    out = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), *_SCORES])
    given = to_arrow_schema(out)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = None, ([], [])

        def finish() -> pa.RecordBatch:
            names, sizes, *where = known
            counts = np.frombuffer(b"".join(found[0]), np.int64)[np.frombuffer(where[0], np.uint32)]
            levels = np.frombuffer(b"".join(found[1]), np.uint8)[np.frombuffer(where[1], np.uint32)]
            got = scores(counts, levels, np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))]), n, v)
            return pa.RecordBatch.from_arrays([pa.array(names, given.types[0]), *(pa.array(got[f.name], t) for f, t in zip(_SCORES, given.types[1:], strict=True))], schema=given)

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                _, kind, _, a, b, c, _, names = (x.as_py() for x in row)
                if kind == 0:
                    if known is not None:
                        yield finish()
                    known, found = (names, a, b, c), ([], [])
                else:
                    found[0].append(a)
                    found[1].append(b)
        if known is not None:
            yield finish()

    empty = F.lit(None).cast("binary")
    bucket = F.expr(f"segment * {buckets}L div {segments}L").cast("string")
    own = model.select(bucket.alias("to"), F.lit(0).alias("kind"), F.col("segment").alias("place"), F.col("words").alias("a"), F.col("counts").alias("b"), F.col("bits").alias("c"), empty.alias("d"))
    letters = own.union(asked.select("block", "a", "c").mapInArrow(deal, mail))
    order = ["to", "kind", "place"]
    answers = letters.repartition(buckets, "to").sortWithinPartitions(*order).mapInArrow(answer, mail)
    waiting = asked.select(F.col("block").alias("to"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("place"), F.col("sizes").alias("a"), F.col("b"), F.col("d").alias("c"), empty.alias("d"), "ids")
    both = waiting.union(answers.withColumn("ids", F.lit(None).cast(ids["ids"].dataType)))
    return both.repartition("to").sortWithinPartitions(*order).mapInArrow(collect, out).withColumnRenamed("id", doc_id)


def score_held_out(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST_MODEL_BYTES) -> DataFrame:
    """All rows scored by a model of those that aren't held out, with ``held_out``."""
    segments = segments_of(docs, text)
    model = train(docs.where(~held_out(doc_id)), text, segments)
    found = score(docs.select(col(doc_id).alias("id"), col(text).alias("text")), model, segments, "id", "text", most)
    return found.withColumn("held_out", held_out("id")).withColumnRenamed("id", doc_id)
