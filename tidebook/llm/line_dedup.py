"""Removal of lines that many documents share.

Two Bloom filters, of lines seen once and of lines seen twice, sort out lines that stand in one document alone. Each
task fills filters for its own rows; where two tasks' once-seen filters share a bit, the twice-seen filter gets it, so
no line of two documents is ever missed. Only lines that the twice-seen filter knows are shuffled, with their document,
to be counted exactly by a 128-bit digest. Documents that hold a line often enough all lose it, but for the one that
the rule keeps: the largest id.

The filter has a fixed number of bits, so what is broadcast is bounded. With far more lines than bits it lets more
lines through to the exact count, which costs a larger shuffle and changes no result. The table of removed lines is
broadcast only within a checked size; beyond it each document gets its own list by a join.

Results, by case: null or empty text is one empty line. Rows with one id are one document; a null id counts as one
document below all others. Repeated lines of a document count once, and all go or stay. An empty table gives no rows.
A kept column with the name of a result has ``_input`` behind its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.arrow import apart, col, map_out, map_rows, plain
from tidebook.llm.shared import measured
from tidebook.session import ship_package, written

#: Bits of a filter, in segments: 2^28 bits are 32 MB.
SEGMENTS, SEGMENT_BITS = 256, 1 << 20
#: Lines that a task gathers before it hands on its filters.
FLUSH_LINES = 150_000
#: Most removed lines whose table is broadcast.
MOST_LINES = 200_000
NULL_ID = -(2**63)

#: White space that is stripped from both ends of a line.
SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The digest of each line's key, or None for keys that are too short."""
    out: list[bytes | None] = []
    for line in (text or "").encode().lower().split(b"\n"):  # bytes: A to Z alone change
        key = line.strip(SPACE)
        out.append(xxhash.xxh3_128_digest(key) if len(key) >= min_chars and len(key.decode()) >= min_chars else None)
    return out


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment and two bit positions of each digest, given as rows of two 64-bit integers."""
    segment = (keys[:, 0] % np.uint64(SEGMENTS)).astype(np.int64)
    bits = np.stack([(keys[:, 0] >> np.uint64(20)) % np.uint64(SEGMENT_BITS), keys[:, 1] % np.uint64(SEGMENT_BITS)], 1)
    return segment, bits.astype(np.uint32)


def _pairs(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def twice_seen(docs: DataFrame, text: str, min_chars: int) -> dict[int, bytes]:
    """The segments of the twice-seen filter that have a bit, packed; ``SEGMENTS`` entries at most."""
    ship_package(docs.sparkSession)
    part = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("once", T.BinaryType()), T.StructField("again", T.BinaryType())])
    whole = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("bits", T.BinaryType())])

    def batch_of(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32()] + [pa.binary()] * (len(schema.fields) - 1)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    def flush(once: set[bytes], again: set[bytes]) -> pa.RecordBatch:
        places = [_places(_pairs(x)) if x else (np.zeros(0, np.int64), np.zeros((0, 2), np.uint32)) for x in (once, again)]
        rows = []
        for s in np.unique(places[0][0]):
            rows.append((int(s), *(np.unique(bits[at == s]).tobytes() for at, bits in places)))
        return batch_of(part, rows)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: set[bytes] = set()
        again: set[bytes] = set()
        for batch in batches:
            for t in batch.column(0):
                own = {k for k in line_keys(t.as_py(), min_chars) if k}
                again |= own & once
                once |= own
                if len(once) >= FLUSH_LINES:
                    yield flush(once, again)
                    once, again = set(), set()
        if once:
            yield flush(once, again)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows stand by segment, so two unpacked filters are held, whatever the number of segments."""
        once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
        at = None

        def finish() -> Iterator[pa.RecordBatch]:
            if at is not None and twice.any():
                yield batch_of(whole, [(at, zlib.compress(np.packbits(twice).tobytes(), 1))])

        for batch in batches:
            for s, first, more in zip(*batch.columns, strict=True):
                if s.as_py() != at:
                    yield from finish()
                    at = s.as_py()
                    once[:] = twice[:] = False
                bits = np.frombuffer(first.as_py(), np.uint32)
                twice[bits[once[bits]]] = True
                once[bits] = True
                twice[np.frombuffer(more.as_py(), np.uint32)] = True
        yield from finish()

    parts = docs.select(col(text).alias("text")).mapInArrow(gather, part)
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, whole)
    return {r["segment"]: bytes(r["bits"]) for r in merged.collect()}  # as many rows as the filter has segments, at most


def suspects(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(key, doc) of the lines that the twice-seen filter knows, once for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, text, min_chars))
    out = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("doc", T.LongType())])

    def make():
        known = np.zeros((SEGMENTS, SEGMENT_BITS // 8), np.uint8)  # packed, as large as the filter
        for s, b in shared.value.items():
            known[s] = np.frombuffer(zlib.decompress(b), np.uint8)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            keys, ids = [], []
            for t, i in zip(batch.column(text), batch.column(doc_id).to_pylist(), strict=True):
                own = list({k for k in line_keys(t.as_py(), min_chars) if k})
                keys += own
                ids += [NULL_ID if i is None else i] * len(own)
            if not keys:
                return None
            segment, bits = _places(_pairs(keys))
            held = known[segment[:, None], bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)
            mask = pa.array((held & 1).all(1), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).filter(mask), pa.array(ids, pa.int64()).filter(mask)], names=["key", "doc"])

        return work

    return map_out(docs, text, [doc_id], make, out)


def repeated(found: DataFrame, min_docs: int) -> DataFrame:
    """(key, keeper) of the lines in at least so many documents, counted exactly. Keys in one task's rows meet before the shuffle."""
    return found.groupBy("key").agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("keeper")).where(F.col("docs") >= min_docs).select("key", "keeper")


def drop_lines(text: str | None, min_chars: int, goes) -> tuple[str, int, int]:
    """The text without the lines whose key ``goes``, its lines before, and how many were dropped."""
    lines = (text or "").split("\n")
    kept = [line for line, k in zip(lines, line_keys(text, min_chars), strict=True) if k is None or not goes(k)]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, keep: list[str] | None = None, texts: bool = True, digests: bool = False, most_lines: int = MOST_LINES) -> DataFrame:
    """``keep`` columns of each row with ``n_lines``, ``n_dropped`` and, as asked, ``kept_text`` with ``kept_words``, and ``kept_sha256``."""
    keep = keep if keep is not None else [c for c in docs.columns if c != text]
    read = plain(docs)
    own, body = (f"c{docs.columns.index(c)}" for c in (doc_id, text))
    places = [f"c{docs.columns.index(c)}" for c in keep]
    found = written(suspects(read, own, body, min_chars), "suspects")
    lines, n = measured(repeated(found, min_docs), "repeated")
    fields = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    fields += [T.StructField("kept_text", T.StringType()), T.StructField("kept_words", T.LongType())] * texts + [T.StructField("kept_sha256", T.StringType())] * digests

    def restored(out: DataFrame) -> DataFrame:
        taken = [f.name for f in fields]
        return out.select(*(F.col(c).alias(n) for c, n in zip(places, apart(keep, taken), strict=True)), *taken)

    def columns(rows) -> dict:
        out: dict[str, list] = {f.name: [] for f in fields}
        for rest, before, dropped in rows:
            out["n_lines"].append(before)
            out["n_dropped"].append(dropped)
            if texts:
                out["kept_text"].append(rest)
                out["kept_words"].append(len(rest.encode().split()))  # bytes: cut at the same white space
            if digests:
                out["kept_sha256"].append(hashlib.sha256(rest.encode()).hexdigest())
        return out

    if n <= most_lines:
        shared = docs.sparkSession.sparkContext.broadcast({bytes(r["key"]): r["keeper"] for r in lines.toLocalIterator()})

        def make():
            keeper = shared.value

            def work(batch: pa.RecordBatch) -> dict:
                ids = batch.column(own).to_pylist()
                return columns(drop_lines(t.as_py(), min_chars, lambda k, i=NULL_ID if i is None else i: keeper.get(k, i) != i) for t, i in zip(batch.column(body), ids, strict=True))

            return work

        return restored(map_rows(read, body, list(dict.fromkeys([*places, own])), make, fields))

    gone = found.join(lines, "key").where("doc <> keeper").groupBy("doc").agg(F.collect_set("key").alias("__gone")).withColumnRenamed("doc", "__doc")
    each = read.join(gone, F.coalesce(col(own).cast("long"), F.lit(NULL_ID)) == F.col("__doc"), "left").drop("__doc")

    def make_by_list():
        def work(batch: pa.RecordBatch) -> dict:
            lists = batch.column("__gone").to_pylist()
            return columns(drop_lines(t.as_py(), min_chars, set(g or ()).__contains__) for t, g in zip(batch.column(body), lists, strict=True))

        return work

    return restored(map_rows(each, body, [*places, "__gone"], make_by_list, fields))


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", min_chars: int = 20, min_docs: int = 3, min_words: int = 0) -> DataFrame:
    """The rows of ``docs`` with the lines dropped from ``text``; a column ``n_chars``, if there is one, counts what is left.

    Rows that lost lines and have fewer than ``min_words`` words left go. With 1 these are the rows whose every word stands in other rows; a larger value
    drops words that stand nowhere else. All columns keep their names and order, whatever the names are.
    """
    names = docs.columns
    read = plain(docs)
    own, body = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    out = dedup(read, own, body, min_chars, min_docs, keep=[c for c in read.columns if c != body])
    back = [F.col("kept_text") if c == body else F.col(c) for c in read.columns]
    if n_chars in names:
        k = names.index(n_chars)
        back[k] = F.when(F.col("n_dropped") > 0, F.length("kept_text")).otherwise(F.col(f"c{k}")).cast(docs.schema[k].dataType)
    out = out.where((F.col("n_dropped") == 0) | (F.col("kept_words") >= min_words))
    return out.select(*(c.alias(n) for c, n in zip(back, names, strict=True)))
