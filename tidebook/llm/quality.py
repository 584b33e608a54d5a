"""Quality rules by cross-document line frequency.

Every line of a document is normalised (words in lower case, white space between them ignored) and hashed. Within each
host the distinct documents that hold a line are counted, where documents with the same text are one: else the lines of
a text with many exact copies would be over the limit and no copy would be left. Lines above the limit are boilerplate
and removed, lines of a few words above a higher limit of their own; a document with too small a rest is depleted and rejected, beside those that fail
the base rules on words and repeated windows. ``verdicts`` counts the removed words of each document, ``accepted`` gives
the kept documents without the removed lines.

Results, by case: null or empty text has no words and fails the base rules. A null host is a host of its own. Rows with
the same text and host get the same verdict, whatever their ids, so repeated rows and null ids do no harm. Documents of
any length are read whole. An empty table gives no rows. Columns may have any names; a kept column with the name of a
result has ``_input`` behind its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.arrow import apart, map_rows, plain
from tidebook.llm.kernels import _IS_SPACE, Words, _powers, mix
from tidebook.llm.shared import MOST_BROADCAST_ROWS, join_side, measured
from tidebook.session import written

#: A line is boilerplate on a host if more distinct documents than this, and than this share of the host's, hold it.
LIMIT_DOCS, LIMIT_SHARE = 5, 0.02
#: Lines of fewer words recur by chance: they have a limit of their own.
SHORT_WORDS, SHORT_SHARE = 5, 0.1
#: A document is depleted if less than this share of its words remains.
MIN_REST = 0.2
#: Most (host, line) pairs over the limits that are broadcast.
MOST_LINES = 200_000
#: Base rules.
MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
#: Starts a code point of a word: neither white space nor a continuation byte.
_LETTER = ~_IS_SPACE & ((np.arange(256) & 0xC0) != 0x80)

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FIELDS = [T.StructField(m, T.LongType()) for m in METRICS] + [
    T.StructField("line_keys", T.ArrayType(T.LongType())),
    T.StructField("line_words", T.ArrayType(T.LongType())),
]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def repeated_words(h: np.ndarray) -> int:
    """Words within windows of a text that occur twice or more; ``h`` holds the hashes of its 3-word windows."""
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h) + 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return int(covered.sum())


def repeated_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line of the text."""
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def line_keys(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, words and line feeds before (in all texts) of each line with a word, and where each text's lines start (one entry more than texts).

    Keys of short lines are odd, those of others even.
    """
    # lines: words of one text between two line feeds, hashed in order
    feeds = np.cumsum(words.data == 10)
    line = feeds[words.starts] if len(words.starts) else np.zeros(0, np.int64)
    new = np.ones(len(line), bool)
    new[1:] = line[1:] != line[:-1]
    firsts = words.first[:-1]
    new[firsts[firsts < len(line)]] = True
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(line)))
    power, inverse = _powers(len(line) + 1)
    keys = mix(np.add.reduceat(words.hashes * power[: len(line)], at) * inverse[at]).view(np.int64) if len(at) else np.zeros(0, np.int64)
    return (keys & -2) | (sizes < SHORT_WORDS), sizes, line[at], np.searchsorted(at, words.first)


def drop_lines(column: pa.Array, gone: Callable[[int], np.ndarray | None]) -> tuple[list[str | None], list[bool]]:
    """Each text without the lines whose key is in ``gone(row)``, and whether it lost any."""
    words = Words(column, lower=True)
    keys, _, line, first = line_keys(words)
    before = np.concatenate([[0], np.cumsum(words.data == 10)])[words.offsets]
    texts, lost = [], []
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        text, over = column[i].as_py(), gone(i)
        cut = set()
        if over is not None and len(over):
            cut = set((line[a:b][np.isin(keys[a:b], over)] - before[i]).tolist())
        texts.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in cut) if cut else text)
        lost.append(bool(cut))
    return texts, lost


def measure(batch: pa.RecordBatch, text: str) -> dict[str, list]:
    """The base figures of each text, and the normalised lines it holds with their words in it."""
    column = batch.column(text)
    words = Words(column, lower=True)
    raw = Words(column, lower=False)
    windows, bounds = raw.windows(3)
    out: dict[str, list] = {
        "n_words": words.counts,
        "word_chars": _per_text(_LETTER[words.data], words.offsets),
        "n_symbols": _per_text(_SYMBOL[words.data], words.offsets),
        "n_dup_lines": [repeated_lines(t.as_py()) for t in column],
        "n_repeat_words": [repeated_words(windows[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
    }
    keys, sizes, _, first = line_keys(words)
    out["line_keys"], out["line_words"] = [], []
    for a, b in zip(first[:-1], first[1:], strict=True):
        own, where = np.unique(keys[a:b], return_inverse=True)
        out["line_keys"].append(own)
        out["line_words"].append(np.bincount(where, sizes[a:b], len(own)).astype(np.int64))
    return out


def content_keys(text: str, host: str) -> tuple[Column, Column]:
    """What a verdict depends on: the host (null apart from every name) and a 128-bit digest of the text."""
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")), F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _counted(docs: DataFrame, text: str, host: str, keep: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The figures of each row, its distinct lines, the (host, key) pairs over the limits, and how many they are. Columns have plain names."""
    by_host, by_text = content_keys(text, host)
    named = docs.select(*dict.fromkeys([*keep, text]), by_host.alias("host"), by_text.alias("tid"))
    figures = written(map_rows(named, text, [*keep, "host", "tid"], lambda: lambda batch: measure(batch, text), _FIELDS), "quality")
    lines = figures.select("host", "tid", F.explode(F.arrays_zip("line_keys", "line_words")).alias("l"))
    lines = lines.groupBy("host", F.col("l.line_keys").alias("key"), "tid").agg(F.max("l.line_words").alias("words"))
    hosts = figures.groupBy("host").agg(F.count_distinct("tid").alias("host_docs"))
    counts = lines.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") > LIMIT_DOCS)
    share = F.when(F.col("key") % 2 == 0, LIMIT_SHARE).otherwise(SHORT_SHARE)
    over = counts.join(hosts, "host").where(F.col("n") > share * F.col("host_docs")).select("host", "key")
    return figures, lines, *measured(over, "boilerplate")


def _judged(figures: DataFrame, lines: DataFrame, over: DataFrame, n_over: int) -> DataFrame:
    """``figures`` with ``base_failed``, ``kept`` and ``n_removed_words``."""
    side = F.broadcast(over) if n_over <= MOST_BROADCAST_ROWS else over
    removed = lines.join(side, ["host", "key"]).groupBy("host", "tid").agg(F.sum("words").alias("gone"))
    gone = F.coalesce("gone", F.lit(0))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    kept = ~base_failed & (F.col("n_words") - gone >= MIN_REST * F.col("n_words"))
    return figures.join(removed, ["host", "tid"], "left").select("*", base_failed.alias("base_failed"), kept.alias("kept"), gone.alias("n_removed_words"))


def verdicts(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of each row with the base figures, ``base_failed``, ``n_removed_words`` and ``kept``."""
    keep, names = keep or [], docs.columns
    place = {c: f"c{names.index(c)}" for c in [*keep, text, host]}
    result = [*METRICS, "base_failed", "kept", "n_removed_words"]
    judged = _judged(*_counted(plain(docs), place[text], place[host], [place[c] for c in keep]))
    return judged.select(*(F.col(place[c]).alias(n) for c, n in zip(keep, apart(keep, result), strict=True)), *result)


def accepted(docs: DataFrame, text: str = "text", host: str = "source", n_chars: str = "n_chars", most_lines: int = MOST_LINES) -> DataFrame:
    """The rows of ``docs`` whose verdict is to keep them, without the lines over the limits in ``text``.

    A column ``n_chars``, if there is one, counts what is left where lines went. All columns keep their names and order, whatever the names are.
    """
    names = docs.columns
    read = plain(docs)
    body, site = f"c{names.index(text)}", f"c{names.index(host)}"
    figures, lines, over, n_over = _counted(read, body, site, [])
    rejected = _judged(figures, lines, over, n_over).where("not kept").select(F.col("host").alias("rhost"), F.col("tid").alias("rtid")).distinct()
    by_host, by_text = content_keys(body, site)
    keyed = read.select("*", by_host.alias("host"), by_text.alias("tid"))
    side = join_side(rejected, "rejected")
    rest = keyed.join(side, (F.col("host") == F.col("rhost")) & (F.col("tid") == F.col("rtid")), "left_anti")
    keep = [c for c in read.columns if c != body]
    fields = [T.StructField("rest", T.StringType()), T.StructField("lost", T.BooleanType())]

    if n_over <= most_lines:
        by: dict[str, list[int]] = {}
        for r in over.toLocalIterator():
            by.setdefault(r["host"], []).append(r["key"])
        shared = docs.sparkSession.sparkContext.broadcast({h: np.array(x, np.int64) for h, x in by.items()})
        extra = "host"

        def make():
            gone = shared.value

            def work(batch: pa.RecordBatch) -> dict:
                hosts = batch.column("host").to_pylist()
                return dict(zip(("rest", "lost"), drop_lines(batch.column(body), lambda i: gone.get(hosts[i])), strict=True))

            return work
    else:
        each = lines.join(over, ["host", "key"]).groupBy("host", "tid").agg(F.collect_list("key").alias("lines_gone"))
        rest = rest.join(each, ["host", "tid"], "left")
        extra = "lines_gone"

        def make():
            def work(batch: pa.RecordBatch) -> dict:
                lists = batch.column("lines_gone").to_pylist()
                return dict(zip(("rest", "lost"), drop_lines(batch.column(body), lambda i: np.array(lists[i] or [], np.int64)), strict=True))

            return work

    out = map_rows(rest, body, [*keep, extra], make, fields)
    back = [F.col("rest") if c == body else F.col(c) for c in read.columns]
    if n_chars in names:
        k = names.index(n_chars)
        back[k] = F.when(F.col("lost"), F.length("rest")).otherwise(F.col(f"c{k}")).cast(docs.schema[k].dataType)
    return out.select(*(c.alias(n) for c, n in zip(back, names, strict=True)))
