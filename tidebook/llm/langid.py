"""Language identification by rank-order profiles.

A text is a run of lower-case letters with one separator between words. Its n-grams of one to three signs are ranked by
frequency, and the most frequent are compared to each language's own ranking: an n-gram adds the distance between its
two ranks, or the length of a profile if the language lacks it. The language with the least total is predicted.

Profiles are learned from a bounded sample of labelled rows, chosen by a hash of the id at a rate that the count of rows
fixes; predictions read every text whole. What is broadcast is ``PROFILE`` n-grams for each language.

Results, by case: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was learned.
The score is 1 less the share of the largest possible distance. Ties go to the language first in order, and n-grams of
equal frequency are ranked by their code points. Ids matter only for the sample; a null id counts as the empty text.
Repeated rows give repeated results. An empty table gives no rows. A kept column with the name of a result has ``_input``
behind its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.arrow import chunks, col, map_rows
from tidebook.session import ship_package

#: N-grams of a profile, of a language and of a text alike.
PROFILE = 400
#: Labelled rows that are read to learn, on average.
SAMPLE_DOCS = 20_000
UNDETERMINED = "und"
#: Characters that are read at once.
PIECE = 1_000_000

_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """The lower-case letter of each code point, 0 for what isn't a letter."""
    global _LETTERS
    if _LETTERS is None:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                table[c] = ord(s.lower()[0])
        _LETTERS = table
    return _LETTERS


def grams(text: str | None, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, sorted, as 63-bit integers of up to three code points, and their counts.

    A long text is read in pieces, each behind the two signs before it, so memory is bounded by the distinct n-grams.
    """
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    before = np.zeros(1, np.uint64)  # a text begins with a separator, and ends with one
    text = text or ""
    for at in range(0, len(text), piece):
        signs = letters()[np.frombuffer(text[at : at + piece].encode("utf-32-le"), np.uint32)].astype(np.uint64)
        s = np.concatenate([before, signs, np.zeros(int(at + piece >= len(text)), np.uint64)])
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0)  # one separator between words
        s, old = s[keep], len(before)
        signs = np.maximum(s, np.uint64(1))  # a separator counts as 1, so that no n-gram looks like a shorter one
        two = (signs[:-1] << np.uint64(21)) | signs[1:]
        three = ((two[:-1] << np.uint64(21)) | signs[2:])[max(old - 2, 0) :][s[1:-1][max(old - 2, 0) :] > 0]
        fresh = np.concatenate([s[old:][s[old:] > 0], two[old - 1 :], three])  # n-grams that end in this piece
        keys, where = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([counts, np.ones(len(fresh), np.int64)]), len(keys)).astype(np.int64)
        before = s[-2:]
    return keys, counts


def ranked(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams in order; ``keys`` are sorted, so that ties stand by key."""
    return keys[np.argsort(-counts, kind="stable")[:most]]


def learn(docs: DataFrame, labelled: Column, doc_id: str, text: str, lang: str) -> list[tuple[str, list[int]]]:
    """(language, n-grams by rank) of each language in the sample, by language."""
    rows = docs.where(labelled & col(lang).isNotNull() & col(text).isNotNull())
    n = docs.where(labelled & col(lang).isNotNull()).count()
    rate = min(1.0, SAMPLE_DOCS / max(n, 1))
    picked = F.pmod(F.xxhash64(F.coalesce(col(doc_id).cast("string"), F.lit(""))), F.lit(1 << 30)) < int(rate * (1 << 30))
    ship_package(docs.sparkSession)
    out = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                found: dict[str, list] = defaultdict(list)
                for name, t in zip(part.column("lang").to_pylist(), part.column("text"), strict=True):
                    found[name].append(grams(t.as_py()))
                for name, own in found.items():
                    keys, where = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
                    n = np.bincount(where, np.concatenate([c for _, c in own]), len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], names=out.names)

    counted = rows.where(picked).select(col(lang).cast("string").alias("lang"), col(text).alias("text")).mapInArrow(count, out).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("rank", first).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list[int]] = defaultdict(list)
    for r in sorted(top.select("lang", "rank", "gram").collect()):  # PROFILE rows a language
        profiles[r["lang"]].append(r["gram"])
    return sorted(profiles.items())


class Profiles:
    def __init__(self, learned: list[tuple[str, list[int]]]):
        self.names = [name for name, _ in learned]
        self.keys = np.unique(np.concatenate([np.array(g, np.uint64) for _, g in learned])) if learned else np.zeros(0, np.uint64)
        self.ranks = np.full((len(self.keys) + 1, len(learned)), -1, np.int64)
        for k, (_, g) in enumerate(learned):
            self.ranks[np.searchsorted(self.keys, np.array(g, np.uint64)), k] = np.arange(len(g))

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = grams(text)
        if not len(keys) or not self.names:
            return UNDETERMINED, 0.0
        top = ranked(keys, counts, PROFILE)
        at = np.minimum(np.searchsorted(self.keys, top), len(self.keys) - 1)
        ranks = self.ranks[np.where(self.keys[at] == top, at, len(self.keys))]
        distance = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(top))[:, None])).sum(0)
        k = int(distance.argmin())
        return self.names[k], 1.0 - float(distance[k]) / (PROFILE * len(top))


def identify(docs: DataFrame, labelled: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every row with ``lang_pred`` and ``score``, learned from the rows for which ``labelled`` holds."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labelled, doc_id, text, lang))

    def make():
        profiles = Profiles(shared.value)

        def work(batch: pa.RecordBatch) -> dict:
            found = [profiles.predict(t.as_py()) for t in batch.column(text)]
            return {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return work

    return map_rows(docs, text, keep if keep is not None else [doc_id], make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
