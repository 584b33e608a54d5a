"""Secret scans: fixed patterns, and automata inferred from the credentials that the patterns find.

The patterns label credentials in a bounded sample of documents. For each kind the labelled values build a prefix tree
over classes of characters; states whose continuations are statistically compatible (Hoeffding's bound on every relative
frequency, down the tree) are merged, which leaves a probabilistic automaton of the format. What the patterns match, and
every long run of credential characters in any text, is then a candidate: its score is its log-likelihood under the best
automaton, less that under a model of ordinary words. Runs above the threshold are added as spans of kind ``format`` where
no pattern matched; the patterns' own spans stay, whatever their score, and carry it.

What is learned from is bounded: about ``SAMPLE_DOCS`` documents, of their credentials ``MOST_LABELLED`` of each kind and
of their ordinary runs ``MOST_WORDS``, both up to ``MOST_LENGTH`` characters long and chosen by a hash. Scans read all.

Results, by case: null text is empty and has no spans. Texts are scanned whole. Spans count code points, the end excluded,
and stand in the order of start, then kind. Rows are scanned by themselves, so ids, repeated rows and ties do no harm.
Without labelled credentials nothing is added and scores are null. An empty table gives no rows. Columns may have any
names; a kept column with the name of a result has ``_input`` behind its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.arrow import chunks, col, map_rows, texts_buffer
from tidebook.session import ship_package, written

#: The patterns of the base kinds, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "format")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Documents that are read to learn, on average; labelled values of each kind, and ordinary runs, that are used; their longest.
SAMPLE_DOCS, MOST_LABELLED, MOST_WORDS, MOST_LENGTH = 20_000, 400, 4000, 256
#: Observations that the back-off of the model of ordinary runs stands for.
BACK_OFF = 50.0
#: Shortest candidate; confidence of the merging test; log-likelihood ratio that a candidate needs, in all and a character.
MIN_RUN, ALPHA, MIN_RATIO, MIN_RATIO_CHAR = 16, 0.05, 12.0, 0.35

#: Classes of characters in candidates: digits, letters that hex digits have and others, each other sign by itself.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
_CLASS = {c: k for k, s in enumerate(CLASSES) for c in s}
_IN_CLASS = [math.log(len(s)) for s in CLASSES]
_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in _CLASS]] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def base_spans(text: str, lowered: bytes | None = None, hexadecimal: bool = True) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) of the patterns' matches. ``hexadecimal``: whether a long run of hex digits may exist."""
    out = []
    lowered = text.encode().lower() if lowered is None else lowered
    if any(w in lowered for w in _WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if b"akia" in lowered:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if hexadecimal:
        out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(out)


class Automaton:
    """A probabilistic automaton inferred from strings of classes by merging compatible states of their prefix tree."""

    def __init__(self, strings: list[tuple[int, ...]], alpha: float = ALPHA):
        self.next: list[dict[int, int]] = [{}]
        self.flow: list[Counter] = [Counter()]
        self.ends: list[int] = [0]
        for s in strings:
            q = 0
            for c in s:
                self.flow[q][c] += 1
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({})
                    self.flow.append(Counter())
                    self.ends.append(0)
                q = self.next[q][c]
            self.ends[q] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.flow[q].values())

    def _compatible(self, p: int, q: int) -> bool:
        """Whether all relative frequencies of two states, and of those they lead to alike, are within the bound."""
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            far = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > far:
                return False
            for c in {*self.flow[a], *self.flow[b]}:
                if abs(self.flow[a][c] / n - self.flow[b][c] / m) > far:
                    return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a] if c in self.next[b]]
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below ``q`` to ``p``."""
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.flow[a].update(self.flow[b])
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge_states(self) -> None:
        kept = [0]
        while True:
            edge = min(((p, c, t) for p in kept for c, t in self.next[p].items() if t not in kept), key=lambda e: (-self._total(e[2]), e), default=None)
            if edge is None:
                break
            p, c, q = edge
            into = next((r for r in kept if self._compatible(r, q)), None)
            if into is None:
                kept.append(q)
            else:
                self.next[p][c] = into
                self._fold(into, q)
        self.states = kept
        # transitions as tables: state and log-probability for each class, the last row for what was never seen
        place = {q: i for i, q in enumerate(kept)}
        k, lost = len(CLASSES), len(kept)
        self.to = [[lost] * k for _ in range(lost + 1)]
        self.cost = [[-math.log(k + 1) - x for x in _IN_CLASS] for _ in range(lost + 1)]
        self.stop = [-math.log(k + 1)] * (lost + 1)
        for q, i in place.items():
            n = self._total(q) + 0.5 * (k + 1)
            self.stop[i] = math.log((self.ends[q] + 0.5) / n)
            for c in range(k):
                self.cost[i][c] = math.log((self.flow[q][c] + 0.5) / n) - _IN_CLASS[c]
                if c in self.next[q]:
                    self.to[i][c] = place[self.next[q][c]]

    def likelihood(self, s: tuple[int, ...]) -> float:
        """The natural logarithm of the probability of a string."""
        q, total = 0, 0.0
        for c in s:
            total += self.cost[q][c]
            q = self.to[q][c]
        return total + self.stop[q]


class Words:
    """Ordinary words: each character by its class and the one before, with characters of a class by their frequency."""

    def __init__(self, words: list[str]):
        pairs = Counter((a, b) for w in words for a, b in zip(["", *(_CLASS[c] for c in w)], [*(_CLASS[c] for c in w), ""], strict=True))
        first, then = Counter(), Counter()
        for (a, b), n in pairs.items():
            first[a] += n
            then[b] += n
        k = len(CLASSES) + 1
        total = sum(then.values())
        alone = {b: (then[b] + 0.5) / (total + 0.5 * k) for b in ["", *range(k - 1)]}
        # what is seldom seen at all must not count as usual after itself: few observations give way to the classes alone
        self.pair = {(a, b): math.log((pairs[(a, b)] + BACK_OFF * alone[b]) / (first[a] + BACK_OFF)) for a in alone for b in alone}
        signs = Counter(c for w in words for c in w)
        of_class = Counter()
        for c, n in signs.items():
            of_class[_CLASS[c]] += n
        self.sign = {c: math.log((signs[c] + BACK_OFF / len(CLASSES[x])) / (of_class[x] + BACK_OFF)) for c, x in _CLASS.items()}

    def likelihood(self, run: str) -> float:
        total, before = 0.0, ""
        for c in run:
            x = _CLASS[c]
            total += self.pair[before, x] + self.sign[c]
            before = x
        return total + self.pair[before, ""]


class Model:
    def __init__(self, labelled: dict[str, list[str]], words: list[str]):
        self.automata = [Automaton([tuple(_CLASS[c] for c in s) for s in values]) for _, values in sorted(labelled.items()) if values]
        self.words = Words(words)

    def score(self, run: str) -> float | None:
        """The log-likelihood ratio of a credential of some format to an ordinary run; None if nothing was learned."""
        if not self.automata:
            return None
        s = tuple(_CLASS[c] for c in run)
        return max(a.likelihood(s) for a in self.automata) - self.words.likelihood(run)


def likely(score: float | None, length: int) -> bool:
    """Whether a candidate of so many characters passes for a credential."""
    return score is not None and score >= MIN_RATIO and score >= MIN_RATIO_CHAR * length


def learn(docs: DataFrame, text: str) -> Model:
    """The automata of a bounded sample of documents, chosen by a hash of their text at a rate that the row count fixes."""
    rate = min(1.0, SAMPLE_DOCS / max(docs.count(), 1))
    picked = F.pmod(F.xxhash64(col(text)), F.lit(1 << 30)) < int(rate * (1 << 30))
    ship_package(docs.sparkSession)
    out = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
        for batch in batches:
            for part in chunks(batch, "text"):
                found = set()
                for t in part.column("text"):
                    spans = base_spans(t.as_py())
                    found |= {(KINDS[k], v) for _, k, _, v in spans if len(v) <= MOST_LENGTH}
                    free = (m for m in plain.finditer(t.as_py()) if not any(s < m.end() and m.start() < e for s, _, e, _ in spans))
                    found |= {("word", m[0]) for m in free if len(m[0]) <= MOST_LENGTH}
                if found:
                    kinds, values = zip(*sorted(found), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(values)], names=out.names)

    seen = written(docs.where(picked & col(text).isNotNull()).select(col(text).alias("text")).mapInArrow(label, out).distinct(), "labelled")

    def some(kind: str, most: int) -> list[str]:
        return [r["value"] for r in seen.where(F.col("kind") == kind).orderBy(F.md5("value"), "value").limit(most).collect()]

    return Model({k: some(k, MOST_LABELLED) for k in KINDS[:3]}, some("word", MOST_WORDS))


def runs(flags: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of flagged bytes within a text, of at least so many bytes."""
    edges = np.zeros(len(flags) + 1, np.int8)
    edges[:-1] += flags
    edges[1:] -= flags
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    # runs that go on from one text into the next are cut between them
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(flags))]
    cut = np.unique(inner[flags[inner] & flags[inner - 1]])
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    long = ends - starts >= least
    return starts[long], ends[long]


def scan_batch(column: pa.Array, model: Model) -> list[list[tuple[int, int, int, float | None, bool]]]:
    """(start, kind, end, score, likely) of all spans of each text."""
    data, offsets = texts_buffer(column)
    lowered = data.tobytes().lower()
    starts, ends = runs(_RUN[data], offsets, MIN_RUN)
    doc = np.searchsorted(offsets, starts, "right") - 1
    has_hex = set((np.searchsorted(offsets, runs(_HEX[data], offsets, MIN_HEX)[0], "right") - 1).tolist())
    out = []
    first = np.searchsorted(doc, np.arange(len(offsets)))
    for d, t in enumerate(column):
        lo, hi = int(offsets[d]), int(offsets[d + 1])
        text = t.as_py() or ""
        base = base_spans(text, lowered[lo:hi], d in has_hex)
        spans = [(s, k, e, score := model.score(v), likely(score, len(v))) for s, k, e, v in base]
        for j in range(first[d], first[d + 1]) if model.automata else ():
            a, b = int(starts[j]), int(ends[j])
            score = model.score(data[a:b].tobytes().decode())
            if likely(score, b - a):
                at = len(data[lo:a].tobytes().decode())
                if not any(s < at + b - a and at < e for s, _, e, _ in base):
                    spans.append((at, 3, at + b - a, score, True))
        out.append(sorted(spans))
    return out


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every row with ``found``: an array of (kind, start, end, score, likely) in order."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, text))
    kinds = {"kind": T.StringType(), "start": T.LongType(), "end": T.LongType(), "score": T.DoubleType(), "likely": T.BooleanType()}
    span = T.StructType([T.StructField(n, t) for n, t in kinds.items()])

    def make():
        model = shared.value
        return lambda batch: {"found": [[dict(zip(kinds, (KINDS[k], s, e, score, ok), strict=True)) for s, k, e, score, ok in spans] for spans in scan_batch(batch.column(text), model)]}

    return map_rows(docs, text, keep if keep is not None else [c for c in docs.columns if c != text], make, [T.StructField("found", T.ArrayType(span))])
