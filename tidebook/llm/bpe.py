"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that stand inside no token of the vocabulary can never end up in one token, so a word may be cut
between them before any merge is tried. The fragments are encoded by themselves and their ids concatenated. Bounded memos
of fragments, and of whole runs between white space, make most of the work a look-up.

The vocabulary is a file of the ``tokenizers`` library: byte-level symbols, an end-of-word suffix, merges in order. Its
path is a parameter; the driver reads it (its size is bounded by the vocabulary) and it travels with the task.

A fragment of n letters takes n log n steps, however long it is.

Results: null text is an empty text with no ids. Special tokens in a text are their own ids, as the library has it by
default. Texts of any length are encoded whole. Repeated rows give repeated results; an empty table gives no rows.
A kept column with the name of a result has ``_input`` behind its own.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.arrow import map_rows

#: Bytes that a worker's memos of runs and of fragments take before they start anew, and the longest run they keep.
MEMO_RUN_BYTES, MEMO_FRAGMENT_BYTES, MEMO_LENGTH = 130_000_000, 40_000_000, 200
#: A longer fragment is merged with a heap.
HEAP_LENGTH = 100
#: Bytes that an entry of a memo takes beside the characters of its key and value.
_ENTRY = 250
#: A vocabulary file above this is refused, as it travels with every task.
MOST_VOCABULARY_BYTES = 64_000_000

#: White space as the library's regular expressions have it.
_SPACE = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Separators that Python takes for white space and the library does not.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
_ENCODERS: dict[str, Encoder] = {}


def byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Memo(dict):
    """A dictionary that computes what it lacks, keeps no long values and never takes more than ``most`` bytes."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.held = compute, most, 0

    def __missing__(self, key):
        found = self.compute(key)
        if len(found) <= 4 * MEMO_LENGTH:  # at least an id for every few bytes: long keys have long values
            size = _ENTRY + 2 * len(found)
            if self.held + size > self.most:
                self.clear()
                self.held = 0
            self.held += size
            self[key] = found
        return found


class Encoder:
    """Encodes and decodes texts with one vocabulary file, given as its JSON text."""

    def __init__(self, spec: str):
        import tokenizers

        j = json.loads(spec)
        model = j["model"]
        if model["type"] != "BPE" or j.get("decoder") or model.get("continuing_subword_prefix"):
            raise ValueError("a byte-level BPE vocabulary without a decoder is needed")
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.bytes = byte_letters()
        letter = {b: c for c, b in self.bytes.items()}
        self.letters = [letter[b] for b in range(256)]
        self.inside = {t[i : i + 2] for t in (x.removesuffix(self.suffix) for x in self.ids) for i in range(len(t) - 1)}
        pattern = j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", _SPACE))
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.whole = tokenizers.Tokenizer.from_str(spec)
        self.fragments = _Memo(self._merge, MEMO_FRAGMENT_BYTES)
        self.memo = _Memo(self._run, MEMO_RUN_BYTES)

    def _cuts(self, s: str) -> list[str]:
        """The fragments of a word between forced boundaries."""
        out, start, inside = [], 0, self.inside
        for i in range(1, len(s)):
            if s[i - 1 : i + 1] not in inside:
                out.append(s[start:i])
                start = i
        out.append(s[start:])
        return out

    def _merge(self, key: tuple[str, bool]) -> bytes:
        """Ids of a fragment as little-endian unsigned integers; the last of a word carries the end-of-word suffix."""
        s, last = key
        parts = list(s)
        if last:
            parts[-1] += self.suffix
        if len(parts) > HEAP_LENGTH:
            return self._merge_long(parts)
        rank, none = self.rank, len(self.rank)
        ranks = [rank.get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:  # the leftmost of the best pairs, and only its neighbours change
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank.get((parts[i], parts[i + 1]), none)
        return b"".join([self.ids[p].to_bytes(4, "little") for p in parts])

    def _merge_long(self, parts: list[str]) -> bytes:
        """The same for a long fragment: a heap of pairs by rank and place, and neighbours as links."""
        rank, n = self.rank, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or rank.get((parts[i], parts[j])) != r:
                continue  # one of the pair has been merged since
            parts[i] += parts[j]
            parts[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return b"".join([self.ids[p].to_bytes(4, "little") for p in parts if p])

    def _word(self, word: str) -> bytes:
        """Ids of one word: its fragments, each encoded by itself."""
        s = "".join([self.letters[b] for b in word.encode()])
        cuts = self._cuts(s)
        return b"".join([self.fragments[(c, False)] for c in cuts[:-1]]) + self.fragments[(cuts[-1], True)]

    def _run(self, run: str) -> bytes:
        """Ids of a run without white space, normalised already: the vocabulary's pattern cuts it into words."""
        if max(run) < "\u0100":
            return b"".join([self._word(w) for w in self.words.findall(run)])
        return b"".join([self._word(bytes([self.bytes[c] for c in w]).decode()) for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(run)])

    def _text(self, text: str) -> bytes:
        """No word has white space in it, so the runs between white space are encoded by themselves."""
        try:
            text.encode("latin-1")  # composed already, and its lower case is the library's
            if any(c in text for c in _SEPARATORS):
                raise UnicodeError
            runs = text.lower().split()
        except UnicodeError:  # rarer letters: the library's own Unicode tables normalise
            runs = [r for r in self.whole.normalizer.normalize_str(text).split(" ") if r]
        memo = self.memo
        return b"".join([memo[r] for r in runs])

    def encode(self, text: str | None) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers, one after another."""
        if not text:
            return b""
        if "<|" not in text or not self.split.search(text):
            return self._text(text)
        out = []
        for piece in self.split.split(text):
            if piece in self.special:
                out.append(self.special[piece].to_bytes(4, "little"))
            elif piece:
                out.append(self._text(piece))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids: without a decoder in the file, the tokens with a space between them."""
        names = self.names
        return b" ".join([names[i] for i in memoryview(ids).cast("I")])


def encoder(spec: str) -> Encoder:
    """The encoder of a vocabulary, kept for later tasks of this Python worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def read_vocabulary(path: str) -> str:
    """The vocabulary file's text, read on the driver after a check of its size."""
    with open(path, encoding="utf-8") as f:
        spec = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(spec) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MOST_VOCABULARY_BYTES} bytes")
    return spec


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, ids: bool = True, decoded: bool = False, digests: bool = False) -> DataFrame:
    """``keep`` columns with ``n_tokens`` and, as asked, ``ids`` (little-endian bytes), ``decoded`` and their digests."""
    keep = keep if keep is not None else [c for c in docs.columns if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    fields = [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.BinaryType())] * ids + [T.StructField("decoded", T.StringType())] * decoded
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] * digests

    def make():
        own = encoder(shared.value)

        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {f.name: [] for f in fields}
            for t in batch.column(text):
                got = own.encode(t.as_py())
                out["n_tokens"].append(len(got) // 4)
                if ids:
                    out["ids"].append(got)
                if decoded or digests:
                    back = own.decode(got)
                    if decoded:
                        out["decoded"].append(back.decode())
                    if digests:
                        out["ids_sha256"].append(hashlib.sha256(got).hexdigest())
                        out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            return out

        return work

    return map_rows(docs, text, keep, make, fields)


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with a ``decoded`` column from its ids (bytes as ``encode`` gives them; null: null)."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.pandas_udf(T.StringType())
    def text(column):
        own = encoder(shared.value)
        return column.map(lambda b: None if b is None else own.decode(bytes(b)).decode())

    return tokens.withColumn("decoded", text(F.col(ids)))
