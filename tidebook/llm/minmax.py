"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct five-word shingles. Under each permutation both the smallest and the largest hash
of the set are kept, so a signature needs half the hash evaluations of one with minima alone, and the two values of a
permutation hardly depend on each other. Bands of signature values name candidates; links are confirmed on full sets.

1. One pass makes, for each document, the size and 128-bit digest of its set and its band keys.
2. Documents with the same set are one class, whose smallest id stands for it. Copies go no further.
3. Of the classes under a band key, each is compared with the smallest id: linear in the members, however many they are.
   The smallest meets them in blocks, one task a block. The components of these links join most of what belongs together.
4. Where a key still holds classes of different components beside the smallest, these are compared with one another. They
   hang together through the smallest of them, and the components of these ties are units that no link leaves. The full
   sets of a unit meet in one task, or, for large units, block by block in a task for each two blocks; where that is less
   work, a large unit is cut up by its band keys. A task counts shared shingles through an inverted list, confirms links
   and hands on those that join two components, at most one fewer than its members. No pairs are listed.
5. The components of the confirmed links are the groups.

With 56 bands of six values, a link at exactly the threshold is missed with a probability of 2e-5, above it with less, if
the sets are large. The smallest and largest value of small sets depend on each other, so a set of up to nine shingles has
exact keys as well: itself, and itself less any shingles that it may lack in a partner of up to nine. Such links aren't missed.

Results, by case: a text with fewer words than a shingle has its whole sequence as one shingle; null or empty text has
an empty set and is linked with nothing. Ids are integers; other types raise a ValueError. Rows that share an id are one
document. A row with a null id has a null group and is kept. An empty table gives no rows. Texts are read whole, whatever
their length. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.arrow import col, map_rows, plain
from tidebook.llm.kernels import Words, mix, sets
from tidebook.llm.shared import join_side
from tidebook.operators.components import connected_components
from tidebook.session import drop_written, ship_package, written

#: Words of a shingle, and the similarity from which two documents are linked, in hundredths.
SHINGLE, PERCENT = 5, 75
#: Bands and the signature values in each; two values a permutation.
BANDS, BAND_VALUES = 56, 6
#: Shingles up to which a set has exact keys.
FEW = 9
#: Most classes, and shingles, of a block of a unit; most classes that are compared with a smallest id in one task.
BLOCK_DOCS, BLOCK_SHINGLES, STAR_DOCS = 256, 300_000, 256

_RANDOM = np.random.default_rng(8)
_PERMUTATIONS = BANDS * BAND_VALUES // 2
_XOR = _RANDOM.integers(0, 2**32, _PERMUTATIONS, dtype=np.uint32)
_FACTOR = _RANDOM.integers(0, 2**32, _PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_BAND_STEP = _RANDOM.integers(0, 2**63, BAND_VALUES, dtype=np.uint64) | np.uint64(1)


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each set under every permutation: a row for each set that isn't empty."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), 2 * _PERMUTATIONS), np.uint32)
    if len(starts):
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        h = np.empty_like(x)
        for i in range(_PERMUTATIONS):
            np.bitwise_xor(x, _XOR[i], out=h)
            np.multiply(h, _FACTOR[i], out=h)
            out[:, 2 * i] = np.minimum.reduceat(h, starts)
            out[:, 2 * i + 1] = np.maximum.reduceat(h, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature, apart for every band."""
    v = signature.reshape(len(signature), BANDS, BAND_VALUES).astype(np.uint64)
    h = (mix(v + np.uint64(1)) * _BAND_STEP).sum(2, dtype=np.uint64)
    return mix(h + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _without(n: int) -> np.ndarray:
    """A row for each choice of at most a quarter of ``n`` places, 1 at what is chosen."""
    some = [c for k in range(n // 4 + 1) for c in combinations(range(n), k)]
    out = np.zeros((len(some), n), np.uint64)
    for i, c in enumerate(some):
        out[i, list(c)] = 1
    return out


_WITHOUT = {n: _without(n) for n in range(1, FEW + 1)}


def exact_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of a small set: two sets of up to ``FEW`` shingles that are linked have that of their common part."""
    h = mix(shingles ^ np.uint64(0x2545F4914F6CDD1D))
    return mix(h.sum(dtype=np.uint64) - (_WITHOUT[len(h)] * h).sum(1, dtype=np.uint64) + np.uint64(7)).view(np.int64)


def _describe(batch: pa.RecordBatch, text: str) -> dict:
    s, bounds = sets(*Words(batch.column(text)).shingles(SHINGLE))
    sizes = np.diff(bounds)
    some = sizes > 0
    bands = band_keys(signatures(s, bounds))
    digest = np.zeros((len(sizes), 2), np.uint64)
    if some.any():
        at = bounds[:-1][some]
        digest[some, 0] = np.add.reduceat(mix(s + np.uint64(1)), at)
        digest[some, 1] = np.add.reduceat(mix(s ^ np.uint64(0x5851F42D4C957F2D)), at)
    few = {i: exact_keys(s[bounds[i] : bounds[i + 1]]) for i in np.flatnonzero(some & (sizes <= FEW)).tolist()}
    lens = some * BANDS
    if few:
        place = np.cumsum(some) - 1
        bands = np.concatenate([x for i in np.flatnonzero(some).tolist() for x in ([bands[place[i]], few[i]] if i in few else [bands[place[i]]])])
        lens[list(few)] += [len(x) for x in few.values()]
    ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    return {
        "n_shingles": pa.array(sizes, pa.int64()),
        "set": pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(sizes), [None, pa.py_buffer(digest.tobytes())]).cast(pa.binary()),
        "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.reshape(-1), pa.int64())),
    }


_DESCRIBED = [T.StructField("n_shingles", T.LongType()), T.StructField("set", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]


def links_of(ids: np.ndarray, blocks: np.ndarray, joined: np.ndarray, parts: list[np.ndarray], percent: int, across: bool) -> list[tuple[int, int]]:
    """Links that span the groups among some sets, which are ``joined`` to components; with ``across``, of sets in different blocks alone."""
    n = len(parts)
    if n < 2:
        return []
    sizes = np.fromiter(map(len, parts), np.int64, n)
    _, shingle = np.unique(np.concatenate(parts), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    by = np.argsort(shingle, kind="stable")
    posted = owner[by]  # the sets of each shingle, in order
    first = np.searchsorted(shingle[by], np.arange(shingle.max() + 2))
    ends = np.cumsum(sizes)
    group, out = np.unique(joined, return_inverse=True)[1], []
    for i in range(n):
        own = shingle[ends[i] - sizes[i] : ends[i]]
        lens = first[own + 1] - first[own]
        at = np.repeat(first[own] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        shared = np.bincount(posted[at], minlength=n)
        linked = 100 * shared >= percent * (sizes + sizes[i] - shared)
        linked[: i + 1] = False
        if across:
            linked &= blocks != blocks[i]
        for j in np.flatnonzero(linked & (group != group[i])):
            if group[j] != group[i]:
                out.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return out


_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])


def confirmed(pieces: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between the sets of each task (by, unit, lo, hi); the rows of a task are sorted to stand together."""
    ship_package(pieces.sparkSession)
    task = ["by", "unit", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            if rows:
                ids, blocks, joined = (np.array([r[k] for r in rows], np.int64) for k in range(3))
                found = links_of(ids, blocks, joined, [np.frombuffer(r[3], np.uint64) for r in rows], percent, key[2] != key[3])
                if found:
                    yield _batch(found)

        for batch in batches:
            for *this, rep, block, joined, s in ([x.as_py() for x in row] for row in zip(*batch.columns, strict=True)):
                if this != key:
                    yield from finish()
                    key, rows = this, []
                rows.append((rep, block, joined, s))
        yield from finish()

    return pieces.select(*task, "rep", "block", "component", "shingles").repartition(*task).sortWithinPartitions(*task).mapInArrow(run, _LINKS)


def star_links(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs of ``stars`` that are linked: ``a`` meets its partners in blocks, and a task holds two sets at a time."""
    ship_package(sets.sparkSession)
    hubs = stars.groupBy("a").agg(F.ceil(F.count("*") / STAR_DOCS).cast("int").alias("blocks"))
    member = stars.join(hubs, "a").select("a", F.col("b").alias("rep"), F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    points = sets.join(member, "rep").select("a", "block", F.lit(1).alias("kind"), F.col("rep"), "shingles")
    middles = sets.join(hubs.withColumnRenamed("a", "rep"), "rep")
    middles = middles.select(F.col("rep").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), F.col("rep"), "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, middle = None, []
        for batch in batches:
            found = []
            for a, block, kind, rep, s in ([x.as_py() for x in row] for row in zip(*batch.columns, strict=True)):
                own = np.frombuffer(s, np.uint64)
                if (a, block) != at:
                    at, middle = (a, block), []
                if kind == 0:
                    middle.append(own)  # one, but for ids whose rows differ
                    continue
                for other in middle:
                    where = np.minimum(np.searchsorted(other, own), len(other) - 1)
                    shared = int((other[where] == own).sum())
                    if 100 * shared >= percent * (len(own) + len(other) - shared):
                        found.append((a, rep))
                        break
            if found:
                yield _batch(found)

    order = ["a", "block", "kind"]
    return points.union(middles).repartition("a", "block").sortWithinPartitions(*order).mapInArrow(run, _LINKS)


def _members(rest: DataFrame, classes: DataFrame) -> DataFrame:
    """(by, unit, rep, component, blocks): the classes that are compared with one another, by unit or, for large units, by key."""
    least = rest.groupBy("key").agg(F.min("rep").alias("least"))
    ties = rest.join(least, "key").where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    units = connected_components(ties).select(F.col("node").alias("rep"), F.col("component").alias("unit"))
    held = written(rest.join(units, "rep"), "held")
    by_unit = held.groupBy("unit").agg(F.count_distinct("rep").alias("n"))
    by_key = held.groupBy("unit", "key").agg(F.count("*").alias("m")).groupBy("unit").agg(F.sum(F.col("m") * F.col("m")).alias("squares"))
    cut = by_unit.join(by_key, "unit").where((F.col("n") > BLOCK_DOCS) & (F.col("squares") < F.col("n") * F.col("n"))).select("unit", F.lit(1).alias("by"))
    # units may be few and large: the small tables of their sizes are broadcast, so that no task gets a unit's rows
    chosen = held.join(join_side(cut, "cut"), "unit", "left").select(F.coalesce("by", F.lit(0)).alias("by"), F.when(F.col("by") == 1, F.col("key")).otherwise(F.col("unit")).alias("unit"), "rep", "component").distinct()
    sized = chosen.join(classes.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles")), "rep")
    sizes = sized.groupBy("by", "unit").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    return chosen.join(join_side(sizes, "sizes"), ["by", "unit"]).select("by", "unit", "rep", "component", "blocks")


def _same_ids(some: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) links of classes that hold different rows of one id."""
    several = some.groupBy("doc").agg(F.min("set").alias("x"), F.max("set").alias("y")).where("x <> y").select("doc")
    held = some.join(several, "doc").select("doc", "set").distinct().join(classes.select("set", "rep"), "set").select("doc", "rep")
    least = held.groupBy("doc").agg(F.min("rep").alias("a"))
    return held.join(least, "doc").select("a", F.col("rep").alias("b")).where("a <> b")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc, n_shingles, component, n_copies) for each row; ``component`` is the smallest id of the group."""
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise ValueError(f"{doc_id} must be of an integer type")
    ids = docs.select(col(doc_id).cast("long").alias("doc"), col(text).alias("text"))
    described = written(map_rows(ids, "text", ["doc"], lambda: lambda batch: _describe(batch, "text"), _DESCRIBED), "signatures")
    some = described.where("n_shingles > 0 and doc is not null")
    classes = written(some.groupBy("set").agg(F.min("doc").alias("rep"), F.count_distinct("doc").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "classes")
    keys = classes.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("key", "least")
    tied = written(keys.join(shared, "key").select("key", "rep", "least"), "tied")
    side = join_side(tied.select(F.col("rep").alias("chosen")).distinct(), "chosen")
    full = map_rows(ids.join(side, ids["doc"] == F.col("chosen")).select("doc", "text"), "text", ["doc"], lambda: _full_sets, [T.StructField("shingles", T.BinaryType())])
    sets_ = written(full.where(F.length("shingles") > 0).withColumnRenamed("doc", "rep"), "sets")
    stars = written(tied.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    links = written(star_links(stars, sets_, percent).union(_same_ids(some, classes)), "links")
    joined = connected_components(links)
    # what the smallest of a key was not: of several components still
    others = tied.where("rep <> least").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    open_ = others.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rest = written(others.join(open_, "key"), "open")
    if not rest.isEmpty():
        side = join_side(_members(rest, classes), "members")
        block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        dealt = sets_.join(side, "rep").select("by", "unit", "rep", "component", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "shingles")
        pieces = dealt.select("by", "unit", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "rep", "block", "component", "shingles")
        joined = connected_components(links.union(confirmed(pieces, percent)))
    drop_written(tied, sets_, stars, links, rest)  # the components are written
    named = classes.join(joined, classes["rep"] == joined["node"], "left").select(F.col("set").alias("own"), F.coalesce("component", "rep").alias("component"), "copies")
    out = described.join(named, (F.col("set") == F.col("own")) & (F.col("n_shingles") > 0) & F.col("doc").isNotNull(), "left")
    return out.select("doc", "n_shingles", F.coalesce("component", "doc").alias("component"), F.coalesce("copies", F.lit(1)).alias("n_copies"))


def _full_sets(batch: pa.RecordBatch) -> dict:
    s, bounds = sets(*Words(batch.column("text")).shingles(SHINGLE))
    return {"shingles": [s[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]}


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those whose group has a smaller id; of rows with one id, one."""
    found = written(groups(docs, doc_id, text, percent), "groups")
    own = f"c{docs.columns.index(doc_id)}"
    rows = plain(docs)
    side = join_side(found.where("doc <> component").select("doc").distinct(), "copies")
    out = rows.join(side, F.col(own) == F.col("doc"), "left_anti")
    twice = found.where("doc is not null").groupBy("doc").count().where("count > 1").select("doc")
    if not twice.isEmpty():
        side = join_side(twice, "repeated-ids")
        again = F.col(own) == F.col("doc")
        out = out.join(side, again, "left_anti").unionByName(out.join(side, again, "left_semi").dropDuplicates([own]))
    return out.toDF(*docs.columns)
