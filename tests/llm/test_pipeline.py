"""The pipeline's stages on odd rows, and its last result against the library's ids of what the stages keep."""

import collections

import corpus_pipeline
import pytest
from test_documents import WORD, brute_groups, brute_leaks, brute_quality

from tidebook.llm import queries
from tidebook.session import written
from tidebook.sources.tables import table

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_stages_keep_the_columns(spark, request, rows):
    docs = request.getfixturevalue(rows)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF_DIR), name)
        assert docs.columns == names
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).columns == ["doc_id", "n_tokens", "ids"]


def test_line_dedup_keeps_short_rests_with_words_of_their_own(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    line = words("shared", 20)
    texts = [f"{words('own', 45)}\n{line}", f"{line}\none word", line, f"{line}\n{words('keeper', 60)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup_stage(spark, docs, SF_DIR).collect()}
    assert got == {0: words("own", 45), 1: "one word", 3: texts[3]}


def brute_run(docs, items):
    """The pipeline by plain loops: {id: token ids}."""
    from tokenizers import Tokenizer

    verdict, rest = brute_quality([(d, t, h) for d, t, h in docs])
    kept = [(d, rest[d]) for d, _, _ in docs if verdict[d][1]]
    holders = collections.defaultdict(set)
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").encode().lower().decode() for x in t.split("\n")]
    for d, t in kept:
        for x in keys(t):
            if len(x) >= 20:
                holders[x].add(d)
    cut = []
    for d, t in kept:
        own = [line for line, x in zip(t.split("\n"), keys(t), strict=True) if len(holders.get(x, ())) < 3 or d == max(holders[x])]
        if len(own) == len(keys(t)) or WORD.search("\n".join(own)):
            cut.append((d, "\n".join(own)))
    groups = {d: c for d, _, c in brute_groups(cut)}
    one = [(d, t) for d, t in cut if groups[d] == d]
    leaked = {d for d, *_ in brute_leaks(one, items)}
    t = Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    counts = [len(docs), len(kept), len(cut), len(one), len(one) - len(leaked)]
    return {d: t.encode(x, add_special_tokens=False).ids for d, x in one if d not in leaked}, counts


def test_run_equals_brute_force(spark, tmp_path):
    """Whole small tables with cases added for every stage: the rows and ids of run(), and how many each stage drops."""
    sf = table(spark, SF_DIR, "documents")
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    item = words("question", 40)
    notice = words("notice", 30)
    more = [(9000 + i, f"{notice}\n{words(f'own{i}x', 60)}", "en", "site", 0) for i in range(8)]  # boilerplate of a host
    more += [(9100 + i, f"{notice}\nlittle {i}", "en", "site", 0) for i in range(4)]  # depleted, or too short
    more += [(9200 + i, f"{words('passage', 25)}\n{words(f'rest{i}x', 55)}", "en", f"h{i}", 0) for i in range(4)]  # a passage of several hosts
    more += [(9300 + i, words("near", 80) + f" end{i}", "en", f"h{i}", 0) for i in range(3)]  # near copies
    more += [(9400, f"{words('before', 30)} {item} {words('after', 30)}", "en", "h", 0)]  # a benchmark item
    docs = sf.unionByName(spark.createDataFrame(more, sf.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench = table(spark, SF_DIR, "benchmark")
    bench.unionByName(spark.createDataFrame([(9, item)], bench.schema)).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    want, counts = brute_run(rows, [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()])
    got = {r["doc_id"]: list(memoryview(bytes(r["ids"])).cast("I")) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert counts[0] > counts[1] >= counts[2] > counts[3] > counts[4]
    assert 9400 not in got and 9300 in got and 9301 not in got and all(9000 + i in got for i in range(8)) and 9100 not in got
