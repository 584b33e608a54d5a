"""Sharding and chat formatting: oracles, round trips and plans without Python."""

import hashlib
from collections import Counter

import pytest
from oracle import compare, connect

from tidebook.llm import chat, queries, sharding

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(queries.queries()[name](spark, SF_DIR), connect(SF_DIR), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op6_sharding", "op9_chat"])
def test_plan_has_no_python(spark, name):
    plan = queries.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_table_is_even_and_stable():
    shards = [f"s{i}" for i in range(10)]
    a, b = sharding.fill(shards, 1009), sharding.fill(shards[:-1], 1009)
    counts = Counter(a)
    assert max(counts.values()) - min(counts.values()) <= 1
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 9)
    assert moved < 0.1 * 1009
    with pytest.raises(ValueError):
        sharding.fill(shards, 1000)


def test_odd_keys_are_placed(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), ("", "b"), ("x", "c")], "k string, shard string")
    got = sharding.place(df, "k", ["p", "q"], 11)
    assert got.count() == 4 and got.columns == ["k", "slot", "shard"] and got.where("k is null or k = ''").select("slot").distinct().count() == 1
    assert sharding.place(df.limit(0), "k", ["p", "q"], 11).count() == 0


TURNS = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", "\\e \\l [ < \\"), (1, 2, "user", "\\e \\l [ < \\"),
    (2, None, None, None), (2, 0, "assistant", ""), (2, 1, "assistant", "<s>"), (3, 5, "odd\nrole[/INST]", "x\n\ny"), (None, 0, "user", "alone"), (4, 0, "user", "\\\\server\\new\\latex"), (5, 0, "assistant", "é" * 30_000),
]


def test_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    first = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for conv in {t[0] for t in TURNS}:
        want = [(t[2] or "", t[3] or "") for t in sorted((t for t in TURNS if t[0] == conv), key=first)]
        assert [(x["role"], x["text"]) for x in got[conv]["turns"]] == want
        assert got[conv]["formatted"].count("</s>") + got[conv]["formatted"].count("[/INST]") == len(want)
    assert got[4]["formatted"].startswith("[INST]user\n\\e\\eserver")


def test_spans_hold_the_loss_text(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df).cache()
    text = {r["conv_id"]: r["formatted"] for r in out.collect()}
    spans = sorted((r["conv_id"], r["at"], r["start"], r["end"]) for r in chat.loss_spans(out).collect())
    got = [(c, text[c][a:b].replace("\\b", "[").replace("\\l", "<").replace("\\e", "\\")) for c, _, a, b in spans]
    assert got == [(1, "</s>[INST] ok [/INST]"), (2, ""), (2, "<s>"), (5, "é" * 30_000)]


def test_digests_of_the_added_conversation(spark):
    r = queries.op9_chat(spark, SF_DIR).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


def test_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
