"""One query for each operator, over its whole table, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import bpe, chat, decontam, langid, line_dedup, lm, minmax, quality, secrets, sharding
from tidebook.sources.tables import table

#: Production parameters of op6: 16 shards and a prime of about 100 slots a shard.
SHARDS = [f"shard-{i:03d}" for i in range(16)]
SLOTS = 1601


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, vocabulary(), keep=["doc_id"], ids=False, digests=True)


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score_held_out(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.dedup(docs, keep=["doc_id"], min_chars=20, min_docs=3, texts=False, digests=True)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.verdicts(docs, keep=["doc_id"])


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", SHARDS, SLOTS)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = lm.held_out("doc_id", 4, 2)
    return langid.identify(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minmax.groups(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.col("doc").eqNullSafe(F.col("component")).alias("kept"),
        "n_copies",
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = "select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') t(conv_id, turn, role, text)"
    out = chat.format_conversations(rows.unionByName(spark.sql(added)))
    loss = chat.loss_text(F.col("turns"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_OP4_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
repeats as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (
  select k.*, r.keeper is not null and r.keeper <> k.doc_id as gone from keyed k left join repeats r using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(case when not gone then line end, chr(10) order by pos), '')) as kept_sha256
from marked group by doc_id"""


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: x["kind"] != "format")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.size(F.filter("found", lambda x: x["likely"])).cast("long").alias("n_likely"))


def _op6_sql() -> str:
    """The table is filled by a recursive query: one turn a step."""
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(SHARDS))
    n, m = len(SHARDS), SLOTS
    return f"""
with recursive shards(k, shard) as (values {names}),
prefs as (select k, shard,
    ('0x' || substr(md5('offset:' || shard), 1, 15))::bigint % {m} as first_slot,
    ('0x' || substr(md5('step:' || shard), 1, 15))::bigint % {m - 1} + 1 as step from shards),
orders as (select k, list((first_slot + j * step) % {m} order by j) as slots from prefs, range({m}) r(j) group by k),
turns(turn, slot, used) as (
  select -1, -1::bigint, list_transform(range({m}), lambda x: false)
  union all
  select turn + 1, s, used[:s] || [true] || used[s + 2:]
  from (select turn, used, list_filter(slots, lambda x: not used[x + 1])[1] as s from turns join orders on k = (turn + 1) % {n} where turn + 1 < {m}) t),
owners as (select slot, shard from turns join shards on k = turn % {n} where turn >= 0)
select doc_id, slot::integer as slot, shard from (
  select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % {m} as slot from documents) d join owners using (slot)"""


_OP9_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (
  select *, contains(text, '[/INST]') or contains(text, '</s>') or regexp_matches(text, '\\[elb]')
    or (role <> 'assistant' and (contains(role, '[/INST]') or contains(role, '</s>') or contains(role, chr(10)) or regexp_matches(role, '\\[elbn]'))) as hard from turns),
sized as (
  select *, length(text) + case when hard then length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', '')) else 0 end
    + case when role = 'assistant' then 7
      else 14 + length(role) + case when hard then length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '[', ''), chr(10), '')) else 0 end end as chars
  from marked)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from sized group by conv_id"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

_OP5_SQL = rf"""
with d as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_WORD}) as ws from documents),
win as (select doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) as w, unnest(range(1, len(ws) - 1)) as i from d where len(ws) > 2),
twice as (select doc_id, i, count(*) over (partition by doc_id, w) as n from win),
again as (select doc_id, count(distinct pos) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as pos from twice where n > 1) t group by doc_id),
lines as (select doc_id, source, text, unnest(string_split(text, chr(10))) as line from d),
dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from lines where regexp_matches(line, {_WORD}) group by doc_id),
keys as (select distinct doc_id, source, text, regexp_extract_all({_LOWER.replace("coalesce(text, '')", "line")}, {_WORD}) as key, count(*) over (partition by doc_id, regexp_extract_all({_LOWER.replace("coalesce(text, '')", "line")}, {_WORD})) as times from lines),
hosts as (select source, count(distinct text) as host_docs from d group by source),
boiler as (select k.source, key from keys k join hosts h on h.source is not distinct from k.source where len(key) > 0
  group by k.source, key, host_docs having count(distinct text) > {quality.LIMIT_DOCS}
  and count(distinct text) > case when len(key) < {quality.SHORT_WORDS} then {quality.SHORT_SHARE} else {quality.LIMIT_SHARE} end * host_docs),
gone as (select doc_id, sum(len(k.key) * times)::bigint as n_removed_words from keys k join boiler b on b.key = k.key and b.source is not distinct from k.source group by doc_id),
base as (select doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::bigint as word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_removed_words, 0) as n_removed_words
  from d left join dup using (doc_id) left join again using (doc_id) left join gone using (doc_id)),
judged as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words as base_failed from base)
select *, not base_failed and n_words - n_removed_words >= {quality.MIN_REST} * n_words as kept from judged"""

_OP8_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, {_WORD}) as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w),
u as (select doc_id, len(sh) as n, unnest(sh) as x from s),
p as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as c from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by all),
e as (select a, b from p where 100 * c >= {minmax.PERCENT} * (na + nb - c)),
sy as (select a, b from e union all select b, a from e),
r(node, component) as (select doc_id, doc_id from s union select sy.b, r.component from r join sy on sy.a = r.node),
c as (select node, min(component) as component_id from r group by node),
k as (select doc_id, len(sh) as n_shingles, case when len(sh) > 0 then count(*) over (partition by list_sort(sh)) else 1 end as n_copies from s)
select doc_id, n_shingles, component_id, doc_id = component_id as kept, n_copies from k join c on c.node = k.doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_decontam": op2_decontam,
        "op3_lm": op3_lm,
        "op4_line_dedup": op4_line_dedup,
        "op5_quality": op5_quality,
        "op6_sharding": op6_sharding,
        "op7_langid": op7_langid,
        "op8_minmax": op8_minmax,
        "op9_chat": op9_chat,
        "op10_secrets": op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": _OP4_SQL, "op5_quality": _OP5_SQL, "op8_minmax": _OP8_SQL, "op6_sharding": _op6_sql(), "op9_chat": _OP9_SQL}
