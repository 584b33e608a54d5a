"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation:

    conversation := turn*
    turn         := "[INST]" role "\\n" text "[/INST]"      for every role but the loss role
                  | "<s>" text "</s>"                       for the loss role

A deterministic parser cuts the formatted text after each closing string, drops the marks and undoes escapes. Each turn
is rendered as it is, parsed back and compared; where the recovered role or text differs, its content is escaped. The
conversation is then parsed as a whole, and escaped throughout if it still differs, which cannot fail: escaped content
has neither ``<`` nor ``[`` and every backslash in it starts a code.

Results: null text is empty, a null role too. Turns are in the order of turn, role and text, nulls first, so that rows
that tie, or repeat, have a defined order; repeated rows are turns of their own. Rows without a conversation id form one
conversation with a null id. An empty table gives no rows. A conversation is one value, so one task holds its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of the template and the escape codes of what could conflict with them.
OPEN, CLOSE = "[INST]", "[/INST]"
LOSS_OPEN, LOSS_CLOSE = "<s>", "</s>"
CODES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
ROLE_CODES = (*CODES, ("\n", "\\n"))
_AFTER_CLOSE = r"(?<=\[/INST\])|(?<=</s>)"


def _escape(c: Column, codes=CODES) -> Column:
    for raw, code in codes:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def _unescape(c: Column, codes=CODES) -> Column:
    for raw, code in reversed(codes):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def render_turn(role: Column, text: Column, loss_role: str, escaped: bool) -> Column:
    """One turn of the template, its content as it is or escaped."""
    r, t = (_escape(role, ROLE_CODES), _escape(text)) if escaped else (role, text)
    loss = F.concat(F.lit(LOSS_OPEN), t, F.lit(LOSS_CLOSE))
    return F.when(role == loss_role, loss).otherwise(F.concat(F.lit(OPEN), r, F.lit("\n"), t, F.lit(CLOSE)))


def parse(formatted: Column, loss_role: str) -> Column:
    """The turns of a formatted text as an array of (role, text); a piece outside the grammar has a null role."""

    def turn(piece: Column) -> Column:
        n = F.length(piece)
        inner = piece.substr(F.lit(len(OPEN) + 1), n - len(OPEN) - len(CLOSE))
        cut = F.instr(inner, "\n")
        is_loss = piece.startswith(LOSS_OPEN) & piece.endswith(LOSS_CLOSE)
        is_other = piece.startswith(OPEN) & piece.endswith(CLOSE) & (cut > 0)
        role = F.when(is_loss, F.lit(loss_role)).when(is_other, _unescape(inner.substr(F.lit(1), cut - 1), ROLE_CODES))
        loss_text = piece.substr(F.lit(len(LOSS_OPEN) + 1), n - len(LOSS_OPEN) - len(LOSS_CLOSE))
        text = F.when(is_loss, loss_text).when(is_other, inner.substr(cut + 1, n)).otherwise(piece)
        return F.struct(role.alias("role"), _unescape(text).alias("text"))

    pieces = F.filter(F.split(formatted, _AFTER_CLOSE, -1), lambda p: p != "")
    return F.transform(pieces, turn)


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: ``conv``, ``formatted``, and ``turns`` as parsed from ``formatted``.

    ``loss_spans`` and ``loss_text`` give what lies under the loss mask. Rows without a conversation are one conversation.
    """
    r, t = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), r.alias("role"), t.alias("text"))
    plain = render_turn(F.col("role"), F.col("text"), loss_role, False)
    back = parse(F.col("plain"), loss_role)
    same = (F.size("back") == 1) & F.coalesce(F.col("back")[0]["role"] == F.col("role"), F.lit(False)) & F.coalesce(F.col("back")[0]["text"] == F.col("text"), F.lit(False))
    full = render_turn(F.col("role"), F.col("text"), loss_role, True)
    turns = source.withColumn("plain", plain).withColumn("back", back).select("conv", "turn", "role", "text", F.when(same, F.col("plain")).otherwise(full).alias("piece"))
    grouped = turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "piece"))).alias("t"))
    joined = grouped.withColumn("f", F.array_join(F.transform("t", lambda x: x["piece"]), "")).withColumn("p", parse(F.col("f"), loss_role))
    wanted = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    strict = F.array_join(F.transform("t", lambda x: render_turn(x["role"], x["text"], loss_role, True)), "")
    settled = joined.withColumn("ok", F.col("p") == wanted)
    settled = settled.withColumn("formatted", F.when(F.col("ok"), F.col("f")).otherwise(strict))
    settled = settled.withColumn("turns", F.when(F.col("ok"), F.col("p")).otherwise(parse(F.col("formatted"), loss_role)))
    return settled.select(F.col("conv").alias(conv), "formatted", "turns")


def loss_spans(formatted: DataFrame, conv: str = "conv_id", loss_role: str = "assistant") -> DataFrame:
    """(conv, start, end) in code points of ``formatted``, end excluded, of the content of each loss turn, in order."""
    from pyspark.sql import Window

    pieces = F.filter(F.split("formatted", _AFTER_CLOSE, -1), lambda p: p != "")
    each = formatted.select(conv, F.posexplode(pieces).alias("at", "piece")).withColumn("n", F.length("piece"))
    ends = F.sum("n").over(Window.partitionBy(conv).orderBy("at"))
    each = each.withColumn("last", ends).where(F.col("piece").startswith(LOSS_OPEN))
    return each.select(conv, "at", (F.col("last") - F.col("n") + len(LOSS_OPEN)).alias("start"), (F.col("last") - len(LOSS_CLOSE)).alias("end"))


def loss_text(turns: Column, loss_role: str = "assistant") -> Column:
    """All content under the loss mask, unescaped, in order and with nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda x: x["role"] == loss_role), lambda x: x["text"]), "")
