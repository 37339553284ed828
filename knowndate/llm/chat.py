"""Chat formatting with a grammar round trip.

A conversation becomes one string of turns

    <s>role[INST] text [/INST]</s>

A deterministic parser reads the string back by splitting at ``<s>``; a turn is valid only if its text holds none of
the control strings. Conversations whose recovered turns differ from their source are rendered again with escapes
(``&`` ``<`` ``[`` become ``&amp;`` ``&lt;`` ``&lb;``) behind a leading ``<esc>`` mark, and are read back and compared
once more: after escaping no ``<`` or ``[`` of a text is left, so no control string can be.

Only DataFrame functions are used. The single shuffle groups the turns of a conversation, the unit of the output.

Defined cases: NULL role or text counts as empty; turns sort by (turn, role, text), NULL turns first, so ties and
repeated rows keep a fixed order; rows with a NULL id form one conversation; no rows give no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template and the escapes (in the order in which they are applied).
OPEN, BEGIN, END, CLOSE, ESCAPED = "<s>", "[INST] ", " [/INST]", "</s>", "<esc>"
CONTROL = "<s>|</s>|\\[INST\\]|\\[/INST\\]|<esc>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"))
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def render(turns: Column, escaped: bool) -> Column:
    shown = escape if escaped else lambda text: text
    body = F.array_join(
        F.transform(
            turns,
            lambda t: F.concat(F.lit(OPEN), shown(t["role"]), F.lit(BEGIN), shown(t["text"]), F.lit(END + CLOSE)),
        ),
        "",
    )
    return F.concat(F.lit(ESCAPED), body) if escaped else body


def after(whole: Column, head: Column, skip: int = 0) -> Column:
    return F.substr(whole, F.length(head) + F.lit(1 + skip))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation; a turn that breaks the grammar is NULL."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, BEGIN, 1)
        rest = after(piece, role, len(BEGIN))
        text = F.substring_index(rest, END, 1)
        valid = (after(rest, text) == END + CLOSE) & ~text.rlike(CONTROL) & ~role.rlike(CONTROL)
        return F.when(valid, F.struct(role.alias("role"), text.alias("text")))

    pieces = F.split(F.regexp_replace(formatted, f"^{ESCAPED}", ""), OPEN)
    read = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)
    plain = F.transform(
        read, lambda t: F.when(t.isNotNull(), F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    )
    return F.when(F.startswith(formatted, F.lit(ESCAPED)), plain).otherwise(read)


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and its ordered ``source`` turns (role, text)."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    return (
        rows.select("conv_id", F.struct("turn", text("role").alias("role"), text("text").alias("text")).alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("t"))
        .select(
            "conv_id",
            F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        )
    )


def format_chats(rows: DataFrame) -> DataFrame:
    """Per conversation: ``formatted``, ``escaped``, the ``turns`` read back from it and whether they equal the source."""
    first = conversations(rows).withColumn("plain", render(F.col("source"), False))
    tried = first.withColumn("escaped", ~F.coalesce(parse(F.col("plain")) == F.col("source"), F.lit(False)))
    chosen = tried.select(
        "conv_id", "source", "escaped",
        F.when(F.col("escaped"), render(F.col("source"), True)).otherwise(F.col("plain")).alias("formatted"),
    )
    return chosen.withColumn("turns", parse(F.col("formatted"))).select(
        "conv_id", "formatted", "escaped", "turns",
        F.coalesce(F.col("turns") == F.col("source"), F.lit(False)).alias("round_trip"),
    )


def loss_spans(formatted: Column) -> Column:
    """Loss mask as (start, end) code-point offsets into the formatted string, end exclusive."""
    pieces = F.split(formatted, OPEN)
    ends = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p) + len(OPEN)).alias("at"),
            F.when(
                F.startswith(p, F.lit(TRAINED_ROLE + BEGIN)),
                F.concat(
                    acc["spans"],
                    F.array(F.struct(
                        (acc["at"] + len(TRAINED_ROLE + BEGIN)).alias("start"),
                        (acc["at"] + F.length(p) - len(END + CLOSE)).alias("end"),
                    )),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return ends["spans"]


def loss_text(formatted: Column) -> Column:
    """All text under the loss mask, cut out of the formatted string by ``loss_spans``, unescaped and joined in order."""
    cut = F.array_join(
        F.transform(loss_spans(formatted), lambda s: F.substr(formatted, s["start"] + 1, s["end"] - s["start"])), ""
    )
    return F.when(F.startswith(formatted, F.lit(ESCAPED)), unescape(cut)).otherwise(cut)
