"""Chat formatting with Spark expressions only.

A formatted conversation is a run of blocks

    <turn role="ROLE">TEXT<next/>TEXT</turn>\\n

one per run of adjacent turns of one role; ``<next/>`` stands between the
texts that were merged.  Inside texts and roles ``&`` is written ``&amp;`` and
``<`` is written ``&lt;``, so that every ``<`` of the output belongs to the
template and the way back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256  # turns whose positions are added up at a time
OPEN, AFTER_ROLE, NEXT, CLOSE = '<turn role="', '">', "<next/>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit('"'), F.lit("&quot;"))


def _unrole(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&quot;"), F.lit('"')))


def _loss_spans(p: Column) -> Column:
    """Start and end of the bodies under the loss mask.

    Sums run over blocks of ``BLOCK`` pieces, so that the work stays linear in
    the number of turns.
    """
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    length = lambda x: F.length(x["head"]) + F.length(x["body"]) + F.length(x["tail"])
    blocks = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int"))
    part = lambda b: F.slice(p, b * BLOCK + 1, BLOCK)
    totals = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0), lambda s, x: s + length(x)))
    begins = F.aggregate(totals, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["head"])
        span = F.array(F.struct(start.alias("start"), (start + F.length(x["body"])).alias("end")))
        return F.struct((acc["at"] + length(x)).alias("at"), F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    within = lambda b, at: F.aggregate(part(b), F.struct(at.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    placed = F.zip_with(blocks, begins, lambda b, at: F.struct(b.alias("b"), at.alias("at")))
    return F.flatten(F.transform(placed, lambda z: F.when(z["b"].isNotNull(), within(z["b"], z["at"])).otherwise(none)))


def format_conversations(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """``conv_id, formatted, loss_spans`` of every conversation.

    Turns come in the order of their number, those with equal numbers by role
    and text; null numbers come first.  ``loss_spans``: start and end (code
    points, end exclusive) of each text of ``loss_role`` in ``formatted``; the
    template's own strings are under no span.  Null texts and roles count as
    empty; an empty text keeps its empty span.  Repeated rows stay repeated
    turns, a null ``conv_id`` is a conversation like any other, other columns
    are ignored, and an empty table gives an empty result.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")

    # ANSI arrays refuse positions outside; the first and last turns look at no neighbour.
    neighbours = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            F.col("turns")[i]["role"].alias("role"),
            F.col("turns")[i]["text"].alias("text"),
            F.when(i > 0, F.col("turns")[F.greatest(i - 1, F.lit(0))]["role"]).alias("before"),
            F.when(i < n - 1, F.col("turns")[F.least(i + 1, n - 1)]["role"]).alias("after"),
        ),
    )
    pieces = F.transform(
        neighbours,
        lambda x: F.struct(
            F.when(x["before"] == x["role"], F.lit(NEXT)).otherwise(F.concat(F.lit(OPEN), _role(x["role"]), F.lit(AFTER_ROLE))).alias("head"),
            escape(x["text"]).alias("body"),
            F.when(x["after"] == x["role"], F.lit("")).otherwise(F.lit(CLOSE)).alias("tail"),
            (x["role"] == loss_role).alias("loss"),
        ),
    )
    laid = sorted_turns.select("conv_id", pieces.alias("p"))
    spans = _loss_spans(F.col("p"))
    whole = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], x["tail"])), "")
    return laid.select("conv_id", whole.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns, an array of (role, text), that a formatted conversation holds."""
    blocks = F.filter(F.split(formatted, OPEN, -1), lambda b: b != "")
    parsed = F.transform(
        blocks,
        lambda b: F.struct(
            F.substring_index(b, AFTER_ROLE, 1).alias("role"),
            F.substr(b, F.length(F.substring_index(b, AFTER_ROLE, 1)) + 1 + len(AFTER_ROLE), F.length(b)).alias("rest"),
        ),
    )
    texts = F.transform(
        parsed,
        lambda b: F.transform(
            F.split(F.substring_index(b["rest"], CLOSE, 1), NEXT, -1),
            lambda x: F.struct(_unrole(b["role"]).alias("role"), unescape(x).alias("text")),
        ),
    )
    return F.flatten(texts)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
