"""Chat formatting of typed content parts. DataFrame operations only.

A turn's content is a list of parts: text, image, audio or document. The visitor flattens the parts in order: text is
written with its control strings escaped, any other part as a placeholder ``<|type:k|>`` with k counting the
conversation's attachments. The attachments are recorded in that order with what they refer to and the tokens that
the placeholder stands for. Turns are marked::

    <|im_start|>role
    content<|im_end|>

In texts and roles a backslash goes in front of each backslash and of the bar of each ``<|`` (and of a line end in a
role), so no control string of a text survives, and taking one backslash off before any character reads it back.

Beside the formatted string stand the spans of the loss mask, in code points: the content of each assistant turn.

Defined results: a null text or role is empty; turns come by turn, nulls first, and equal turns by role and text; rows
with a null conversation form one; a turn without parts is empty; parts of an unknown type count as documents. Other
columns are ignored. An empty table returns no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that a placeholder expands to where the part states none.
EXPANDED = {"image": 256, "audio": 128, "document": 512}


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def text_parts(text: Column) -> Column:
    """The parts of a plain text turn."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """``conv_id, formatted, loss, attachments, n_expanded`` for every conversation.

    ``parts_col``: an array of (type, text, ref, tokens); without it each row's text is one text part.
    loss: array of (start, end); attachments: array of (type, ref, tokens) in placeholder order.
    """
    parts = F.col(parts_col) if parts_col else text_parts(F.col(text_col))
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(parts, F.array()).alias("parts"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), turn.alias("t"))
    is_text = lambda p: p["type"].eqNullSafe("text")
    kind = lambda p: F.when(p["type"].isin(*EXPANDED), p["type"]).otherwise("document")
    default = lambda p: F.coalesce(p["tokens"], *(F.when(kind(p) == k, F.lit(n)) for k, n in EXPANDED.items())).cast("long")
    other = F.filter("t.parts", lambda p: ~is_text(p))
    rows = rows.withColumn("media", F.transform(other, lambda p: F.struct(kind(p).alias("type"), p["ref"].alias("ref"), default(p).alias("tokens"))))
    # One sort by conversation serves the numbers of the placeholders, the places of the spans and the collection.
    order = Window.partitionBy("conv_id").orderBy("t")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("conv_id", "t", "media", F.row_number().over(order).alias("n"), F.coalesce(F.sum(F.size("media")).over(earlier), F.lit(0)).alias("first"))

    def visit(p: Column, i: Column) -> Column:
        """A part's text, or its placeholder: the turn's first number and the placeholders before it in the turn."""
        k = F.col("first") + F.size(F.filter(F.slice("t.parts", F.lit(1), i), lambda q: ~is_text(q)))
        return F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind(p), F.lit(":"), k.cast("string"), F.lit("|>")))

    head = F.concat(F.lit(START), escape_role(F.col("t.role")), F.lit("\n"))
    rows = rows.select("conv_id", "n", "media", F.col("t.role").alias("role"), head.alias("head"), F.array_join(F.transform("t.parts", visit), "").alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(f"{END}\n")))
    before = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = (F.col("before") + F.length("head")).cast("int")
    span = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    rows = rows.withColumn("before", before).select("conv_id", F.struct("n", "piece", span.alias("span"), "media").alias("r"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    attachments = F.flatten(F.transform("r", lambda x: x["media"]))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("r", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("r", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_expanded"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds; text parts as they were, placeholders as written."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    header = r"(?s)^((?:[^\\\n]|\\.)*+)\n(.*)<\|im_end\|>\n$"
    pieces = F.filter(pieces, lambda p, i: i > 0)  # nothing stands in front of the first mark
    return F.transform(pieces, lambda p: F.struct(unescape(F.regexp_extract(p, header, 1)).alias("role"), unescape(F.regexp_extract(p, header, 2)).alias("text")))


def masked(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask."""
    return unescape(F.array_join(F.transform(loss, lambda s: F.substring(formatted, s["start"] + 1, s["end"] - s["start"])), ""))
