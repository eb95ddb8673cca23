"""Search in payloads: byte patterns, strings and decoded values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_hex(pattern: str) -> bytes:
    """Hex tokens, with or without spaces and 0x. An empty pattern is an error."""
    found = bytes.fromhex("".join(t.removeprefix("0x") for t in pattern.split()))
    if not found:
        raise ValueError("the pattern is empty")
    return found


def occurrences(text: Column, pattern: str) -> Column:
    """Code point offsets of the non-overlapping occurrences of a string, as an array."""
    if not pattern:
        raise ValueError("the pattern is empty")
    pieces = F.split(text, "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("found"))

    def step(a: Column, piece: Column) -> Column:
        here = a["at"] + F.length(piece)
        return F.struct((here + len(pattern)).alias("at"), F.concat(a["found"], F.array(here)).alias("found"))

    # What stands behind the last occurrence is a piece too, and no place.
    return F.aggregate(pieces, zero, step, lambda a: F.slice(a["found"], F.lit(1), F.size(a["found"]) - 1))


def find_string(rows: DataFrame, column: str, pattern: str, context: int = 32, limit: int | None = None) -> DataFrame:
    """A row per occurrence, in order of offset within its row, with the text around it. ``limit``: per result."""
    at = rows.withColumn("__at", occurrences(F.col(column), pattern)).select("*", F.explode("__at").alias("offset")).drop("__at")
    start = F.greatest(F.col("offset") - context, F.lit(0))
    out = at.withColumn("context", F.substring(F.col(column), (start + 1).cast("int"), (F.col("offset") - start + len(pattern) + context).cast("int")))
    return out.limit(limit) if limit is not None else out


def find_bytes(rows: DataFrame, column: str, pattern: str, context: int = 16, limit: int | None = None) -> DataFrame:
    """As ``find_string`` for a hex pattern in a binary column; the context is hex. Every byte stands for one character."""
    wanted = parse_hex(pattern).decode("latin-1")
    view = rows.withColumn("__text", F.decode(F.col(column), "ISO-8859-1"))
    found = find_string(view, "__text", wanted, context, limit)
    return found.withColumn("context", F.hex(F.encode("context", "ISO-8859-1"))).drop("__text")


def find_value(rows: DataFrame, payload: str, path: str, kind: str, value, limit: int | None = None) -> DataFrame:
    """Rows whose JSON payload has a value at a path (``$.a.b``); values of another type do not match."""
    at = F.try_variant_get(F.try_parse_json(F.col(payload).cast("string")), path, kind)
    out = rows.withColumn("value", at).where(F.col("value") == F.lit(value))
    return out.limit(limit) if limit is not None else out
