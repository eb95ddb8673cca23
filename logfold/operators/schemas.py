"""Schema reports over the channel dimension. Parsing runs on distinct schemas only, on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import LogfoldError
from ..plans import schema as S


def _distinct(channels: DataFrame) -> list:
    """The distinct schemas: at most as many as channels, 65 536 a file."""
    kind = "schema_encoding" if "schema_encoding" in channels.columns else F.lit(None).cast("string").alias("schema_encoding")
    return channels.select("message_type", "schema", kind).distinct().orderBy("message_type").collect()


def fields(channels: DataFrame) -> DataFrame:
    """``message_type, pos, path, type`` of every readable schema, nested fields in place."""
    rows = []
    for r in _distinct(channels):
        try:
            rows += [(r.message_type, i, p, t) for i, (p, t) in enumerate(S.parse(r.message_type, r.schema or "", r.schema_encoding).paths())]
        except LogfoldError:
            continue
    return channels.sparkSession.createDataFrame(rows, "message_type string, pos long, path string, type string")


def validate(channels: DataFrame) -> DataFrame:
    """``message_type, status, detail``: ok, warning (no schema text) or error (cannot be parsed or a type is missing)."""
    rows = []
    for r in _distinct(channels):
        if not r.schema:
            rows.append((r.message_type, "warning", "no schema"))
            continue
        try:
            S.parse(r.message_type, r.schema, r.schema_encoding).paths()
            rows.append((r.message_type, "ok", ""))
        except LogfoldError as e:
            rows.append((r.message_type, "error", str(e)))
    return channels.sparkSession.createDataFrame(rows, "message_type string, status string, detail string")


def listing(channels: DataFrame, standard_only: bool = False) -> DataFrame:
    """``message_type, encoding, schema_encoding, n_topics, n_lines`` by type."""
    from .filters import is_standard

    some = channels.where(is_standard()) if standard_only else channels
    return some.groupBy("message_type").agg(F.min("encoding").alias("encoding"), F.countDistinct("topic").alias("n_topics"), F.max(F.size(F.split(F.coalesce("schema", F.lit("")), "\n"))).cast("long").alias("n_lines"))


def show(channels: DataFrame, pattern: str, lines: int = 50) -> DataFrame:
    """The first lines of the schemas whose topic or type contains a text."""
    from .filters import contains

    split = F.split("schema", "\n")
    return channels.where(contains(pattern, "topic", "message_type", case=True)).select("topic", "message_type", F.array_join(F.slice(split, 1, lines), "\n").alias("head"), F.size(split).cast("long").alias("n_lines"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``message_type, status`` (added, removed, modified, same) between the schemas of two recordings."""
    side = lambda c, n: c.groupBy("message_type").agg(F.min(F.coalesce("schema", F.lit(""))).alias(n))
    both = side(old, "a").join(side(new, "b"), "message_type", "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified").otherwise("same")
    return both.select("message_type", status.alias("status"))


def line_diff(old: DataFrame, new: DataFrame, message_type: str) -> DataFrame:
    """Lines of one schema that differ by position; a missing side is null."""
    side = lambda c, n: c.where(F.col("message_type") == message_type).limit(1).select(F.posexplode(F.split("schema", "\n")).alias("line", n))
    return side(old, "old").join(side(new, "new"), "line", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
