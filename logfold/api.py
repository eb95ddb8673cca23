"""Recordings by path: a reader, a writer and a rewriter over the DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codecs import cdr, jsons, proto
from .errors import TypeNotFoundError, UnknownCodecError
from .functions.text import detect_encoding
from .operators import rewrite as W
from .operators.rename import Rules
from .plans import schema as S
from .sources import datasource


class Reader:
    """Containers below a path. Everything is lazy; the summaries answer what they can."""

    def __init__(self, spark: SparkSession, path: str, **options):
        self.spark, self.path, self.options = datasource.register(spark), path, options

    @property
    def messages(self) -> DataFrame:
        return self.spark.read.format("logfold").options(**self.options).load(self.path)

    @property
    def channels(self) -> DataFrame:
        return self.spark.read.format("logfold_channels").load(self.path)

    @property
    def files(self) -> DataFrame:
        return self.spark.read.format("logfold_files").load(self.path)

    @property
    def attachments(self) -> DataFrame:
        return self.spark.read.format("logfold_attachments").load(self.path)

    def message_count(self) -> int:
        return self.files.agg(F.coalesce(F.sum("message_count"), F.lit(0))).first()[0]

    def decode(self, topic: str, framing: str = "cdr", on_error: str = "fail") -> DataFrame:
        """The messages of one topic with their payload as a typed struct (CDR, protobuf) or a variant (JSON)."""
        found = self.channels.where(F.col("topic") == topic).select("message_type", "schema", "schema_encoding", "schema_data", detect_encoding(F.col("encoding"), F.col("schema_encoding")).alias("codec")).distinct().collect()
        if not found:
            raise TypeNotFoundError(f"no topic {topic!r}")
        if len(found) > 1:
            raise TypeNotFoundError(f"{topic!r} has {len(found)} schemas; decode each file on its own")
        rows, of = self.messages.where(F.col("topic") == topic), found[0]
        if of.codec == "json":
            return rows.withColumn("message", jsons.decode(F.col("data"), strict=on_error == "fail"))
        if of.codec == "cdr":
            return cdr.decode(rows, "data", S.parse(of.message_type, of.schema or "", of.schema_encoding), framing, on_error)
        if of.codec == "protobuf":
            return proto.decode(rows, "data", bytes(of.schema_data or b""), of.message_type)
        raise UnknownCodecError(f"no codec for {of.codec!r} payloads")


class Writer:
    """Collects DataFrames of messages with their channel columns; ``finish`` writes them as containers."""

    def __init__(self, spark: SparkSession, path: str, format: str = "mcap", **options):
        self.spark, self.path, self.format, self.options = datasource.register(spark), path, format, options
        self.parts: list[DataFrame] = []

    def write(self, messages: DataFrame, topic: str | None = None, message_type: str = "", encoding: str = "cdr", schema: str | None = None) -> Writer:
        """Messages as they are, or those of one channel."""
        if topic is not None:
            messages = messages.withColumns({"topic": F.lit(topic), "message_type": F.lit(message_type), "encoding": F.lit(encoding), "schema": F.lit(schema).cast("string")})
        self.parts.append(messages)
        return self

    def finish(self) -> None:
        if not self.parts:
            return
        whole = self.parts[0]
        for part in self.parts[1:]:
            whole = whole.unionByName(part, allowMissingColumns=True)
        for name, kind in (("channel_id", "int"), ("sequence", "long")):
            if name not in whole.columns:
                whole = whole.withColumn(name, F.lit(None).cast(kind))
        W.write(whole, self.path, self.format, **self.options)


class Rewriter:
    """Rewrites containers under rename rules; see ``operators.rewrite.rewrite`` for the options."""

    def __init__(self, spark: SparkSession, path: str, rules: Rules | None = None, **options):
        self.spark, self.path, self.rules, self.options = datasource.register(spark), path, rules, options

    def rewrite(self, target: str, format: str | None = None) -> dict[str, int]:
        return W.rewrite(self.spark, self.path, target, self.rules, format, **self.options)
