"""Reading, renaming and writing recordings: rewrite, convert, extract."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import cdr, proto
from ..errors import LogfoldError
from ..model import counted
from ..plans import schema as S
from .rename import Rules

#: Options of a writer by the format's name.
WRITERS = {"mcap": {"format": "mcap"}, "bag": {"format": "bag"}}


def read(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """Messages and channels of containers."""
    return spark.read.format("logfold").options(**options).load(path), spark.read.format("logfold_channels").load(path)


def write(messages: DataFrame, path: str, format: str = "mcap", single_file: bool = False, ordered: bool = True, **options) -> None:
    """Messages with their channel columns as containers, one a partition, in order of time within each.

    ``single_file`` puts all into one container, which one task then has to write.
    """
    if ordered:
        messages = messages.coalesce(1) if single_file else messages.repartitionByRange("log_time")
        messages = messages.sortWithinPartitions("log_time", "channel_id", "sequence")
    elif single_file:
        messages = messages.coalesce(1)
    messages.write.format("logfold").mode("overwrite").options(**WRITERS[format], **options).save(path)


def renamed(messages: DataFrame, channels: DataFrame, rules: Rules, validate: bool = True) -> DataFrame:
    """Messages with the channel columns that the rules give. Messages of unknown channels go."""
    if validate:
        rules.validate(channels)
    keys = [c for c in ("file", "channel_id") if c in messages.columns and c in channels.columns]
    kept = [c for c in ("topic", "message_type", "encoding", "schema", "schema_encoding", "schema_data", "callerid") if c in channels.columns]
    before = channels.select(*keys, F.col("message_type").alias("old_type"))
    new = rules.apply(channels).select(*keys, *kept)
    if "schema_data" in kept:
        # Schemas of text travel as text, which the rules rewrite; the bytes of others are kept, descriptors with their types renamed.
        new = new.withColumn("schema_data", F.when(F.col("schema").isNull(), F.col("schema_data")))
        new = _descriptors_renamed(new.join(before, keys)).drop("old_type")
    return messages.drop(*kept).join(counted(new), keys)


def _descriptors_renamed(channels: DataFrame) -> DataFrame:
    """``channels`` (with ``old_type``) whose protobuf descriptors call their message type by its new name."""
    names = channels.columns
    at = {c: names.index(c) for c in ("schema_encoding", "schema_data", "old_type", "message_type")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(at[c]).to_pylist() for c in at), strict=True)
            moved = [proto.rename(data, old, new) if kind == "protobuf" and data and old != new else data for kind, data, old, new in rows]
            yield pa.RecordBatch.from_arrays([pa.array(moved, c.type) if k == at["schema_data"] else c for k, c in enumerate(batch.columns)], names=names)

    return channels.mapInArrow(run, channels.schema)


def reencode(messages: DataFrame, on_error: str = "fail", framing: str = "cdr") -> DataFrame:
    """CDR payloads decoded and encoded anew under their channel's schema; other encodings pass.

    ``on_error``: ``fail``, ``drop`` the message, or ``passthrough`` it as it is. Readers are kept by schema text and type.
    """
    names = messages.columns
    at = {n: names.index(n) for n in ("message_type", "encoding", "schema", "schema_encoding", "data")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs: dict[tuple, tuple[cdr.Reader, cdr.Writer]] = {}

        def again(kind, encoding, text, text_kind, data):
            if encoding != "cdr" or data is None:
                return data
            key = (kind, text, text_kind)
            if key not in codecs:
                schema = S.parse(kind, text or "", text_kind)
                codecs[key] = cdr.Reader(schema, framing), cdr.Writer(schema, framing)
            reader, writer = codecs[key]
            return writer.encode(reader.decode(data))

        for batch in batches:
            columns = [batch.column(at[n]).to_pylist() for n in ("message_type", "encoding", "schema", "schema_encoding", "data")]
            out, keep = [], []
            for i, row in enumerate(zip(*columns, strict=True)):
                try:
                    out.append(again(*row))
                    keep.append(i)
                except (LogfoldError, UnicodeDecodeError):
                    if on_error == "fail":
                        raise
                    if on_error == "passthrough":
                        out.append(row[4])
                        keep.append(i)
            kept = batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))
            kind = batch.schema.field(at["data"]).type
            yield pa.RecordBatch.from_arrays([pa.array(out, kind) if k == at["data"] else c for k, c in enumerate(kept.columns)], names=names)

    return messages.mapInArrow(run, messages.schema)


def rewrite(spark: SparkSession, source: str, target: str, rules: Rules | None = None, format: str | None = None, validate: bool = True, on_error: str = "fail", keep_other: bool = True, recode: bool = True, **options) -> dict[str, int]:
    """Containers read, renamed, checked by recoding, and written. The format is the target's, not the source's.

    Schemas, payloads of other encodings, caller ids and attachments come through as they are; a bag holds no attachments.

    Returns counts: messages, cdr (recoded), passed (other encodings), dropped, topics_renamed, types_renamed, attachments.
    Those of topics and types count the channels of every file; distinct_topics_renamed counts a topic of several files once.
    """
    rules = rules or Rules()
    messages, channels = read(spark, source)
    out = renamed(messages, channels, rules, validate)
    if not keep_other:
        out = out.where("encoding = 'cdr'")
    if recode:
        out = reencode(out, on_error)
    format = format or ("bag" if target.rstrip("/").lower().endswith(".bag") else "mcap")
    write(out, target, format, **options)
    attached = spark.read.format("logfold_attachments").load(source)
    n_attached = attached.count() if format == "mcap" else 0
    if n_attached:
        attached.drop("file").write.format("logfold").mode("append").options(format="mcap", table="attachments").save(target)
    before = channels.agg(F.sum("message_count")).first()[0] or 0
    after = spark.read.format("logfold_channels").load(target).groupBy("encoding").agg(F.sum("message_count").alias("n")).collect()
    counts = {r.encoding: r.n for r in after}
    moved = channels.select("topic", (rules.topic(F.col("topic")) != F.col("topic")).alias("t"), (rules.type(F.col("message_type"), F.col("topic")) != F.col("message_type")).alias("k"))
    moved = moved.agg(F.count_if("t").alias("t"), F.count_if("k").alias("k"), F.countDistinct(F.when(F.col("t"), F.col("topic"))).alias("d")).first()
    done = sum(counts.values())
    return {"messages": done, "cdr": counts.get("cdr", 0), "passed": done - counts.get("cdr", 0), "dropped": before - done, "topics_renamed": moved.t, "distinct_topics_renamed": moved.d, "types_renamed": moved.k, "attachments": n_attached}


def convert(spark: SparkSession, source: str, target: str, format: str, **options) -> dict[str, int]:
    """Any container format to any other, payloads untouched."""
    return rewrite(spark, source, target, format=format, validate=False, recode=False, **options)
