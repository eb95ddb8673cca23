"""Reports on a recording: aggregates over messages joined with their channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import channel_keys


def topic_stats(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """Per channel (of a file, where files are stated): messages, first and last time, duration, share of all messages in percent, rate in Hz.

    The messages are aggregated by channel before the dimension is joined.
    """
    keys = channel_keys(messages, channels)
    per = messages.groupBy(*keys).agg(F.count("*").alias("n_messages"), F.min("log_time").alias("first_time"), F.max("log_time").alias("last_time"))
    per = per.join(channels.select(*keys, "topic", "message_type"), keys)
    duration = F.greatest(F.col("last_time") - F.col("first_time"), F.lit(0))
    total = F.sum("n_messages").over(Window.partitionBy())
    return per.select(
        *keys[:-1],
        "topic",
        "message_type",
        "n_messages",
        "first_time",
        "last_time",
        duration.alias("duration"),
        F.round(F.col("n_messages") * 100.0 / total, 1).cast("double").alias("share"),
        F.round(X.frequency(F.col("n_messages"), duration), 6).alias("hz"),
    )


def file_info(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """One row: messages, channels, distinct topics, start, end, duration, payload bytes."""
    facts = messages.agg(F.count("*").alias("n_messages"), F.min("log_time").alias("start_time"), F.max("log_time").alias("end_time"), F.coalesce(F.sum(F.length("data")), F.lit(0)).alias("payload_bytes"))
    dims = channels.agg(F.count("*").alias("n_channels"), F.countDistinct("topic").alias("n_topics"))
    duration = F.when(F.col("end_time") > F.col("start_time"), F.col("end_time") - F.col("start_time")).otherwise(0).alias("duration")
    return facts.join(F.broadcast(dims)).select("n_messages", "n_channels", "n_topics", "start_time", "end_time", duration, "payload_bytes")


def by_encoding(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """Per encoding: channels, messages and their share in percent. Channels without messages count."""
    keys = channel_keys(messages, channels)
    per = messages.groupBy(*keys).agg(F.count("*").alias("n"))
    total = F.sum("n_messages").over(Window.partitionBy())
    out = channels.join(per, keys, "left").groupBy("encoding").agg(F.count("*").alias("n_channels"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_messages"))
    share = F.when(total == 0, F.lit(0.0)).otherwise(F.round(F.col("n_messages") * 100.0 / total, 1).cast("double"))
    return out.select("encoding", "n_channels", "n_messages", share.alias("share"))


def by_type(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """Per message type: messages and distinct topics."""
    keys = channel_keys(messages, channels)
    per = messages.groupBy(*keys).agg(F.count("*").alias("n"))
    return channels.join(per, keys, "left").groupBy("message_type").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_messages"), F.countDistinct("topic").alias("n_topics"))


def topics_of_type(channels: DataFrame) -> DataFrame:
    """Per message type its topics, sorted and joined. The dimension bounds the list."""
    return channels.groupBy("message_type").agg(F.array_join(F.sort_array(F.collect_set("topic")), ",").alias("topics"))


def topics_by_encoding(channels: DataFrame) -> DataFrame:
    """Topics under their encoding, ``unknown`` where it is empty."""
    return channels.select(F.coalesce(F.nullif("encoding", F.lit("")), F.lit("unknown")).alias("encoding"), "topic").orderBy("encoding", "topic")


def rollup(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """Messages by encoding and type, with subtotals (nulls) on both levels."""
    keys = channel_keys(messages, channels)
    per = messages.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.join(channels, keys).rollup("encoding", "message_type").agg(F.sum("n").alias("n_messages"), F.grouping_id().cast("bigint").alias("level"))


def read_stats(messages: DataFrame, chunk: str) -> DataFrame:
    """Messages, chunks and payload bytes of a scan."""
    return messages.agg(F.count("*").alias("n_messages"), F.countDistinct(chunk).alias("n_chunks"), F.sum(F.length("data")).alias("n_bytes"))


def chunk_sizes(messages: DataFrame, chunk: str) -> DataFrame:
    """Per chunk: messages, payload bytes, the estimate of its serialised size, and its time bounds."""
    out = messages.groupBy(chunk).agg(F.count("*").alias("n_messages"), F.sum(F.length("data")).cast("long").alias("payload"), F.min("log_time").alias("first_time"), F.max("log_time").alias("last_time"))
    return out.withColumn("serialized", F.lit(24) + 26 * F.col("n_messages") + F.col("payload"))
