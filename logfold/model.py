"""The data model: a recording is a fact table of messages and a small dimension table of channels.

``messages``: file, channel_id, log_time and publish_time (ns since the epoch), sequence, data.
``channels``: file, channel_id, topic, message_type, encoding, schema, callerid. Ids are 16 bits wide in the file
formats and count within a file, so two files use one id for different topics: ``file`` belongs to every key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("channel_id", T.IntegerType()),
        T.StructField("log_time", T.LongType()),
        T.StructField("publish_time", T.LongType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("data", T.BinaryType()),
    ]
)
CHANNELS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("channel_id", T.IntegerType()),
        T.StructField("topic", T.StringType()),
        T.StructField("message_type", T.StringType()),
        T.StructField("encoding", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("schema_encoding", T.StringType()),
        T.StructField("schema_data", T.BinaryType()),
        T.StructField("callerid", T.StringType()),
    ]
)

#: Settings a session needs for these tables.
SESSION = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def channel_keys(*frames: DataFrame) -> list[str]:
    """What names a channel: its id within its file, or the id alone where a frame states no file."""
    return ["file", "channel_id"] if all("file" in f.columns for f in frames) else ["channel_id"]


#: Dimensions of at most so many rows are broadcast; a corpus of many files has more, and they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def counted(dimension: DataFrame) -> DataFrame:
    """``dimension`` marked for broadcast if a count proves it small."""
    return F.broadcast(dimension) if dimension.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dimension


def nanos(ts: Column) -> Column:
    """Nanoseconds since the epoch of a timestamp without zone, taken as UTC."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as messages with their topic: JSON payloads in ``data``."""
    events = table(spark, sf_dir, "events")
    time = nanos(F.col("ts"))
    return events.select(F.concat(F.lit("/events/"), "event_type").alias("topic"), time.alias("log_time"), time.alias("publish_time"), F.col("event_id").alias("message_id"), F.col("props").cast("binary").alias("data"))


def said_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages: a second long per turn, the role as topic."""
    said = table(spark, sf_dir, "conversations")
    time = (F.col("conv_id") * 3600 + F.col("turn")) * 1_000_000_000
    return said.select(F.concat(F.lit("/conv/"), "role").alias("topic"), time.alias("log_time"), time.alias("publish_time"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.col("text").cast("binary").alias("data"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel dimension of the tables as a recording; ids are dense in topic order."""
    events = table(spark, sf_dir, "events").select("event_type").distinct()
    roles = table(spark, sf_dir, "conversations").select("role").distinct()
    labels = table(spark, sf_dir, "embeddings").select("label").distinct()
    rows = events.select(F.concat(F.lit("/events/"), "event_type").alias("topic"), F.concat(F.lit("demo_msgs/msg/"), F.initcap("event_type")).alias("message_type"), F.lit("json").alias("encoding"), F.lit('{"type": "object"}').alias("schema"))
    rows = rows.unionByName(roles.select(F.concat(F.lit("/conv/"), "role").alias("topic"), F.lit("std_msgs/msg/String").alias("message_type"), F.lit("cdr").alias("encoding"), F.lit("string data").alias("schema")))
    rows = rows.unionByName(labels.select(F.concat(F.lit("/vec/label_"), F.col("label").cast("string")).alias("topic"), F.lit("demo_msgs/Embedding").alias("message_type"), F.lit("protobuf").alias("encoding"), F.lit(None).cast("string").alias("schema")))
    from pyspark.sql import Window

    return rows.withColumn("channel_id", (F.dense_rank().over(Window.orderBy("topic")) - 1).cast("bigint"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of events and conversations with their channel ids."""
    both = event_messages(spark, sf_dir).unionByName(said_messages(spark, sf_dir))
    ids = channels(spark, sf_dir).select("topic", "channel_id")
    return both.join(F.broadcast(ids), "topic").drop("topic")


def two_recordings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Messages and channels in two files that use the same ids for different topics: ``b`` counts them from the other end."""
    one = channels(spark, sf_dir)
    last = one.agg(F.max("channel_id").alias("last"))
    turned = lambda df: df.join(F.broadcast(last)).withColumn("channel_id", F.when(F.col("file") == "b", F.col("last") - F.col("channel_id")).otherwise(F.col("channel_id"))).drop("last")
    both = one.withColumn("file", F.explode(F.array(F.lit("a"), F.lit("b"))))
    rows = messages(spark, sf_dir).withColumn("file", F.when(F.col("message_id") % 3 == 0, "b").otherwise("a"))
    return turned(rows), turned(both)


#: The same tables in DuckDB SQL, as common table expressions.
SQL = """
chan as (
  select topic, message_type, encoding, schema, dense_rank() over (order by topic) - 1 as channel_id from (
    select distinct '/events/' || event_type as topic, 'demo_msgs/msg/' || upper(event_type[1]) || event_type[2:] as message_type, 'json' as encoding, '{"type": "object"}' as schema from events
    union all select distinct '/conv/' || role, 'std_msgs/msg/String', 'cdr', 'string data' from conversations
    union all select distinct '/vec/label_' || label, 'demo_msgs/Embedding', 'protobuf', null from embeddings)),
mess as (
  select c.channel_id, m.log_time, m.log_time as publish_time, m.message_id, m.data from (
    select '/events/' || event_type as topic, epoch_us(ts) * 1000 as log_time, event_id as message_id, props as data from events
    union all select '/conv/' || role, (conv_id * 3600 + turn) * 1000000000, conv_id * 1000 + turn, text from conversations) m
  join chan c on c.topic = m.topic)
"""
#: ``two_recordings`` in DuckDB SQL, behind ``SQL``.
SQL_FILES = """
chans as (select f.file, c.* replace (case when f.file = 'b' then (select max(channel_id) from chan) - c.channel_id else c.channel_id end as channel_id) from chan c, (values ('a'), ('b')) f(file)),
messes as (select case when message_id % 3 = 0 then 'b' else 'a' end as file, m.* replace (case when message_id % 3 = 0 then (select max(channel_id) from chan) - m.channel_id else m.channel_id end as channel_id) from mess m)
"""
