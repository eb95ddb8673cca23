"""Streams run over what is there now; SQL over the whole table gives the same rows."""

import posixpath

import pandas as pd
from pyspark.sql import functions as F

from ..model import SQL, table
from ..storage import scratch
from ..streaming import rates
from .files import recording
from .registry import query


def _stream(spark, sf_dir):
    """The events as a stream of one file, in event time. The first batch holds all rows, so none is late."""
    folder = f"{sf_dir}/events.parquet"
    kind = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(kind).option("pathGlobFilter", "*.parquet")
    # A table is one file or a folder of files; a stream reads folders.
    is_file = table(spark, sf_dir, "events").inputFiles()[0].endswith("/events.parquet")
    found = rows.option("pathGlobFilter", "events.parquet").load(posixpath.dirname(folder)) if is_file else rows.parquet(folder)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


@query("g1_pull", "select event_id, event_type from events")
def g1(spark, sf_dir):
    return rates.run_once(spark, _stream(spark, sf_dir).select("event_id", "event_type"), scratch(spark, "g1"), scratch(spark, "c"))


@query("g1_container_stream", f"with {SQL} select topic, message_id as sequence, log_time from mess join chan using (channel_id)")
def g1_containers(spark, sf_dir):
    arrived = spark.readStream.format("logfold").load(recording(spark, sf_dir)).select("topic", "sequence", "log_time")
    return rates.run_once(spark, arrived, scratch(spark, "g1c"), scratch(spark, "c"))


def _batch(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("g5_tumbling", "select event_type, epoch_us(time_bucket(interval 1 day, ts)) as start, count(*)::bigint as n from events group by all")
def g5(spark, sf_dir):
    return rates.tumbling(_batch(spark, sf_dir), "1 day", "event_type").select("event_type", F.unix_micros("start").alias("start"), "n")


@query("g5_sliding", "select event_type, epoch_us(time_bucket(interval 1 day, ts) - to_days(k::int)) as start, count(*)::bigint as n from events, (select unnest([0, 1]) as k) group by all")
def g5_sliding(spark, sf_dir):
    return rates.sliding(_batch(spark, sf_dir), "2 days", "1 day", "event_type").select("event_type", F.unix_micros("start").alias("start"), "n")


@query(
    "g5_sessions",
    """with b as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hours then 0 else 1 end as fresh from events),
    s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from b)
    select user_id, epoch_us(min(ts)) as start, epoch_us(max(ts)) + 43200000000 as "end", count(*)::bigint as n from s group by user_id, k""",
)
def g5_sessions(spark, sf_dir):
    return rates.sessions(_batch(spark, sf_dir), "12 hours", "user_id").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("g5_stream_windows", "select event_type, epoch_us(time_bucket(interval 1 day, ts)) as start, count(*)::bigint as n from events group by all having time_bucket(interval 1 day, any_value(ts)) + interval 1 day <= (select max(ts) - interval 1 hour from events)")
def g5_stream(spark, sf_dir):
    stream = rates.tumbling(_stream(spark, sf_dir), "1 day", "event_type").select("event_type", F.unix_micros("start").alias("start"), "n")
    return rates.run_once(spark, stream, scratch(spark, "g5"), scratch(spark, "c"))


@query("g4_running_numbers", "select event_type, count(*)::bigint as n, min(s)::bigint as first, max(s)::bigint as last from (select event_type, user_id % 8 as salt, row_number() over (partition by event_type, user_id % 8 order by ts, event_id) - 1 as s from events) group by event_type, salt")
def g4(spark, sf_dir):
    stream = _stream(spark, sf_dir).select(F.col("event_id").alias("id"), "event_type", (F.col("user_id") % 8).alias("salt"), "ts")
    out = rates.run_once(spark, rates.numbered(stream, "event_type", "salt"), scratch(spark, "g4"), scratch(spark, "c"))
    return out.groupBy("event_type", "salt").agg(F.count("*").alias("n"), F.min("sequence").alias("first"), F.max("sequence").alias("last")).drop("salt")


@query("g3_presets", "select * from (values ('default', 8388608, 100000, 100), ('max_throughput', 33554432, 500000, 500), ('high_throughput', 16777216, 250000, 200), ('low_latency', 1048576, 10000, 50)) v(name, bytes, messages, ms)")
def g3(spark, sf_dir):
    rows = pd.DataFrame([(k, *v) for k, v in rates.PRESETS.items()], columns=["name", "bytes", "messages", "ms"])
    return spark.createDataFrame(rows, "name string, bytes int, messages int, ms int")
