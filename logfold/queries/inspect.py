"""Inspection: aggregates, order, windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import SQL, SQL_FILES, channels, event_messages, messages, table, two_recordings
from ..operators import filters as P
from ..operators import inspect as I
from ..operators import order as O
from ..operators import rename as R
from .registry import query


@query(
    "a1_topic_stats",
    f"""with {SQL},
    per as (select channel_id, count(*) as n, min(log_time) as a, max(log_time) as b from mess group by 1)
    select topic, message_type, n::bigint as n_messages, a::bigint as first_time, b::bigint as last_time, greatest(b - a, 0)::bigint as duration,
      round(n * 100.0 / sum(n) over (), 1)::double as share, round(case when b <= a then 0.0 else n / ((b - a) / 1e9) end, 6)::double as hz
    from per join chan using (channel_id)""",
)
def a1(spark, sf_dir):
    return I.topic_stats(messages(spark, sf_dir), channels(spark, sf_dir))


@query(
    "a2_file_info",
    f"""with {SQL} select count(*)::bigint as n_messages, (select count(*) from chan)::bigint as n_channels, (select count(distinct topic) from chan)::bigint as n_topics,
      min(log_time)::bigint as start_time, max(log_time)::bigint as end_time, (max(log_time) - min(log_time))::bigint as duration, sum(strlen(data))::bigint as payload_bytes from mess""",
)
def a2(spark, sf_dir):
    return I.file_info(messages(spark, sf_dir), channels(spark, sf_dir))


@query("a3_channel_counts", f"with {SQL} select channel_id, count(*)::bigint as n_messages from mess group by 1")
def a3(spark, sf_dir):
    return messages(spark, sf_dir).groupBy("channel_id").agg(F.count("*").alias("n_messages"))


@query("a4_distinct_topics", f"with {SQL} select count(distinct topic)::bigint as n_topics, count(distinct message_type)::bigint as n_types from chan")
def a4(spark, sf_dir):
    return channels(spark, sf_dir).agg(F.countDistinct("topic").alias("n_topics"), F.countDistinct("message_type").alias("n_types"))


@query("a5_share", "select event_type, round(count(*) * 100.0 / sum(count(*)) over (), 1)::double as share from events group by 1")
def a5(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return n.select("event_type", F.when(total == 0, 0.0).otherwise(F.round(F.col("n") * 100.0 / total, 1)).cast("double").alias("share"))


@query(
    "a6_by_encoding",
    f"""with {SQL} select encoding, count(distinct channel_id)::bigint as n_channels, coalesce(sum(n), 0)::bigint as n_messages,
      round(coalesce(sum(n), 0) * 100.0 / sum(coalesce(sum(n), 0)) over (), 1)::double as share
      from chan left join (select channel_id, count(*) as n from mess group by 1) using (channel_id) group by 1""",
)
def a6(spark, sf_dir):
    return I.by_encoding(messages(spark, sf_dir), channels(spark, sf_dir))


@query(
    "a7_by_type",
    f"""with {SQL} select message_type, coalesce(sum(n), 0)::bigint as n_messages, count(distinct topic)::bigint as n_topics
      from chan left join (select channel_id, count(*) as n from mess group by 1) using (channel_id) group by 1""",
)
def a7(spark, sf_dir):
    return I.by_type(messages(spark, sf_dir), channels(spark, sf_dir))


@query("a8_topics_of_type", f"with {SQL} select message_type, string_agg(distinct topic, ',' order by topic) as topics from chan group by 1")
def a8(spark, sf_dir):
    return I.topics_of_type(channels(spark, sf_dir))


@query("a9_topics_by_encoding", f"with {SQL} select coalesce(nullif(encoding, ''), 'unknown') as encoding, topic from chan")
def a9(spark, sf_dir):
    return I.topics_by_encoding(channels(spark, sf_dir))


@query("a10_frequency", "select event_type, round(case when max(ts) = min(ts) then 0 else count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) end, 6)::double as hz from events group by 1")
def a10(spark, sf_dir):
    per = event_messages(spark, sf_dir).groupBy(F.substring_index("topic", "/", -1).alias("event_type")).agg(F.count("*").alias("n"), (F.max("log_time") - F.min("log_time")).alias("d"))
    return per.select("event_type", F.round(X.frequency(F.col("n"), F.col("d")), 6).alias("hz"))


@query(
    "a11_rewrite_stats",
    f"""with {SQL} select count(*)::bigint as n_messages, count(*) filter (encoding = 'cdr')::bigint as n_cdr, count(*) filter (encoding <> 'cdr')::bigint as n_passed,
      count(distinct topic) filter (topic like '/conv/%')::bigint as n_topics_renamed from mess join chan using (channel_id)""",
)
def a11(spark, sf_dir):
    both = messages(spark, sf_dir).join(F.broadcast(channels(spark, sf_dir)), "channel_id")
    cdr = F.col("encoding") == "cdr"
    return both.agg(F.count("*").alias("n_messages"), F.count_if(cdr).alias("n_cdr"), F.count_if(~cdr).alias("n_passed"), F.countDistinct(F.when(F.col("topic").like("/conv/%"), F.col("topic"))).alias("n_topics_renamed"))


@query("a12_read_stats", f"with {SQL} select count(*)::bigint as n_messages, count(distinct message_id // 1000)::bigint as n_chunks, sum(strlen(data))::bigint as n_bytes from mess")
def a12(spark, sf_dir):
    return I.read_stats(messages(spark, sf_dir).withColumn("chunk", X.whole(F.col("message_id"), 1000)), "chunk")


@query(
    "a13_validation_summary",
    f"""with {SQL} select case when schema is null then 'error' when encoding = 'json' then 'warning' else 'ok' end as status, count(*)::bigint as n from chan group by 1""",
)
def a13(spark, sf_dir):
    status = F.when(F.col("schema").isNull(), "error").when(F.col("encoding") == "json", "warning").otherwise("ok")
    return channels(spark, sf_dir).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(
    "a14_chunk_sizes",
    f"""with {SQL} select message_id // 1000 as chunk, count(*)::bigint as n_messages, sum(strlen(data))::bigint as payload, min(log_time)::bigint as first_time,
      max(log_time)::bigint as last_time, (24 + 26 * count(*) + sum(strlen(data)))::bigint as serialized from mess group by 1""",
)
def a14(spark, sf_dir):
    return I.chunk_sizes(messages(spark, sf_dir).withColumn("chunk", X.whole(F.col("message_id"), 1000)), "chunk")


@query("a15_compression_ratio", "select event_type, round(case when sum(strlen(props)) = 0 then 1.0 else count(distinct props) * 1.0 / sum(strlen(props)) end, 6)::double as ratio from events group by 1")
def a15(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.octet_length("props")).alias("whole"), F.countDistinct("props").alias("packed"))
    return per.select("event_type", F.round(F.when(F.col("whole") == 0, 1.0).otherwise(F.col("packed") / F.col("whole")), 6).alias("ratio"))


@query("a18_rollup", f"with {SQL} select encoding, message_type, count(*)::bigint as n_messages, grouping_id(encoding, message_type)::bigint as level from mess join chan using (channel_id) group by rollup(encoding, message_type)")
def a18(spark, sf_dir):
    return I.rollup(messages(spark, sf_dir), channels(spark, sf_dir))


@query("a18_cube", "select event_type, hour(ts)::bigint as h, count(*)::bigint as n, sum(value)::decimal(18,2)::double as total from events group by cube(event_type, hour(ts))")
def a18_cube(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("h", F.hour("ts").cast("bigint"))
    return events.cube("event_type", "h").agg(F.count("*").alias("n"), F.sum("value").cast("decimal(18,2)").cast("double").alias("total"))


@query("w1_sequence", f"with {SQL} select channel_id, message_id, row_number() over (partition by channel_id order by log_time, message_id) - 1 as sequence from mess")
def w1(spark, sf_dir):
    return O.with_sequence(messages(spark, sf_dir), "message_id").select("channel_id", "message_id", "sequence")


@query("w2_first_per_topic", f"with {SQL} select channel_id, message_id, log_time from mess qualify row_number() over (partition by channel_id order by log_time, message_id) <= 3")
def w2(spark, sf_dir):
    return O.first_per_channel(messages(spark, sf_dir), 3, "message_id").select("channel_id", "message_id", "log_time")


@query("w3_fixture", f"with {SQL} select channel_id, message_id from mess qualify row_number() over (partition by channel_id order by log_time, message_id) = 1")
def w3(spark, sf_dir):
    return O.first_per_channel(messages(spark, sf_dir), 1, "message_id").select("channel_id", "message_id")


@query("w4_dense_channels", f"with {SQL} select topic, channel_id from chan")
def w4(spark, sf_dir):
    return channels(spark, sf_dir).select("topic", "channel_id")


@query("w6_share_of_total", f"with {SQL} select channel_id, n::bigint as n, round(n * 100.0 / sum(n) over (), 3)::double as share from (select channel_id, count(*) as n from mess group by 1)")
def w6(spark, sf_dir):
    n = messages(spark, sf_dir).groupBy("channel_id").agg(F.count("*").alias("n"))
    return n.select("channel_id", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 3).cast("double").alias("share"))


@query("w7_gaps", f"with {SQL} select channel_id, message_id, log_time - lag(log_time) over (partition by channel_id order by log_time, message_id) as gap from mess")
def w7(spark, sf_dir):
    return O.with_gap(messages(spark, sf_dir), "message_id").select("channel_id", "message_id", "gap")


@query("w7_moving", "select user_id, event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row), 6) as moving, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as recent from events")
def w7_moving(spark, sf_dir):
    # Per user, not per topic: a window's partition must stay as small as a user's events.
    rows = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    recent = "count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row)"
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.avg("value").over(rows), 6).alias("moving"), F.expr(recent).alias("recent"))


@query("o1_by_count", f"with {SQL} select topic, n::bigint as n_messages, row_number() over (order by n desc, topic) as place from (select topic, count(*) as n from mess join chan using (channel_id) group by 1)")
def o1(spark, sf_dir):
    n = messages(spark, sf_dir).groupBy("channel_id").agg(F.count("*").alias("n_messages")).join(F.broadcast(channels(spark, sf_dir)), "channel_id")
    order = Window.orderBy(F.desc("n_messages"), "topic")  # one row per channel
    return n.select("topic", "n_messages", F.row_number().over(order).cast("bigint").alias("place")).orderBy("place")


@query("o2_top_topics", f"with {SQL} select topic, count(*)::bigint as n_messages from mess join chan using (channel_id) group by 1 order by 2 desc, 1 limit 3")
def o2(spark, sf_dir):
    return I.topic_stats(messages(spark, sf_dir), channels(spark, sf_dir)).select("topic", "n_messages").orderBy(F.desc("n_messages"), "topic").limit(3)


@query("o3_schema_list", f"with {SQL} select distinct message_type, encoding, schema is not null as has_schema from chan order by 1")
def o3(spark, sf_dir):
    return channels(spark, sf_dir).select("message_type", "encoding", F.col("schema").isNotNull().alias("has_schema")).distinct().orderBy("message_type")


@query("o5_top_types", f"with {SQL} select message_type, count(*)::bigint as n_messages from mess join chan using (channel_id) group by 1 order by 2 desc, 1 limit 20")
def o5(spark, sf_dir):
    return I.by_type(messages(spark, sf_dir), channels(spark, sf_dir)).where("n_messages > 0").select("message_type", "n_messages").orderBy(F.desc("n_messages"), "message_type").limit(20)


@query("o7_schema_head", "select page_id, list_aggregate(string_split(html, '>')[1:5], 'string_agg', '>') as head, len(string_split(html, '>'))::bigint as n_lines from pages")
def o7(spark, sf_dir):
    lines = F.split("html", ">")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.slice(lines, 1, 5), ">").alias("head"), F.size(lines).cast("bigint").alias("n_lines"))


@query("o8_first_messages", f"with {SQL} select channel_id, message_id, log_time from mess order by log_time, channel_id, message_id limit 100")
def o8(spark, sf_dir):
    return O.first_messages(messages(spark, sf_dir), 100, "message_id").select("channel_id", "message_id", "log_time")


@query("o11_sorted", f"with {SQL} select channel_id, message_id, log_time from mess")
def o11(spark, sf_dir):
    return messages(spark, sf_dir).select("channel_id", "message_id", "log_time").orderBy("log_time", "channel_id", "message_id")


# The same reports over two files that use one id for different topics.

_KEYS = "file, channel_id"


@query(
    "a1_topic_stats_files",
    f"""with {SQL}, {SQL_FILES},
    per as (select {_KEYS}, count(*) as n, min(log_time) as a, max(log_time) as b from messes group by all)
    select file, topic, message_type, n::bigint as n_messages, a::bigint as first_time, b::bigint as last_time, greatest(b - a, 0)::bigint as duration,
      round(n * 100.0 / sum(n) over (), 1)::double as share, round(case when b <= a then 0.0 else n / ((b - a) / 1e9) end, 6)::double as hz
    from per join chans using ({_KEYS})""",
)
def a1_files(spark, sf_dir):
    return I.topic_stats(*two_recordings(spark, sf_dir))


@query(
    "a6_by_encoding_files",
    f"""with {SQL}, {SQL_FILES}, n as (select {_KEYS}, count(*) as n from messes group by all)
    select encoding, count(*)::bigint as n_channels, coalesce(sum(n), 0)::bigint as n_messages, round(coalesce(sum(n), 0) * 100.0 / sum(sum(n)) over (), 1)::double as share
    from chans left join n using ({_KEYS}) group by encoding""",
)
def a6_files(spark, sf_dir):
    return I.by_encoding(*two_recordings(spark, sf_dir))


@query(
    "a7_by_type_files",
    f"""with {SQL}, {SQL_FILES}, n as (select {_KEYS}, count(*) as n from messes group by all)
    select message_type, coalesce(sum(n), 0)::bigint as n_messages, count(distinct topic)::bigint as n_topics from chans left join n using ({_KEYS}) group by message_type""",
)
def a7_files(spark, sf_dir):
    return I.by_type(*two_recordings(spark, sf_dir))


@query("a18_rollup_files", f"with {SQL}, {SQL_FILES} select encoding, message_type, count(*)::bigint as n_messages, grouping_id(encoding, message_type)::bigint as level from messes join chans using ({_KEYS}) group by rollup(encoding, message_type)")
def a18_files(spark, sf_dir):
    return I.rollup(*two_recordings(spark, sf_dir))


@query("f4_channel_filter_files", f"with {SQL}, {SQL_FILES} select file, message_id from messes join chans using ({_KEYS}) where topic like '/conv/%'")
def f4_files(spark, sf_dir):
    rows, dims = two_recordings(spark, sf_dir)
    return P.of_channels(rows, dims.where(F.col("topic").startswith("/conv/"))).select("file", "message_id")


@query("j1_message_channel_files", f"with {SQL}, {SQL_FILES} select message_id, topic, message_type from messes join chans using ({_KEYS})")
def j1_files(spark, sf_dir):
    return R.Rules().apply(two_recordings(spark, sf_dir)[1]).join(two_recordings(spark, sf_dir)[0], ["file", "channel_id"]).select("message_id", "topic", "message_type")


@query("w1_sequence_files", f"with {SQL}, {SQL_FILES} select {_KEYS}, message_id, row_number() over (partition by {_KEYS} order by log_time, message_id) - 1 as sequence from messes")
def w1_files(spark, sf_dir):
    return O.with_sequence(two_recordings(spark, sf_dir)[0], "message_id").select("file", "channel_id", "message_id", "sequence")


@query("w2_first_per_topic_files", f"with {SQL}, {SQL_FILES} select {_KEYS}, message_id from messes qualify row_number() over (partition by {_KEYS} order by log_time, message_id) <= 3")
def w2_files(spark, sf_dir):
    return O.first_per_channel(two_recordings(spark, sf_dir)[0], 3, "message_id").select("file", "channel_id", "message_id")


@query("w7_gaps_files", f"with {SQL}, {SQL_FILES} select {_KEYS}, message_id, log_time - lag(log_time) over (partition by {_KEYS} order by log_time, message_id) as gap from messes")
def w7_files(spark, sf_dir):
    return O.with_gap(two_recordings(spark, sf_dir)[0], "message_id").select("file", "channel_id", "message_id", "gap")
