"""Containers: written from the tables, then read, filtered, renamed, converted."""

from pyspark.sql import functions as F

from ..codecs import cdr
from ..model import SQL, channels, messages, nanos, table
from ..operators import filters as P
from ..operators import order as O
from ..operators import rename as R
from ..operators import rewrite as W
from ..plans import schema as S
from ..sources import datasource, detect
from ..storage import local, scratch
from .registry import query

SAID = S.parse("std_msgs/msg/String", "string data")


def recording(spark, sf_dir, format="mcap", **options) -> str:
    """The tables as containers: events with JSON payloads, conversation turns as CDR strings."""
    datasource.register(spark)
    path = local(scratch(spark, format))
    rows = messages(spark, sf_dir).join(F.broadcast(channels(spark, sf_dir)), "channel_id")
    rows = rows.withColumn("schema_encoding", F.when(F.col("encoding") == "cdr", "ros2msg").otherwise("jsonschema"))
    said = cdr.encode(rows.where("encoding = 'cdr'").withColumn("v", F.struct(F.col("data").cast("string").alias("data"))).drop("data"), "v", SAID).drop("v")
    both = rows.where("encoding <> 'cdr'").unionByName(said.select(*rows.columns))
    # The containers' ids are 16 bits wide; the message's own number travels in its sequence.
    both = both.withColumn("channel_id", F.col("channel_id").cast("int")).withColumn("sequence", F.col("message_id") % (1 << 31))
    # Few, even containers; small chunks, so that the files have several.
    W.write(both.repartition(4, "message_id") if options.pop("spread", True) else both, path, format, chunkSize=65536, **options)
    return path


def _load(spark, path, **options):
    return spark.read.format("logfold").options(**options).load(path)


_TOPICS = "select topic, count(*)::bigint as n, min(log_time)::bigint as first_time, max(log_time)::bigint as last_time from mess join chan using (channel_id)"


def _topics(df):
    return df.groupBy("topic").agg(F.count("*").alias("n"), F.min("log_time").alias("first_time"), F.max("log_time").alias("last_time"))


@query("s1_mcap_scan", f"with {SQL} select topic, log_time, message_id as sequence, case when encoding = 'json' then data end as payload from mess join chan using (channel_id)")
def s1(spark, sf_dir):
    rows = _load(spark, recording(spark, sf_dir))
    return rows.select("topic", "log_time", "sequence", F.when(F.col("encoding") == "json", F.col("data").cast("string")).alias("payload"))


@query("s7_topic_and_time", f"with {SQL} {_TOPICS} where topic in ('/events/click', '/conv/user') and log_time between 3600000000000 and 1705000000000000000 group by 1")
def s7(spark, sf_dir):
    rows = _load(spark, recording(spark, sf_dir))
    return _topics(rows.where(F.col("topic").isin("/events/click", "/conv/user") & P.in_time(3_600_000_000_000, 1_705_000_000_000_000_000)))


@query("s8_metadata_only", f"with {SQL} select count(*)::bigint as n, sum(message_id)::bigint as total from mess")
def s8(spark, sf_dir):
    return _load(spark, recording(spark, sf_dir), payload="false").agg(F.count("*").alias("n"), F.sum("sequence").alias("total"))


@query("s12_bag_scan", f"with {SQL} {_TOPICS} group by 1")
def s12(spark, sf_dir):
    return _topics(_load(spark, recording(spark, sf_dir, "bag")))


@query("s14_bag_bz2", f"with {SQL} select topic, count(*)::bigint as n, sum(strlen(data))::bigint as n_bytes from mess join chan using (channel_id) where encoding = 'json' group by 1")
def s14(spark, sf_dir):
    rows = _load(spark, recording(spark, sf_dir, "bag", compression="bz2"))
    return rows.where(F.col("topic").startswith("/events/")).groupBy("topic").agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("n_bytes"))


@query("s20_channels", f"with {SQL} select topic, message_type, encoding, schema, count(*)::bigint as n from mess join chan using (channel_id) group by all")
def s20(spark, sf_dir):
    path = recording(spark, sf_dir)
    found = spark.read.format("logfold_channels").load(path)
    return found.groupBy("topic", "message_type", "encoding", "schema").agg(F.sum("message_count").alias("n"))


@query("s20_files", f"with {SQL} select 'mcap' as format, count(*)::bigint as n, min(log_time)::bigint as start_time, max(log_time)::bigint as end_time from mess")
def s20_files(spark, sf_dir):
    found = spark.read.format("logfold_files").load(recording(spark, sf_dir))
    return found.groupBy("format").agg(F.sum("message_count").alias("n"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))


@query("s3_detect", "select * from (values ('bag', true), ('mcap', true)) v(format, found)")
def s3(spark, sf_dir):
    a, b = recording(spark, sf_dir), recording(spark, sf_dir, "bag")
    heads = spark.read.format("binaryFile").load([f"file://{a}", f"file://{b}"]).select("path", F.substring("content", 1, 16).alias("head"))
    return heads.groupBy(detect.format_of(F.lit(""), F.col("head")).alias("format")).agg((F.count("*") > 0).alias("found"))


@query("s16_connections", f"with {SQL} select topic, dense_rank() over (order by topic) - 1 as place from (select distinct topic from mess join chan using (channel_id))")
def s16(spark, sf_dir):
    from pyspark.sql import Window

    topics = _load(spark, recording(spark, sf_dir, "bag")).select("topic").distinct()
    return topics.select("topic", (F.dense_rank().over(Window.orderBy("topic")) - 1).cast("bigint").alias("place"))


@query("k3_mcap_options", f"with {SQL} {_TOPICS} group by 1")
def k3(spark, sf_dir):
    return _topics(_load(spark, recording(spark, sf_dir, compression="lz4", compressionLevel=1)))


@query("k5_writer_sequences", f"with {SQL} select topic, count(*)::bigint as n, max(s)::bigint as last from (select topic, row_number() over (partition by topic order by log_time, message_id) - 1 as s from mess join chan using (channel_id)) group by 1")
def k5(spark, sf_dir):
    datasource.register(spark)
    path = local(scratch(spark, "numbered"))
    rows = O.with_sequence(messages(spark, sf_dir), "message_id").join(F.broadcast(channels(spark, sf_dir)), "channel_id")
    W.write(rows.withColumn("channel_id", F.col("channel_id").cast("int")), path, "mcap")
    return _load(spark, path).groupBy("topic").agg(F.count("*").alias("n"), F.max("sequence").alias("last"))


@query("k8_report", f"with {SQL} select topic, '{{\"topic\":\"' || topic || '\",\"n\":' || count(*) || '}}' as report from mess join chan using (channel_id) group by 1")
def k8(spark, sf_dir):
    path = scratch(spark, "report")
    rows = _topics(messages(spark, sf_dir).join(F.broadcast(channels(spark, sf_dir)), "channel_id")).select("topic", "n")
    rows.write.json(path)
    return spark.read.text(path).select(F.get_json_object("value", "$.topic").alias("topic"), F.col("value").alias("report"))


_RULES = R.Rules().with_topic_rename_wildcard("/conv/*", "/chat/*").with_type_rename("std_msgs/msg/String", "text_msgs/msg/Text")


@query(
    "t17_rewrite_mcap",
    f"""with {SQL} select case when topic like '/conv/%' then '/chat/' || substr(topic, 7) else topic end as topic, case when message_type = 'std_msgs/msg/String' then 'text_msgs/msg/Text' else message_type end as message_type,
      message_id as sequence, log_time from mess join chan using (channel_id)""",
)
def t17(spark, sf_dir):
    target = local(scratch(spark, "rewritten"))
    W.rewrite(spark, recording(spark, sf_dir), target, _RULES, chunkSize=65536)
    return _load(spark, target).select("topic", "message_type", "sequence", "log_time")


@query("t18_rewrite_bag", f"with {SQL} select case when topic like '/conv/%' then '/chat/' || substr(topic, 7) else topic end as topic, count(*)::bigint as n from mess join chan using (channel_id) group by 1")
def t18(spark, sf_dir):
    target = local(scratch(spark, "rewritten"))
    W.rewrite(spark, recording(spark, sf_dir, "bag"), target, _RULES, format="bag", recode=False)
    return _load(spark, target).groupBy("topic").agg(F.count("*").alias("n"))


@query("t19_options", f"with {SQL} select count(*) filter (encoding = 'cdr')::bigint as messages, count(*) filter (encoding <> 'cdr')::bigint as dropped, 3::bigint as topics_renamed from mess join chan using (channel_id)")
def t19(spark, sf_dir):
    stats = W.rewrite(spark, recording(spark, sf_dir), local(scratch(spark, "cdr")), _RULES, keep_other=False)
    return spark.createDataFrame([(stats["messages"], stats["dropped"], stats["distinct_topics_renamed"])], "messages long, dropped long, topics_renamed long")


@query("t20_convert", f"with {SQL} {_TOPICS} group by 1")
def t20(spark, sf_dir):
    bag, mcap = local(scratch(spark, "bag")), local(scratch(spark, "mcap"))
    W.convert(spark, recording(spark, sf_dir), bag, "bag")
    W.convert(spark, bag, mcap, "mcap")
    return _topics(_load(spark, mcap))


@query("f12_extract_file", "select event_id as sequence, epoch_us(ts) * 1000 as log_time from events where ts between timestamp '2024-01-05' and timestamp '2024-01-12 12:00:00'")
def f12_file(spark, sf_dir):
    start, end = P.parse_time_range("2024-01-05T00:00:00Z,2024-01-12T12:00:00Z")
    path, target = recording(spark, sf_dir), local(scratch(spark, "slice"))
    W.write(_load(spark, path).where(P.in_time(start, end)), target, "mcap")
    return _load(spark, target).select("sequence", "log_time")


@query("d1_dispatch", f"with {SQL} select message_id as sequence, case when encoding = 'cdr' then data::varchar end as said, case when encoding = 'json' then cast(json_extract(data, '$.k') as bigint) end as k from mess join chan using (channel_id) where encoding = 'json' or encoding = 'cdr'")
def d1(spark, sf_dir):
    from ..codecs import jsons

    rows = _load(spark, recording(spark, sf_dir))
    said = cdr.decode(rows.where("encoding = 'cdr'"), "data", SAID).select("sequence", F.col("message.data").alias("said"), F.lit(None).cast("bigint").alias("k"))
    props = rows.where("encoding = 'json'").select("sequence", F.lit(None).cast("string").alias("said"), jsons.value(jsons.decode(F.col("data")), "$.k", "bigint").alias("k"))
    return said.unionByName(props)


@query("d2_decode_with_times", "select (conv_id * 1000 + turn) as sequence, (conv_id * 3600 + turn) * 1000000000 as log_time, text from conversations")
def d2(spark, sf_dir):
    rows = _load(spark, recording(spark, sf_dir, "bag"))
    read = cdr.decode(rows.where(F.col("topic").startswith("/conv/")), "data", SAID)
    key = F.call_function("div", F.col("log_time"), F.lit(1_000_000_000))
    conv = F.call_function("div", key, F.lit(3600))
    return read.select((conv * 1000 + key - conv * 3600).alias("sequence"), "log_time", F.col("message.data").alias("text"))


@query("a2_table_times", "select min(epoch_us(ts))::bigint * 1000 as first_time, max(epoch_us(ts))::bigint * 1000 as last_time from events")
def a2_times(spark, sf_dir):
    time = nanos(F.col("ts"))
    return table(spark, sf_dir, "events").agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))
