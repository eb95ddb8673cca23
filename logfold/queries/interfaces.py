"""Builders, options, registries, extension points: what has no place among the other queries."""

import io

from pyspark.sql import functions as F

from .. import api, cli
from ..codecs import cdr, jsons, proto
from ..codecs import registry as codecs
from ..errors import InvalidRuleError, LogfoldError
from ..functions import tables
from ..model import SQL, channels, messages, table
from ..operators import inspect as I
from ..operators import rename as R
from ..operators import rewrite as W
from ..plans import schema as S
from ..sources import bag, datasource, mcap
from ..storage import local, scratch
from .files import _load, _topics, recording
from .payloads import descriptors
from .registry import query
from .schemas import JOINT, _values

_PER_TOPIC = f"with {SQL} select topic, count(*)::bigint as n, min(log_time)::bigint as first_time, max(log_time)::bigint as last_time from mess join chan using (channel_id) group by 1"


@query("s2_reader_options", _PER_TOPIC)
def s2(spark, sf_dir):
    return _topics(_load(spark, recording(spark, sf_dir), partitionBytes="100000"))


@query("s4_partition_planning", f"with {SQL} select count(*)::bigint as n, true as finer from mess")
def s4(spark, sf_dir):
    path = recording(spark, sf_dir)
    kind = _load(spark, path).schema
    parts = [len(datasource.MessageReader({"path": path, "partitionbytes": size}, kind).partitions()) for size in ("1", "1000000000")]
    return _load(spark, path).agg(F.count("*").alias("n")).withColumn("finer", F.lit(parts[0] > parts[1]))


@query("s5_summary", f"with {SQL} select count(*)::bigint as n, sum(log_time = log_time)::bigint as counted from mess")
def s5(spark, sf_dir):
    path = recording(spark, sf_dir)
    stated = spark.read.format("logfold_files").load(path).agg(F.sum("message_count").alias("n"))
    counted = _load(spark, path, payload="false").agg(F.count("*").alias("counted"))
    return stated.join(F.broadcast(counted))


@query("s6_without_summary", _PER_TOPIC)
def s6(spark, sf_dir):
    return _topics(_load(spark, recording(spark, sf_dir, summary="false")))


@query("s9_exact_counts", f"with {SQL} select topic, count(*)::bigint as n from mess join chan using (channel_id) group by 1")
def s9(spark, sf_dir):
    path = recording(spark, sf_dir, summary="false")
    return spark.read.format("logfold_channels").load(path).groupBy("topic").agg(F.sum("message_count").alias("n")).where("n > 0")


@query("s11_parallel_read", f"with {SQL} select count(*)::bigint as n_messages, true as chunked from mess")
def s11(spark, sf_dir):
    stats = I.read_stats(_load(spark, recording(spark, sf_dir)).withColumn("chunk", F.concat_ws(":", "file", "chunk_offset")), "chunk")
    return stats.select("n_messages", (F.col("n_chunks") > 1).alias("chunked"))


@query("s13_unindexed_bag", _PER_TOPIC)
def s13(spark, sf_dir):
    return _topics(_load(spark, recording(spark, sf_dir, "bag", summary="false")))


@query("s15_record_fields", _values("('conn', '01000000'), ('op', '07'), ('topic', '2F61')", "name, value"))
def s15(spark, sf_dir):
    found = bag.fields(bag._header(op=b"\x07", conn=b"\x01\0\0\0", topic=b"/a")[4:])
    return spark.createDataFrame([(k, v.hex().upper()) for k, v in found.items()], "name string, value string")


@query("s21_tables", "select 'region' as name, count(*)::bigint as n from region union all select 'orders', count(*) from orders")
def s21(spark, sf_dir):
    one = lambda t: table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
    return one("region").unionByName(one("orders"))


@query("s22_attachments", _values("('cal.yaml', 'text/yaml', 7::bigint, 5::bigint)", "name, media_type, log_time, size"))
def s22(spark, sf_dir):
    import os

    datasource.register(spark)
    path = local(scratch(spark, "attached"))
    os.makedirs(path)
    out = io.BytesIO()
    w = mcap.Writer(out)
    w.add_attachment("cal.yaml", "text/yaml", 7, b"a: 12")
    w.finish()
    with open(f"{path}/a.mcap", "wb") as f:
        f.write(out.getvalue())
    found = spark.read.format("logfold_attachments").load(path)
    return found.select("name", "media_type", "log_time", F.length("data").cast("bigint").alias("size"))


@query("k1_writer", f"with {SQL} select count(*)::bigint as n from mess")
def k1(spark, sf_dir):
    path = local(scratch(spark, "api"))
    rows = messages(spark, sf_dir).join(F.broadcast(channels(spark, sf_dir)), "channel_id").select("topic", "message_type", "encoding", "schema", "log_time", "publish_time", "data")
    w = api.Writer(spark, path)
    w.write(rows)
    w.finish()
    return api.Reader(spark, path).messages.agg(F.count("*").alias("n"))


@query("k2_chunk_size", f"with {SQL} select count(*)::bigint as n, true as more_chunks from mess")
def k2(spark, sf_dir):
    datasource.register(spark)
    rows = messages(spark, sf_dir).join(F.broadcast(channels(spark, sf_dir)), "channel_id").withColumn("channel_id", F.col("channel_id").cast("int")).withColumn("sequence", F.lit(None).cast("long"))
    counts = []
    for size in (20_000, 4 << 20):
        path = local(scratch(spark, "chunks"))
        W.write(rows, path, "mcap", single_file=True, chunkSize=size)
        counts.append(spark.read.format("logfold_files").load(path).agg(F.sum("n_chunks").alias("c"), F.sum("message_count").alias("n")).first())
    return spark.createDataFrame([(counts[0].n, counts[0].c > counts[1].c)], "n long, more_chunks boolean")


@query("k6_bag_writer", f"with {SQL} select topic, message_type, count(*)::bigint as n from mess join chan using (channel_id) group by 1, 2")
def k6(spark, sf_dir):
    found = spark.read.format("logfold_channels").load(recording(spark, sf_dir, "bag"))
    return found.groupBy("topic", "message_type").agg(F.sum("message_count").alias("n")).where("n > 0")


@query("k7_connection_dedup", _values("('/a', 'n1', 2::bigint), ('/a', 'n2', 1::bigint), ('/b', 'n1', 1::bigint)", "topic, callerid, n"))
def k7(spark, sf_dir):
    datasource.register(spark)
    path = local(scratch(spark, "callers"))
    rows = spark.createDataFrame([("/a", "n1", 1), ("/a", "n2", 2), ("/a", "n1", 3), ("/b", "n1", 4)], "topic string, callerid string, log_time long")
    full = rows.select("*", F.lit("x/T").alias("message_type"), F.lit("ros1").alias("encoding"), F.lit("int32 x").alias("schema"), F.lit(None).cast("int").alias("channel_id"), F.lit(None).cast("long").alias("sequence"), F.lit(b"").alias("data"))
    W.write(full, path, "bag", single_file=True)
    return spark.read.format("logfold_channels").load(path).select("topic", "callerid", F.col("message_count").alias("n"))


@query("d3a_plan", _values("(0, 'read int32 align 4', 'header.stamp.sec'), (1, 'read uint32 align 4', 'header.stamp.nanosec'), (2, 'string align 4', 'header.frame_id'), (3, 'sequence', 'name'), (4, 'string align 4', 'name[]'), (5, 'sequence', 'position'), (6, 'read float64 align 8', 'position[]')", "pos, step, path"))
def d3a(spark, sf_dir):
    plan = cdr.steps(S.parse("sensor_msgs/msg/JointState", JOINT))
    return spark.createDataFrame([(i, *p) for i, p in enumerate(plan)], "pos int, step string, path string")


@query("d12_protobuf_encode", "select event_id, case when event_id % 2 = 0 then 0.0 else value end as value, case when event_id % 3 = 0 then '' else event_type end as event_type from events")
def d12(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("m", F.struct("event_id", F.when(F.col("event_id") % 2 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("event_type"), "user_id", F.array().cast("array<struct<name:string>>").alias("tags"))).select("m")
    data = proto.encode(rows, "m", descriptors(), "demo.msg.Event").select("data")
    return proto.decode(data, "data", descriptors(), "demo.msg.Event").select("message.event_id", "message.value", "message.event_type")


@query("d19_python_values", "select event_type, count(*)::bigint as n from events group by 1")
def d19(spark, sf_dir):
    found = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return spark.createDataFrame([r.asDict() for r in found.collect()], found.schema)


@query("j6_wildcard_join", f"with {SQL} select channel_id, case when topic = '/events/click' then '/first/click' when topic like '/events/%' then '/log/' || substr(topic, 9) else topic end as topic from chan")
def j6(spark, sf_dir):
    rules = spark.createDataFrame([("^/events/(.*)$", "/log/$1", 2), ("^/events/(click)$", "/first/$1", 1), ("^/none$", "/x", 0)], "pattern string, target string, priority int")
    return R.by_rule_table(channels(spark, sf_dir), rules).select("channel_id", "topic")


@query("j7_composite_join", f"with {SQL} select topic, case when topic = '/conv/user' and message_type = 'std_msgs/msg/String' then 'a/B' else message_type end as message_type from chan")
def j7(spark, sf_dir):
    rules = spark.createDataFrame([("/conv/user", "std_msgs/msg/String", "a/B"), ("/conv/user", "other/T", "c/D")], "topic string, message_type string, target string")
    both = channels(spark, sf_dir).join(F.broadcast(rules), ["topic", "message_type"], "left")
    return both.select("topic", F.coalesce("target", "message_type").alias("message_type"))


@query("o4_topics_in_encodings", f"with {SQL} select encoding, topic from chan")
def o4(spark, sf_dir):
    return I.topics_by_encoding(channels(spark, sf_dir)).orderBy("encoding", "topic")


@query("o6_limit", f"with {SQL} select topic from chan where contains(topic, 'e') order by topic limit 10")
def o6(spark, sf_dir):
    return channels(spark, sf_dir).where(F.col("topic").contains("e")).orderBy("topic").limit(10).select("topic")


@query("o9_longest_first", f"with {SQL} select topic, case when topic like '/events/c%' then 'long' when topic like '/events/%' then 'mid' when topic like '/%' then 'short' end as rule from chan")
def o9(spark, sf_dir):
    rules = R.Rules().with_topic_rename_wildcard("/*", "short").with_topic_rename_wildcard("/events/c*", "long").with_topic_rename_wildcard("/events/*", "mid")
    return channels(spark, sf_dir).select("topic", rules.topic(F.col("topic")).alias("rule"))


@query("o10_sorted_counts", f"with {SQL} select string_agg(channel_id || ':' || n, ',' order by channel_id) as counts from (select channel_id, count(*) as n from mess group by 1)")
def o10(spark, sf_dir):
    n = messages(spark, sf_dir).groupBy("channel_id").agg(F.count("*").alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct("channel_id", "n")))  # a row per channel
    return n.agg(F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["channel_id"].cast("string"), p["n"].cast("string"))), ",").alias("counts"))


@query("t1_builder", f"with {SQL} select channel_id, case when topic = '/conv/user' then '/u' else topic end as topic, case when message_type = 'std_msgs/msg/String' then 'x/Y' else message_type end as message_type from chan")
def t1(spark, sf_dir):
    rules = R.Rules().with_topic_rename("/conv/user", "/u").with_type_rename("std_msgs/msg/String", "x/Y")
    return rules.apply(channels(spark, sf_dir)).select("channel_id", "topic", "message_type")


@query("t2_custom_transform", f"with {SQL} select channel_id, '/own' || upper(topic) as topic from chan where topic not like '/vec/%'")
def t2(spark, sf_dir):
    steps = (lambda t: None if t.startswith("/vec/") else t.upper(), lambda t: "/own" + t)
    return R.transform_channels(channels(spark, sf_dir), *steps).select("channel_id", "topic")


_TOML = '[type_mappings]\n"std_msgs/msg/String" = "own/Text"\n[[topic_mappings]]\nfrom = "/conv/*"\nto = "/own/*"\n'
_JSON = '{"topic_wildcards": [{"pattern": "/conv/*", "target": "/own/*"}], "type_renames": [{"from": "std_msgs/msg/String", "to": "own/Text"}]}'
_CONFIGURED = f"with {SQL} select channel_id, case when topic like '/conv/%' then '/own/' || substr(topic, 7) else topic end as topic, case when message_type = 'std_msgs/msg/String' then 'own/Text' else message_type end as message_type from chan"


@query("t10_toml_rules", _CONFIGURED)
def t10(spark, sf_dir):
    return R.from_toml(_TOML).apply(channels(spark, sf_dir)).select("channel_id", "topic", "message_type")


@query("t11_json_rules", _CONFIGURED)
def t11(spark, sf_dir):
    return R.from_json(_JSON).apply(channels(spark, sf_dir)).select("channel_id", "topic", "message_type")


def _kind_of(action) -> str:
    try:
        action()
    except LogfoldError as e:
        return e.kind
    return "none"


@query("t12_errors", _values("('missing', 'not_found'), ('types', 'type_collision'), ('topics', 'topic_collision'), ('rule', 'invalid_rule'), ('fine', 'none')", "tried, kind"))
def t12(spark, sf_dir):
    chan = channels(spark, sf_dir)
    tried = {
        "missing": lambda: R.Rules().with_topic_rename("/no", "/x").validate(chan),
        "types": lambda: R.Rules().with_type_rename("std_msgs/msg/String", "n/N").with_type_rename("demo_msgs/msg/Click", "n/N").validate(chan),
        "topics": lambda: R.Rules().with_topic_rename_wildcard("/conv/*", "/one").apply(chan, on_collision="fail"),
        "rule": lambda: R.Rules().with_topic_rename_wildcard("/a", "/b"),
        "fine": lambda: R.Rules().with_topic_rename("/conv/user", "/x").validate(chan),
    }
    return spark.createDataFrame([(k, _kind_of(v)) for k, v in tried.items()], "tried string, kind string")


@query("t14_package_in_text", _values("('new_msgs/Header header\nnew_msgs::Pose p\nold_msgs2/X x')", "text"))
def t14(spark, sf_dir):
    rules = R.Rules().with_type_rename_wildcard("old_msgs/*", "new_msgs/*")
    rows = spark.createDataFrame([("old_msgs/Header header\nold_msgs::Pose p\nold_msgs2/X x",)], "text string")
    return rows.select(rules.schema(F.col("text")).alias("text"))


@query("t16_rename_guards", _values("('deeper', 'invalid_rule'), ('identifier', 'invalid_rule'), ('fine', 'none')", "tried, kind"))
def t16(spark, sf_dir):
    assert issubclass(InvalidRuleError, LogfoldError)
    tried = {"deeper": "demo.msg.x.Event", "identifier": "demo.msg.9", "fine": "demo.msg.Happening"}
    return spark.createDataFrame([(k, _kind_of(lambda v=v: proto.rename(descriptors(), "demo.msg.Event", v))) for k, v in tried.items()], "tried string, kind string")


@query("h11_descriptor", _values("('sensor_msgs/msg/JointState', 3, true, false)", "name, n_fields, has_stamp, has_none"))
def h11(spark, sf_dir):
    s = S.parse("sensor_msgs/msg/JointState", JOINT)
    paths = {p for p, _ in s.paths()}
    return spark.createDataFrame([(s.top.name, len(s.top.fields), "header.stamp.sec" in paths, "header.none" in paths)], "name string, n_fields int, has_stamp boolean, has_none boolean")


@query("x8_parse_time", _values("('1234567890', 1234567890000000000), ('1234567890000000000', 1234567890000000000), ('2023-01-01T00:00:00Z', 1672531200000000000), ('2023-01-01T01:00:00.5+01:00', 1672531200500000000), ('x', null)", "s, ns"))
def x8(spark, sf_dir):
    from ..functions.text import parse_time

    rows = spark.createDataFrame([(s,) for s in ("1234567890", "1234567890000000000", "2023-01-01T00:00:00Z", "2023-01-01T01:00:00.5+01:00", "x")], "s string")
    return rows.select("s", parse_time(F.col("s")).alias("ns"))


@query("x13_maps", "select user_id, count(distinct event_type)::bigint as n_kinds, string_agg(distinct event_type, ',' order by event_type) as kinds from events group by 1")
def x13(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    counts = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return counts.select("user_id", F.size(F.map_keys("m")).cast("bigint").alias("n_kinds"), F.array_join(F.sort_array(F.map_keys("m")), ",").alias("kinds"))


@query("e3_registry", _values("('cdr', true), ('json', true), ('protobuf', true), ('own', true), ('gone', false)", "name, known"))
def e3(spark, sf_dir):
    found = codecs.standard()
    found.register("own", codecs.Codec(lambda rows, *a: rows, lambda rows, *a: rows))
    found.register("gone", found.get("own"))
    found.unregister("gone")
    return spark.createDataFrame([(n, found.has(n)) for n in ("cdr", "json", "protobuf", "own", "gone")], "name string, known boolean")


@query("e4_dynamic_codecs", "select event_id, e as encoding from events, (select unnest(['cdr', 'json', 'protobuf']) as e)")
def e4(spark, sf_dir):
    known, out = codecs.standard(), None
    rows = table(spark, sf_dir, "events").select(F.struct("event_id", "value", "event_type", "user_id", F.array().cast("array<struct<name:string>>").alias("tags")).alias("m"))
    of = {"cdr": ("x/E", "int64 event_id\nfloat64 value"), "json": ("x/E", None), "protobuf": ("demo.msg.Event", descriptors())}
    for name, (kind, schema) in of.items():
        codec = known.get(name)
        back = codec.decode(codec.encode(rows, "m", kind, schema).select("data"), "data", kind, schema)
        key = jsons.value(F.col("message"), "$.event_id", "bigint") if name == "json" else F.col("message.event_id")
        one = back.select(key.alias("event_id"), F.lit(name).alias("encoding"))
        out = one if out is None else out.unionByName(one)
    return out


@query("e6_for_each", "select count(*)::bigint as n, sum(value)::decimal(18, 2)::double as total from events")
def e6(spark, sf_dir):
    from pyspark.accumulators import AccumulatorParam

    class Total(AccumulatorParam):
        def zero(self, value):
            return (0, 0.0)

        def addInPlace(self, a, b):  # noqa: N802
            return (a[0] + b[0], a[1] + b[1])

    seen = spark.sparkContext.accumulator((0, 0.0), Total())
    table(spark, sf_dir, "events").select("value").foreach(lambda r: seen.add((1, r.value)))
    n, total = seen.value
    return spark.createDataFrame([(n, round(total, 2))], "n long, total double")


@query("e7_type_registry", _values("('a/A', 'int32'), ('b/B', 'string')", "name, type"))
def e7(spark, sf_dir):
    types = {n: S.parse(n, t) for n, t in (("a/A", "int32 x"), ("b/B", "string x"))}
    return spark.createDataFrame([(n, S.spell(s.top.fields[0].type)) for n, s in types.items()], "name string, type string")


@query("e8_udtf", """select event_id, strpos(props, '"') - 1 as "offset" from events union all select event_id, strpos(props, '"') + 1 from events""")
def e8(spark, sf_dir):
    tables.register(spark)
    table(spark, sf_dir, "events").createOrReplaceTempView("logfold_events")
    return spark.sql("select event_id, f.offset from logfold_events, lateral find_bytes(cast(props as binary), cast('\"' as binary), 4) f")


@query("e8_udaf", "select user_id, median(value)::double as mid from events group by 1")
def e8_udaf(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(tables.median_udaf()("value").alias("mid"))


@query("c1_inspect_topics", f"with {SQL} select topic, message_type, encoding, count(*)::bigint as n from mess join chan using (channel_id) where contains(lower(topic), 'conv') group by 1, 2, 3")
def c1(spark, sf_dir):
    return cli.run(spark, ["inspect", "topics", recording(spark, sf_dir), "--filter", "CONV"])


@query("c1_extract_per_topic", f"with {SQL} select topic, log_time from mess join chan using (channel_id) qualify row_number() over (partition by topic order by log_time, message_id) <= 2")
def c1_extract(spark, sf_dir):
    target = local(scratch(spark, "per-topic"))
    cli.run(spark, ["extract", "per-topic", recording(spark, sf_dir), target, "-c", "2"])
    return _load(spark, target).select("topic", "log_time")


@query("c2_reader", f"with {SQL} select count(*)::bigint as n, (select count(distinct topic) from chan join mess using (channel_id))::bigint as n_topics from mess")
def c2(spark, sf_dir):
    r = api.Reader(spark, recording(spark, sf_dir))
    return spark.createDataFrame([(r.message_count(), r.channels.where("message_count > 0").select("topic").distinct().count())], "n long, n_topics long")


@query("c3_error_kinds", _values("('encode'), ('format'), ('invalid_rule'), ('not_found'), ('parse'), ('topic_collision'), ('type_collision'), ('type_not_found'), ('unknown_codec'), ('unsupported'), ('buffer_too_short')", "kind"))
def c3(spark, sf_dir):
    return spark.createDataFrame([(e.kind,) for e in LogfoldError.__subclasses__()], "kind string")
