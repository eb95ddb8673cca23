"""Joins, set operations and rename rules."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import SQL, channels, event_messages, messages, table
from ..operators import rename as R
from ..operators import timesync as S
from .registry import query


def _chan(spark, sf_dir):
    return channels(spark, sf_dir)


@query("j1_message_channel", f"with {SQL} select message_id, topic, encoding from mess join chan using (channel_id)")
def j1(spark, sf_dir):
    return messages(spark, sf_dir).join(F.broadcast(_chan(spark, sf_dir)), "channel_id").select("message_id", "topic", "encoding")


@query("j2_channel_schema", f"with {SQL}, s as (select distinct message_type, schema from chan where schema is not null and message_type <> 'demo_msgs/msg/View') select topic, coalesce(s.schema, '') as schema_text from chan left join s using (message_type)")
def j2(spark, sf_dir):
    chan = _chan(spark, sf_dir)
    schemas = chan.where("schema is not null and message_type <> 'demo_msgs/msg/View'").select("message_type", F.col("schema").alias("text")).distinct()
    return chan.join(F.broadcast(schemas), "message_type", "left").select("topic", F.coalesce("text", F.lit("")).alias("schema_text"))


@query("j3_connection_map", f"with {SQL}, conn as (select channel_id as conn_id, dense_rank() over (order by topic desc) - 1 as dense from chan where channel_id % 3 <> 0) select message_id, dense from mess join conn on mess.channel_id = conn.conn_id")
def j3(spark, sf_dir):
    conn = _chan(spark, sf_dir).where("channel_id % 3 <> 0").select(F.col("channel_id").alias("conn_id"), (F.dense_rank().over(Window.orderBy(F.desc("topic"))) - 1).cast("bigint").alias("dense"))
    facts = messages(spark, sf_dir)
    return facts.join(F.broadcast(conn), facts["channel_id"] == conn["conn_id"]).select("message_id", "dense")


@query("j4_new_channel", f"with {SQL}, moved as (select channel_id, channel_id + 100 as new_id from chan where encoding = 'json') select message_id, coalesce(new_id, channel_id) as channel_id from mess left join moved using (channel_id)")
def j4(spark, sf_dir):
    moved = _chan(spark, sf_dir).where("encoding = 'json'").select("channel_id", (F.col("channel_id") + 100).alias("new_id"))
    return messages(spark, sf_dir).join(F.broadcast(moved), "channel_id", "left").select("message_id", F.coalesce("new_id", "channel_id").alias("channel_id"))


_RULES = (
    R.Rules()
    .with_topic_rename("/events/click", "/ui/click")
    .with_topic_rename_wildcard("/events/*", "/log/*/raw")
    .with_topic_rename_wildcard("/*", "/all/*")
    .with_topic_rename_wildcard("/conv/*", "/chat/*")
    .with_type_rename("std_msgs/msg/String", "text_msgs/msg/Text")
    .with_type_rename_wildcard("demo_msgs/msg/*", "shop_msgs/msg/*")
    .with_type_rename_wildcard("demo_msgs/*", "other_msgs/*")
    .with_topic_type_rename("/conv/system", "std_msgs/msg/String", "text_msgs/msg/Prompt")
)
_TOPIC = "case when topic = '/events/click' then '/ui/click' when topic like '/events/%' then '/log/' || substr(topic, 9) || '/raw' when topic like '/conv/%' then '/chat/' || substr(topic, 7) else '/all/' || substr(topic, 2) end"
_TYPE = "case when topic = '/conv/system' then 'text_msgs/msg/Prompt' when message_type = 'std_msgs/msg/String' then 'text_msgs/msg/Text' when message_type like 'demo/_msgs/msg/%' escape '/' then message_type end"


@query("j5_exact_rename", f"with {SQL} select channel_id, case when topic = '/events/click' then '/ui/click' else topic end as topic from chan")
def j5(spark, sf_dir):
    rules = R.Rules().with_topic_rename("/events/click", "/ui/click")
    return _chan(spark, sf_dir).select("channel_id", rules.topic(F.col("topic")).alias("topic"))


@query("t4_topic_rename", f"with {SQL} select channel_id, {_TOPIC} as topic from chan")
def t4(spark, sf_dir):
    return _chan(spark, sf_dir).select("channel_id", _RULES.topic(F.col("topic")).alias("topic"))


@query(
    "t5_type_rename",
    f"""with {SQL} select channel_id, case when message_type = 'std_msgs/msg/String' then 'text_msgs/msg/Text' when starts_with(message_type, 'demo_msgs/msg/') then 'shop_msgs/msg/' || substr(message_type, 15)
      when starts_with(message_type, 'demo_msgs/') then 'other_msgs/' || substr(message_type, 11) else message_type end as message_type from chan""",
)
def t5(spark, sf_dir):
    return _chan(spark, sf_dir).select("channel_id", _RULES.type(F.col("message_type")).alias("message_type"))


@query(
    "t7_topic_type_rename",
    f"""with {SQL} select topic, case when topic = '/conv/system' then 'text_msgs/msg/Prompt' when message_type = 'std_msgs/msg/String' then 'text_msgs/msg/Text'
      when starts_with(message_type, 'demo_msgs/msg/') then 'shop_msgs/msg/' || substr(message_type, 15) when starts_with(message_type, 'demo_msgs/') then 'other_msgs/' || substr(message_type, 11) else message_type end as message_type from chan""",
)
def t7(spark, sf_dir):
    return _chan(spark, sf_dir).select("topic", _RULES.type(F.col("message_type"), F.col("topic")).alias("message_type"))


@query("t3_pipeline", f"with {SQL} select channel_id, {_TOPIC} as topic, schema from chan")
def t3(spark, sf_dir):
    return _RULES.apply(_chan(spark, sf_dir)).select("channel_id", "topic", "schema")


@query("j8_missing_sources", "select * from (values ('topic', '/nowhere'), ('type', 'no/Type')) v(kind, source)")
def j8(spark, sf_dir):
    rules = R.Rules().with_topic_rename("/nowhere", "/x").with_topic_rename("/conv/user", "/y").with_type_rename("no/Type", "z").with_type_rename("std_msgs/msg/String", "w")
    return rules.missing(_chan(spark, sf_dir))


@query("j9_target_exists", f"with {SQL} select distinct message_type from chan where message_type in ('std_msgs/msg/String', 'x/Y') and message_type not in ('demo_msgs/Embedding')")
def j9(spark, sf_dir):
    targets = spark.createDataFrame([("std_msgs/msg/String",), ("x/Y",)], "message_type string")
    return _chan(spark, sf_dir).join(F.broadcast(targets), "message_type", "left_semi").where("message_type <> 'demo_msgs/Embedding'").select("message_type").distinct()


@query("a16_type_collisions", "select 'all/Type' as target, 2::bigint as n_schemas")
def a16(spark, sf_dir):
    rules = R.Rules().with_type_rename("std_msgs/msg/String", "all/Type").with_type_rename("demo_msgs/msg/Click", "all/Type")
    return rules.collisions(_chan(spark, sf_dir))


@query("j13_topic_collisions", f"with {SQL}, m as (select channel_id, case when topic like '/conv/%' then '/said' else topic end as topic from chan), n as (select *, row_number() over (partition by topic order by channel_id) - 1 as n from m) select channel_id, case when n > 0 then topic || '_' || n else topic end as topic from n")
def j13(spark, sf_dir):
    rules = R.Rules().with_topic_rename_wildcard("/conv/*", "/said")
    return rules.apply(_chan(spark, sf_dir)).select("channel_id", "topic")


@query(
    "j10_schema_diff",
    """with a as (select p_type as name, count(*)::bigint as n from part where p_partkey % 2 = 0 group by 1), b as (select p_type as name, count(*)::bigint as n from part where p_partkey % 3 = 0 group by 1)
    select name, case when a.n is null then 'added' when b.n is null then 'removed' when a.n <> b.n then 'modified' else 'same' end as status from a full join b using (name)""",
)
def j10(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    side = lambda k, c: part.where(F.col("p_partkey") % k == 0).groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias(c))
    both = side(2, "a").join(side(3, "b"), "name", "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified").otherwise("same")
    return both.select("name", status.alias("status"))


@query(
    "j11_line_diff",
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
    a as (select * from l where doc_id % 2 = 0), b as (select doc_id - 1 as doc_id, line, pos from l where doc_id % 2 = 1)
    select doc_id, pos, a.line as old, b.line as new from a full join b using (doc_id, pos) where a.line is distinct from b.line""",
)
def j11(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    old = lines.where("doc_id % 2 = 0").select("doc_id", "pos", F.col("line").alias("old"))
    new = lines.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), "pos", F.col("line").alias("new"))
    return old.join(new, ["doc_id", "pos"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "old", "new")


@query(
    "j14_as_of",
    """with l as (select event_id, user_id, epoch_us(ts) * 1000 as log_time from events where event_type = 'purchase'), r as (select user_id, epoch_us(ts) * 1000 as t, value from events where event_type = 'view'),
    p as (select event_id, user_id, log_time, (select max({'t': r.t, 'v': r.value}) from r where r.user_id = l.user_id and r.t <= l.log_time) as m from l)
    select event_id, user_id, log_time, coalesce(m.t, -1) as matched_time, m.v as value from p""",
)
def j14(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("log_time", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    found = S.as_of(events.where("event_type = 'purchase'"), events.where("event_type = 'view'"), "user_id", "log_time", "value", "event_id")
    return found.withColumn("matched_time", F.coalesce("matched_time", F.lit(-1)))


@query("j15_fact_dimensions", "select n_name, count(*)::bigint as n, sum(l_extendedprice)::decimal(18, 2)::double as total from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def j15(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    per = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"))
    joined = per.join(people, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("n_name").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(18,2)").cast("double").alias("total"))


@query("k9_features", "select (epoch_us(ts) // 1000000) * 10 // 600000 as frame, max(value) filter (event_type = 'click') as click, max(value) filter (event_type = 'view') as view from (select *, row_number() over (partition by event_type, (epoch_us(ts) // 1000000) * 10 // 600000 order by ts desc, value desc) as n from events) where n = 1 and event_type in ('click', 'view') group by 1")
def k9(spark, sf_dir):
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    # A frame of 16 hours 40 minutes: the recording is months long.
    frame = X.whole(X.whole(F.unix_micros(F.col("ts").cast("timestamp")), 10**6) * 10, 600_000)
    frames = events.groupBy("event_type", frame.alias("frame")).agg(F.max_by("value", F.struct("ts", "value")).alias("value"))
    return S.features(frames, "event_type", "value", ["click", "view"])


@query("u1_union", "select distinct x from (select p_type as x from part union select p_brand from part)")
def u1(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_type").alias("x")).union(part.select("p_brand")).distinct()


@query("u2_except", "select p_type as x from part where p_size < 10 except select p_type from part where p_size > 45")
def u2(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where("p_size < 10").select(F.col("p_type").alias("x")).subtract(part.where("p_size > 45").select("p_type"))


@query("u3_intersect", "select p_type as x from part where p_size < 10 intersect select p_type from part where p_size > 45")
def u3(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where("p_size < 10").select(F.col("p_type").alias("x")).intersect(part.where("p_size > 45").select("p_type"))


@query("u4_concat", "select event_id, 1 as part from events where event_id % 2 = 0 union all select event_id, 2 from events where event_id % 3 = 0")
def u4(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return e.where("event_id % 2 = 0").withColumn("part", F.lit(1)).unionByName(e.where("event_id % 3 = 0").withColumn("part", F.lit(2)))


@query("u5_dedup", f"with {SQL} select message_type, encoding from (select distinct message_type, encoding from chan) union all select x, 'builtin' from (values ('builtin_interfaces/Time'), ('std_msgs/msg/String')) b(x) where x not in (select message_type from chan)")
def u5(spark, sf_dir):
    have = _chan(spark, sf_dir).select("message_type", "encoding").dropDuplicates()
    builtin = spark.createDataFrame([("builtin_interfaces/Time", "builtin"), ("std_msgs/msg/String", "builtin")], "message_type string, encoding string")
    return have.unionByName(builtin.join(have, "message_type", "left_anti"))


@query("t8_type_spellings", f"with {SQL} select topic, message_type, replace(message_type, '/', '.') as proto, case when contains(message_type, '/msg/') then 'ros2' else 'ros1' end as spelling, message_type as ros1 from chan")
def t8(spark, sf_dir):
    kind = F.col("message_type")
    return _chan(spark, sf_dir).select("topic", kind, X.convert_type_name(kind, "proto").alias("proto"), X.type_spelling(kind).alias("spelling"), X.convert_type_name(kind, "ros1").alias("ros1"))


@query("t6_schema_rewrite", "select topic, replace(s, 'std_msgs/Header', 'base_msgs/Header') as schema from (select distinct '/e/' || event_type as topic, 'std_msgs/Header header' || chr(10) || 'string ' || event_type as s from events)")
def t6(spark, sf_dir):
    rules = R.Rules().with_type_rename("std_msgs/Header", "base_msgs/Header")
    rows = table(spark, sf_dir, "events").select("event_type").distinct().select(F.concat(F.lit("/e/"), "event_type").alias("topic"), F.concat(F.lit("std_msgs/Header header\nstring "), "event_type").alias("s"))
    return rows.select("topic", rules.schema(F.col("s")).alias("schema"))


@query("t9_preset", "select * from (values ('genie_msgs/msg/HeadState', 'own.msg.HeadState'), ('upperlimb/Pose', 'own.msg.EndEffectorPose'), ('std_msgs/Header', 'std_msgs/Header')) v(message_type, renamed)")
def t9(spark, sf_dir):
    rows = spark.createDataFrame([("genie_msgs/msg/HeadState",), ("upperlimb/Pose",), ("std_msgs/Header",)], "message_type string")
    return rows.select("message_type", R.preset("full", "own").type(F.col("message_type")).alias("renamed"))


@query("w5_collision_suffix", f"with {SQL} select channel_id, row_number() over (partition by encoding order by channel_id) - 1 as n from chan")
def w5(spark, sf_dir):
    return _chan(spark, sf_dir).select("channel_id", (F.row_number().over(Window.partitionBy("encoding").orderBy("channel_id")) - 1).cast("bigint").alias("n"))


@query("g2_micro_batches", "select (epoch_us(ts) // 86400000000)::bigint as day, count(*)::bigint as n, min(epoch_us(ts))::bigint * 1000 as first_time, max(epoch_us(ts))::bigint * 1000 as last_time from events group by 1")
def g2(spark, sf_dir):
    rows = event_messages(spark, sf_dir).withColumn("day", X.whole(F.col("log_time"), 86_400_000_000_000))
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.min("log_time").alias("first_time"), F.max("log_time").alias("last_time"))
