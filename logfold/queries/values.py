"""Scalar functions: formatting, parsing, value predicates and casts."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..model import SQL, channels, event_messages, table
from .registry import query


@query("x1_strings", "select c_custkey, lower(c_name) as low, contains(c_mktsegment, 'IL') as has, starts_with(c_name, 'Customer') as starts, ends_with(c_name, '1') as ends, trim(' ' || c_mktsegment || ' ') as trimmed, string_split(c_name, '#')[2] as part from customer")
def x1(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.lower(name).alias("low"), F.col("c_mktsegment").contains("IL").alias("has"), name.startswith("Customer").alias("starts"), name.endswith("1").alias("ends"), F.trim(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).alias("trimmed"), F.get(F.split(name, "#"), F.lit(1)).alias("part"))


@query("x2_lines", "select doc_id, len(string_split(text, chr(10)))::bigint as n_lines, array_to_string(string_split(text, chr(10))[1:2], chr(10)) as head from documents")
def x2(spark, sf_dir):
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), F.array_join(F.slice(lines, 1, 2), "\n").alias("head"))


@query("x3_regex", "select page_id, regexp_matches(url, '^https?://(www|m)\\.') as known, regexp_replace(url, '^(https?)://(.*)$', '\\2 by \\1') as turned from pages")
def x3(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").rlike(r"^https?://(www|m)\.").alias("known"), F.regexp_replace("url", "^(https?)://(.*)$", "$2 by $1").alias("turned"))


@query("x4_hex", "select event_id, hex(props::blob) as h, decode(unhex(hex(props::blob))) as back from events")
def x4(spark, sf_dir):
    h = F.hex(F.col("props").cast("binary"))
    return table(spark, sf_dir, "events").select("event_id", h.alias("h"), F.unhex(h).cast("string").alias("back"))


@query("x5_base64", "select event_id, base64(props::blob) as b from events")
def x5(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.base64(F.col("props").cast("binary")).alias("b"))


@query(
    "x6_format_duration",
    """with d as (select event_id, event_id * 7919 * 1000003 as ns from events), p as (select event_id, ns, ns // 1000000000 as s, ns % 1000000000 // 1000000 as ms from d)
    select event_id, case when s >= 3600 then (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' when s >= 60 then (s // 60) || 'm ' || (s % 60) || 's'
      when s > 0 then s || '.' || lpad(ms::varchar, 3, '0') || 's' else ms || 'ms' end as shown from p""",
)
def x6(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.format_duration(F.col("event_id") * 7919 * 1000003).alias("shown"))


@query("x7_format_time", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' as shown from events")
def x7(spark, sf_dir):
    return event_messages(spark, sf_dir).select(F.col("message_id").alias("event_id"), X.format_time(F.col("log_time")).alias("shown"))


@query(
    "x9_human_size",
    """with d as (select o_orderkey, (o_orderkey * o_orderkey * 977)::double as x from orders)
    select o_orderkey, case when x < 1024 then printf('%.2f B', x) when x < 1048576 then printf('%.2f KB', x / 1024) when x < 1073741824 then printf('%.2f MB', x / 1048576)
      when x < 1099511627776 then printf('%.2f GB', x / 1073741824) else printf('%.2f TB', x / 1099511627776) end as shown from d""",
)
def x9(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.human_size(F.col("o_orderkey") * F.col("o_orderkey") * 977).alias("shown"))


def _fixed(x: str, digits: int) -> str:
    """SQL of a number with a fixed count of digits; ties of its shortest decimal form go away from zero."""
    return f"cast(round(cast(cast({x} as varchar) as decimal(38, 12)), {digits}) as decimal(38, {digits}))::varchar"


@query(
    "x10_human_duration",
    f"""with d as (select event_id, (event_id * event_id * 12340625)::bigint as ns from events), p as (select *, ns / 1e9 as s from d)
    select event_id, case when ns = 0 then 'N/A' when s < 1 then {_fixed("s * 1000", 2)} || ' ms' when s < 60 then {_fixed("s", 2)} || ' seconds'
      when s < 3600 then {_fixed("s / 60", 2)} || ' minutes (' || {_fixed("s", 0)} || 's)' else {_fixed("s / 3600", 2)} || ' hours (' || {_fixed("s", 0)} || 's)' end as shown from p""",
)
def x10(spark, sf_dir):
    # With ties at two digits. From event 864 523 on a product is beyond a long, where the SQL stops.
    ns = F.expr("cast(event_id as decimal(19, 0)) * event_id * 12340625")
    return table(spark, sf_dir, "events").select("event_id", X.human_duration(ns).alias("shown"))


@query("x11_names", f"with {SQL} select topic, message_type, split_part(message_type, '/', 1) as package, split_part(message_type, '/', -1) as name from chan")
def x11(spark, sf_dir):
    return channels(spark, sf_dir).select("topic", "message_type", X.package_of(F.col("message_type")).alias("package"), X.message_name_of(F.col("message_type")).alias("name"))


@query("x12_checksums", "select doc_id, md5(text) as digest, sha256(text) as sha from documents")
def x12(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.sha2("text", 256).alias("sha"))


@query("d13_detect_encoding", "select event_type, case when contains(event_type, 'c') then 'cdr' when contains(event_type, 'v') then 'json' else 'cdr' end as encoding from (select distinct event_type from events)")
def d13(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    stated = F.when(F.col("event_type").contains("c"), "ROS2-cdr").when(F.col("event_type").contains("v"), "x").otherwise("")
    of_schema = F.when(F.col("event_type").contains("v"), "JSONschema").otherwise("ros2msg")
    return kinds.select("event_type", X.detect_encoding(stated, of_schema).alias("encoding"))


@query("d14_parse_encoding", "select e, case when e in ('cdr', 'protobuf', 'json') then e end as strict, case when e in ('cdr', 'ros1', 'ros2') then 'cdr' when e in ('protobuf', 'proto', 'pb') then 'protobuf' when e = 'json' then 'json' end as lenient from (select unnest(['cdr', 'protobuf', 'json', 'ros1', 'ros2', 'proto', 'pb', 'x']) as e)")
def d14(spark, sf_dir):
    names = spark.createDataFrame([(e,) for e in ("cdr", "protobuf", "json", "ros1", "ros2", "proto", "pb", "x")], "e string")
    return names.select("e", X.parse_encoding(F.col("e")).alias("strict"), X.parse_encoding(F.col("e"), lenient=True).alias("lenient"))


@query("d18_times", "select event_id, epoch_us(ts) // 1000000 as sec, (epoch_us(ts) % 1000000) * 1000 as nanosec, epoch_us(ts) * 1000 as ns from events")
def d18(spark, sf_dir):
    ns = F.col("log_time")
    parts = event_messages(spark, sf_dir).select(F.col("message_id").alias("event_id"), X.whole(ns, 10**9).alias("sec"), F.pmod(ns, F.lit(10**9)).alias("nanosec"))
    return parts.select("*", (F.col("sec") * 1_000_000_000 + F.col("nanosec")).alias("ns"))


@query("d20_projection", f"with {SQL} select topic, message_type, count(*)::bigint as n from chan join mess using (channel_id) group by 1, 2")
def d20(spark, sf_dir):
    from ..model import messages

    per = messages(spark, sf_dir).groupBy("channel_id").agg(F.count("*").alias("n"))
    return per.join(F.broadcast(channels(spark, sf_dir)), "channel_id").select("topic", "message_type", "n")


@query("d21_payload", "select doc_id, strlen(text)::bigint as n, strlen(text) = 0 as is_empty, (doc_id * 1000 < doc_id * 1000 + strlen(text) and doc_id * 1000 + strlen(text) <= 500000) as fits from documents")
def d21(spark, sf_dir):
    start, n = F.col("doc_id") * 1000, F.octet_length("text").cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), (n == 0).alias("is_empty"), ((start < start + n) & (start + n <= 500000)).alias("fits"))
