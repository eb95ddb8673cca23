"""Filters, searches and extracts."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..model import SQL, channels, event_messages, messages, table
from ..operators import filters as P
from ..operators import search as S
from .registry import query

_TOPICS = ["/events/click", "/conv/user"]


def _topics(spark, sf_dir):
    return channels(spark, sf_dir).select("channel_id", "topic", "message_type")


@query("f1_include", f"with {SQL} select channel_id, topic from chan where topic in ('/events/click', '/conv/user')")
def f1(spark, sf_dir):
    return _topics(spark, sf_dir).where(P.topic_filter(include=_TOPICS)).select("channel_id", "topic")


@query("f1_exclude", f"with {SQL} select channel_id, topic from chan where topic not in ('/events/click', '/conv/user')")
def f1_exclude(spark, sf_dir):
    return _topics(spark, sf_dir).where(P.topic_filter(exclude=_TOPICS)).select("channel_id", "topic")


@query("f2_regex", f"with {SQL} select topic from chan where regexp_matches(topic, 'ev.*s/[a-m]') and not regexp_matches(topic, 'k$')")
def f2(spark, sf_dir):
    return _topics(spark, sf_dir).where(P.topic_filter(include_regex="ev.*s/[a-m]", exclude_regex="k$")).select("topic")


@query("f3_custom", f"with {SQL} select topic from chan where length(topic) % 2 = 0")
def f3(spark, sf_dir):
    return P.custom_topics(_topics(spark, sf_dir), lambda t: len(t) % 2 == 0).select("topic")


@query("f4_channel_filter", f"with {SQL} select message_id, channel_id from mess where channel_id in (select channel_id from chan where topic like '/conv/%')")
def f4(spark, sf_dir):
    return P.of_channels(messages(spark, sf_dir), _topics(spark, sf_dir).where(F.col("topic").startswith("/conv/"))).select("message_id", "channel_id")


@query("f5_lookup", f"with {SQL} select channel_id, topic from chan where topic = '/events/view'")
def f5(spark, sf_dir):
    return P.channel_by_topic(_topics(spark, sf_dir), "/events/view").select("channel_id", "topic")


@query("f6_topic_contains", f"with {SQL} select topic from chan where contains(lower(topic), lower('EVENTS/C'))")
def f6(spark, sf_dir):
    return _topics(spark, sf_dir).where(P.contains("EVENTS/C", "topic")).select("topic")


@query("f7_type_contains", f"with {SQL} select topic from chan where contains(lower(message_type), 'msg/s')")
def f7(spark, sf_dir):
    return _topics(spark, sf_dir).where(P.contains("MSG/s", "message_type")).select("topic")


@query("f8_topic_or_type", f"with {SQL} select topic from chan where contains(lower(topic), 'string') or contains(lower(message_type), 'string')")
def f8(spark, sf_dir):
    return _topics(spark, sf_dir).where(P.contains("STRING", "topic", "message_type")).select("topic")


@query("f9_contains_case", f"with {SQL} select topic from chan where contains(topic, 'String') or contains(message_type, 'String')")
def f9(spark, sf_dir):
    return _topics(spark, sf_dir).where(P.contains("String", "topic", "message_type", case=True)).select("topic")


@query("f10_standard", f"with {SQL} select topic, message_type from chan where regexp_matches(message_type, '^(sensor_msgs|std_msgs|geometry_msgs|nav_msgs|tf2_msgs|trajectory_msgs|visualization_msgs|diagnostic_msgs|actionlib_msgs)/')")
def f10(spark, sf_dir):
    return _topics(spark, sf_dir).where(P.is_standard()).select("topic", "message_type")


@query("f11_extract_topics", f"with {SQL} select message_id, data::varchar as data from mess where channel_id in (select channel_id from chan where contains(topic, 'sign') or contains(topic, 'system'))")
def f11(spark, sf_dir):
    some = _topics(spark, sf_dir).where(P.contains("sign", "topic", case=True) | P.contains("system", "topic", case=True))
    return P.of_channels(messages(spark, sf_dir), some).select("message_id", F.col("data").cast("string").alias("data"))


@query("f12_time_range", "select event_id, epoch_us(ts) * 1000 as log_time from events where ts between timestamp '2024-01-05' and timestamp '2024-01-12 12:00:00'")
def f12(spark, sf_dir):
    start, end = P.parse_time_range("2024-01-05T00:00:00Z,2024-01-12T12:00:00Z")
    return event_messages(spark, sf_dir).where(P.in_time(start, end)).select(F.col("message_id").alias("event_id"), "log_time")


@query(
    "f13_parse_times",
    """select s, case when regexp_matches(s, '^[0-9]+$') then case when s::bigint < 32503680000 then s::bigint * 1000000000 else s::bigint end else epoch_us(try_cast(s as timestamptz)) * 1000 end as ns
    from (select unnest([event_id::varchar, (epoch_us(ts) * 1000)::varchar, strftime(ts, '%Y-%m-%dT%H:%M:%SZ')]) as s from events)""",
)
def f13(spark, sf_dir):
    some = F.array(F.col("event_id").cast("string"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return table(spark, sf_dir, "events").select(F.explode(some).alias("s")).select("s", X.parse_time(F.col("s")).alias("ns"))


@query("f14_glob", f"with {SQL} select topic from chan where (regexp_matches(topic, '^/ev.*/.i.*$') or regexp_matches(topic, '^/conv/.*r$')) and topic not in ('/conv/user')")
def f14(spark, sf_dir):
    return _topics(spark, sf_dir).where(P.glob_filter(["/ev*/?i*"], ["/conv/.*r"], ["/conv/user"])).select("topic")


@query("f15_frequency", f"with {SQL} select channel_id from mess group by 1 having max(log_time) > min(log_time) and count(*) / ((max(log_time) - min(log_time)) / 1e9) > 0.0007")
def f15(spark, sf_dir):
    per = messages(spark, sf_dir).groupBy("channel_id").agg(F.count("*").alias("n"), (F.max("log_time") - F.min("log_time")).alias("d"))
    return per.where(X.frequency(F.col("n"), F.col("d")) > 0.0007).select("channel_id")


@query(
    "f16_bytes",
    """with p as (select page_id, html, string_split(html, '<p') as parts from pages),
    s as (select page_id, html, list_sum(list_transform(parts[1:i], lambda x: strlen(x)))::bigint + (i - 1) * 2 as "offset" from (select *, unnest(range(1, len(parts))) as i from p))
    select page_id, "offset" from s""",
)
def f16(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("data"))
    return S.find_bytes(pages, "data", "3c 70").select("page_id", "offset")


@query(
    "f17_string",
    """with p as (select doc_id, text, string_split(text, 'the ') as parts from documents),
    s as (select doc_id, text, list_sum(list_transform(parts[1:i], lambda x: length(x)))::bigint + (i - 1) * 4 as "offset" from (select *, unnest(range(1, len(parts))) as i from p))
    select doc_id, "offset", substr(text, greatest("offset" - 32, 0) + 1, "offset" - greatest("offset" - 32, 0) + 36) as context from s""",
)
def f17(spark, sf_dir):
    return S.find_string(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "the ").select("doc_id", "offset", "context")


@query("f18_value", "select event_id, cast(json_extract(props, '$.k') as bigint) as value from events where cast(json_extract(props, '$.k') as bigint) = 7")
def f18(spark, sf_dir):
    return S.find_value(table(spark, sf_dir, "events"), "props", "$.k", "bigint", 7).select("event_id", "value")


@query("f19_unknown_channels", f"with {SQL} select count(*)::bigint as n from mess where channel_id in (select channel_id from chan where channel_id % 2 = 0)")
def f19(spark, sf_dir):
    known = _topics(spark, sf_dir).where("channel_id % 2 = 0")
    return P.of_channels(messages(spark, sf_dir), known).agg(F.count("*").alias("n"))


@query("f20_comment_lines", "select doc_id, count(*)::bigint as n from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where trim(split_part(line, '#', 1)) <> '' and not contains(split_part(line, '#', 1), '=') group by 1")
def f20(spark, sf_dir):
    line = F.substring_index("line", "#", 1)
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where((F.trim(line) != "") & ~line.contains("=")).groupBy("doc_id").agg(F.count("*").alias("n"))
