"""Codecs: round trips and schema-less readings of payloads made of the tables."""

import hashlib
from decimal import Decimal

from pyspark.sql import functions as F

from .. import api
from ..codecs import cdr, jsons, proto
from ..model import nanos, table
from ..operators import rewrite as W
from ..operators.rename import Rules
from ..plans import schema as S
from ..sources import datasource
from ..storage import local, scratch
from .registry import query

EVENT = S.parse("demo_msgs/msg/Event", "int64 event_id\nfloat64 value\nstring event_type\nint64 user_id")
FLAT = S.parse("demo_msgs/msg/Flat", "bool late\nint32 day\nint64 event_id\nfloat64 value\nuint64 big")
VECTOR = S.parse("demo_msgs/msg/Vector", "int64 vec_id\nfloat32[] values\nint32 label")
TURN = S.parse("demo_msgs/msg/Turn", "std_msgs/Header header\nSaid[] said\n===\nMSG: demo_msgs/Said\nstring role\nstring text\nuint8[] raw")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "value", "event_type", "user_id")


@query("d3_cdr_round_trip", "select event_id, value, event_type, user_id from events")
def d3(spark, sf_dir):
    data = cdr.encode(_events(spark, sf_dir), ["event_id", "value", "event_type", "user_id"], EVENT).select("data")
    return cdr.decode(data, "data", EVENT).select("message.*")


@query("d3b_fixed_layout", "select event_id % 2 = 0 as late, (event_id % 31)::int as day, event_id, value, 18446744073709551615::decimal(20, 0)::varchar as big from events")
def d3b(spark, sf_dir):
    flat = table(spark, sf_dir, "events").select((F.col("event_id") % 2 == 0).alias("late"), (F.col("event_id") % 31).cast("int").alias("day"), "event_id", "value", F.lit(Decimal(2**64 - 1)).cast("decimal(20,0)").alias("big"))
    data = cdr.encode(flat, flat.columns, FLAT).select("data")
    out = cdr.decode(data, "data", FLAT).select("message.*")
    return out.withColumn("big", F.col("big").cast("string"))


@query("d3c_framings", "select conv_id, turn, f as framing, coalesce(role, '') as role, coalesce(text, '') as text from conversations, (select unnest(['cdr', 'headerless', 'ros1', 'ros1_16']) as f)")
def d3c(spark, sf_dir):
    said = table(spark, sf_dir, "conversations")
    value = F.struct(F.struct(F.struct(F.lit(1).alias("sec"), F.lit(2).cast("long").alias("nanosec")).alias("stamp"), F.lit("map").alias("frame_id")).alias("header"), F.array(F.struct("role", "text", F.col("text").cast("binary").alias("raw"))).alias("said"))
    out = None
    for framing in ("cdr", "headerless", "ros1", "ros1_16"):
        data = cdr.encode(said.withColumn("v", value), "v", TURN, framing).select("conv_id", "turn", "data")
        one = cdr.decode(data, "data", TURN, framing).select("conv_id", "turn", F.lit(framing).alias("framing"), F.col("message.said")[0]["role"].alias("role"), F.col("message.said")[0]["text"].alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


@query("d3d_arrays", "select vec_id, len(embedding)::bigint as n, label from embeddings where list_position(embedding, embedding[1]) = 1")
def d3d(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("values"), "label")
    back = cdr.decode(cdr.encode(rows, ["vec_id", "values", "label"], VECTOR, kind="cdr2_be"), "data", VECTOR)
    same = back.where(F.col("message.values") == F.col("values"))
    return same.select("message.vec_id", F.size("message.values").cast("bigint").alias("n"), "message.label")


@query("d3e_errors", "select event_id % 2 = 0 as ok, count(*)::bigint as n from events group by 1")
def d3e(spark, sf_dir):
    data = cdr.encode(_events(spark, sf_dir), ["event_id", "value", "event_type", "user_id"], EVENT)
    broken = data.withColumn("data", F.when(F.col("event_id") % 2 == 0, F.col("data")).otherwise(F.substring("data", 1, 17)))
    read = cdr.decode(broken, "data", EVENT, on_error="null")
    return read.groupBy(F.col("message").isNotNull().alias("ok")).agg(F.count("*").alias("n"))


@query("d8_encoded_size", "select event_id, (4 + 16 + 4 + strlen(event_type) + 1 + (8 - (16 + 4 + strlen(event_type) + 1) % 8) % 8 + 8)::bigint as size from events")
def d8(spark, sf_dir):
    data = cdr.encode(_events(spark, sf_dir), ["event_id", "value", "event_type", "user_id"], EVENT)
    return data.select("event_id", F.length("data").cast("bigint").alias("size"))


@query("d11_size", "select event_type, (16 + 4 + strlen(event_type) + 1 + (8 - (16 + 4 + strlen(event_type) + 1) % 8) % 8 + 8)::bigint as size from (select distinct event_type from events)")
def d11(spark, sf_dir):
    kinds = [r.event_type for r in table(spark, sf_dir, "events").select("event_type").distinct().collect()]
    sizes = [(k, cdr.Size().primitive("int64").primitive("float64").string(len(k.encode())).primitive("int64").size) for k in kinds]
    return spark.createDataFrame(sizes, "event_type string, size long")


@query("d9_coercion", "select event_id, try_cast(event_id as tinyint)::int as small, try_cast(event_id as smallint)::int as mid, event_id::double as wide, try_cast(event_id - 100 as utinyint)::int as u from events")
def d9(spark, sf_dir):
    n = F.col("event_id")
    u = F.when((n - 100 >= 0) & (n - 100 <= 255), (n - 100).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", n.try_cast("tinyint").cast("int").alias("small"), n.try_cast("smallint").cast("int").alias("mid"), n.cast("double").alias("wide"), u.alias("u"))


@query("d10_typed_arrays", "select 1::bigint as vec_id, '1,-2,300' as scaled")
def d10(spark, sf_dir):
    kinds = S.parse("demo_msgs/msg/Arrays", "int64 vec_id\nint32[3] scaled\nuint8[] raw\nint8[] small\nuint32[] wide\nfloat64[] reals")
    rows = spark.sql("select 1L as vec_id, array(1, -2, 300) as scaled, cast('ab' as binary) as raw, array(1Y, -2Y) as small, array(4294967295L) as wide, array(0.5D, -1.0D) as reals")
    back = cdr.decode(cdr.encode(rows, rows.columns, kinds), "data", kinds)
    return back.where("message.raw = raw and message.small = small and message.wide = wide and message.reals = reals").select("message.vec_id", F.array_join("message.scaled", ",").alias("scaled"))


def descriptors() -> bytes:
    from google.protobuf import descriptor_pb2

    files = descriptor_pb2.FileDescriptorSet()
    f = files.file.add(name="event.proto", package="demo.msg", syntax="proto3")
    kinds = descriptor_pb2.FieldDescriptorProto
    tag = f.message_type.add(name="Tag")
    tag.field.add(name="name", number=1, type=kinds.TYPE_STRING, label=kinds.LABEL_OPTIONAL)
    event = f.message_type.add(name="Event")
    for i, (name, kind) in enumerate((("event_id", kinds.TYPE_INT64), ("value", kinds.TYPE_DOUBLE), ("event_type", kinds.TYPE_STRING), ("user_id", kinds.TYPE_SINT64))):
        event.field.add(name=name, number=i + 1, type=kind, label=kinds.LABEL_OPTIONAL)
    event.field.add(name="tags", number=5, type=kinds.TYPE_MESSAGE, type_name=".demo.msg.Tag", label=kinds.LABEL_REPEATED)
    return files.SerializeToString()


def _payloads(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("m", F.struct("event_id", "value", "event_type", "user_id", F.array(F.struct(F.col("event_type").alias("name"))).alias("tags")))
    return proto.encode(rows, "m", descriptors(), "demo.msg.Event")


@query("d5_protobuf", "select event_id, value, event_type, user_id, event_type as tag from events")
def d5(spark, sf_dir):
    return proto.decode(_payloads(spark, sf_dir).select("data"), "data", descriptors(), "demo.msg.Event").select("message.event_id", "message.value", "message.event_type", "message.user_id", F.col("message.tags")[0]["name"].alias("tag"))


@query("d4_protobuf_wire", "select nullif(event_id, 0) as event_id, event_type, nullif((case when user_id >= 0 then 2 * user_id else -2 * user_id - 1 end)::bigint, 0) as zigzag from events")
def d4(spark, sf_dir):
    data = _payloads(spark, sf_dir).select("data")  # fields that are 0 are not on the wire
    read = proto.wire_json(data, "data").select(F.parse_json("message").alias("v"))
    return read.select(F.variant_get("v", "$['1']", "bigint").alias("event_id"), F.variant_get("v", "$['3']", "string").alias("event_type"), F.variant_get("v", "$['4']", "bigint").alias("zigzag"))


@query("t15_protobuf_rename", "select event_id, event_type from events")
def t15(spark, sf_dir):
    moved = proto.rename(proto.rename(descriptors(), "demo.msg", "own.msg"), "own.msg.Event", "own.msg.Happening")
    return proto.decode(_payloads(spark, sf_dir).select("data"), "data", moved, "own.msg.Happening").select("message.event_id", "message.event_type")


@query("d6_json_decode", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def d6(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", jsons.value(jsons.decode(F.col("props").cast("binary")), "$.k", "bigint").alias("k"))


@query("d6b_json_roots", """select * from (values ('5', 'int64', 5), ('"x"', 'string', null), ('null', null, null), ('{"value": 7}', 'int64', 7), ('[1]', 'array', null), ('1.5', 'float64', null), ('true', 'bool', null)) v(t, kind, n)""")
def d6b(spark, sf_dir):
    rows = spark.createDataFrame([(t,) for t in ("5", '"x"', "null", '{"value": 7}', "[1]", "1.5", "true")], "t string")
    v = jsons.decode(F.col("t"))
    return rows.select("t", jsons.type_name(v, "$.value").alias("kind"), F.when(jsons.type_name(v, "$.value") == "int64", jsons.value(v, "$.value", "int")).alias("n"))


@query("d7_json_encode", """select event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' as j from events""")
def d7(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", jsons.encode(F.struct("event_id", "event_type")).alias("j"))


@query("d15_predicates", "select kind, kind in ('int32', 'uint8', 'float64') as is_numeric, kind in ('int32', 'uint8') as is_integer, kind = 'int32' as is_signed, kind = 'uint8' as is_unsigned, kind = 'float64' as is_float, kind = 'timestamp' as is_temporal, kind in ('array', 'struct') as is_container from (select unnest(['int32', 'uint8', 'float64', 'timestamp', 'array', 'struct', 'string', 'null']) as kind)")
def d15(spark, sf_dir):
    kinds = spark.createDataFrame([(k,) for k in ("int32", "uint8", "float64", "timestamp", "array", "struct", "string", "null")], "kind string")
    k = F.col("kind")
    return kinds.select("kind", *(getattr(jsons, n)(k).alias(n) for n in ("is_numeric", "is_integer", "is_signed", "is_unsigned", "is_float", "is_temporal", "is_container")))


@query("d16_casts", "select event_id, cast(json_extract(props, '$.k') as double) as as_f64, cast(json_extract(props, '$.k') as varchar) as as_text, null::bigint as missing from events")
def d16(spark, sf_dir):
    v = jsons.decode(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", jsons.value(v, "$.k", "double").alias("as_f64"), jsons.value(v, "$.k", "string").alias("as_text"), jsons.value(v, "$.none", "bigint").alias("missing"))


@query("d17_type_names", "select event_id, 'int64' as kind, strlen(props)::bigint as hint from events")
def d17(spark, sf_dir):
    v = jsons.decode(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", jsons.type_name(v, "$.k").alias("kind"), F.octet_length("props").cast("bigint").alias("hint"))


def _lossless(spark, sf_dir) -> str:
    """Events as protobuf and as JSON, with the pages' urls as attachments, rewritten into another container under a renamed type."""
    datasource.register(spark)
    source, target = local(scratch(spark, "mixed")), local(scratch(spark, "converted"))
    time = nanos(F.col("ts"))
    rows = _payloads(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    binary = rows.select(F.lit("/proto").alias("topic"), F.lit("demo.msg.Event").alias("message_type"), F.lit("protobuf").alias("encoding"), F.lit(None).cast("string").alias("schema"), F.lit("protobuf").alias("schema_encoding"), F.lit(descriptors()).alias("schema_data"), time.alias("log_time"), "data")
    plain = table(spark, sf_dir, "events").select(F.lit("/json").alias("topic"), F.lit("demo.Props").alias("message_type"), F.lit("json").alias("encoding"), F.lit('{"type": "object"}').alias("schema"), F.lit("jsonschema").alias("schema_encoding"), F.lit(None).cast("binary").alias("schema_data"), time.alias("log_time"), F.col("props").cast("binary").alias("data"))
    both = binary.unionByName(plain).withColumns({"channel_id": F.lit(None).cast("int"), "sequence": F.lit(None).cast("long")})
    W.write(both, source, "mcap")
    attached = table(spark, sf_dir, "pages").select(F.col("url").alias("name"), F.lit("text/html").alias("media_type"), F.col("page_id").alias("log_time"), F.col("html").cast("binary").alias("data"))
    attached.write.format("logfold").mode("append").options(format="mcap", table="attachments").save(source)
    W.rewrite(spark, source, target, Rules().with_type_rename("demo.msg.Event", "demo.msg.Happening"), validate=False, recode=False)
    return target


@query(
    "t20_convert_lossless",
    f"""select '/json' as topic, 'demo.Props' as message_type, md5('{{"type": "object"}}') as schema_md5, count(*)::bigint as n, bit_xor(hash_of)::bigint as payloads from (select ('0x' || substr(md5(props), 1, 15))::bigint as hash_of from events)
    union all select '/proto', 'demo.msg.Happening', '{hashlib.md5(proto.rename(descriptors(), "demo.msg.Event", "demo.msg.Happening")).hexdigest()}', count(*)::bigint, null from events
    union all select 'attachments', 'text/html', null, count(*)::bigint, bit_xor(hash_of)::bigint from (select ('0x' || substr(md5(html || page_id || url), 1, 15))::bigint as hash_of from pages)""",
)
def t20_lossless(spark, sf_dir):
    target = _lossless(spark, sf_dir)
    hashed = lambda c: F.bit_xor(F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint"))
    rows = spark.read.format("logfold").load(target).groupBy("topic").agg(F.count("*").alias("n"), hashed(F.when(F.col("topic") == "/json", F.col("data"))).alias("payloads"))
    dims = spark.read.format("logfold_channels").load(target).select("topic", "message_type", F.md5("schema_data").alias("schema_md5")).distinct()
    attached = spark.read.format("logfold_attachments").load(target)
    own = hashed(F.concat(F.col("data"), F.col("log_time").cast("string").cast("binary"), F.col("name").cast("binary")))
    more = attached.groupBy(F.lit("attachments").alias("topic"), F.col("media_type").alias("message_type"), F.lit(None).cast("string").alias("schema_md5")).agg(F.count("*").alias("n"), own.alias("payloads"))
    return rows.join(dims, "topic").select("topic", "message_type", "schema_md5", "n", "payloads").unionByName(more)


@query("d1_protobuf_dispatch", "select event_id, event_type from events")
def d1_protobuf(spark, sf_dir):
    """Payloads under a renamed descriptor, decoded by the reader's own choice of codec."""
    return api.Reader(spark, _lossless(spark, sf_dir)).decode("/proto").select("message.event_id", "message.event_type")
