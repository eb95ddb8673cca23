"""Schema languages and reports."""

from pyspark.sql import functions as F

from ..model import SQL, channels
from ..operators import schemas as H
from ..plans import schema as S
from ..plans.spark_types import struct_type
from .registry import query

JOINT = """std_msgs/Header header
string[] name
float64[] position
================================================================================
MSG: std_msgs/Header
builtin_interfaces/Time stamp
string frame_id
"""
INDENTED = """std_msgs/Header header
  builtin_interfaces/Time stamp
    int32 sec
    uint32 nanosec
  string frame_id
int32 count  # with x = 3
int32 LIMIT=5
"""
IDL = """module demo { module msg {
  typedef double cov_t[36];
  struct Pose { double x, y; cov_t cov; sequence<octet, 8> raw; };
  struct Path { Pose poses[2]; string<9> name; boolean done; };
}; };"""
ROS2_IDL = "=" * 80 + "\nIDL: std_msgs/msg/Pair\nmodule std_msgs { module msg { struct Pair { string key; long long value; }; }; };\n"


def _values(rows: str, names: str) -> str:
    return f"select * from (values {rows}) v({names})"


def _paths(spark, *schemas):
    rows = [(s.name, i, p, t) for s in schemas for i, (p, t) in enumerate(s.paths())]
    return spark.createDataFrame(rows, "message_type string, pos long, path string, type string")


@query(
    "h1_msg",
    _values(
        "('sensor_msgs/msg/JointState', 0, 'header', 'std_msgs/Header'), ('sensor_msgs/msg/JointState', 1, 'header.stamp', 'builtin_interfaces/Time'), ('sensor_msgs/msg/JointState', 2, 'header.stamp.sec', 'int32'), ('sensor_msgs/msg/JointState', 3, 'header.stamp.nanosec', 'uint32'), "
        "('sensor_msgs/msg/JointState', 4, 'header.frame_id', 'string'), ('sensor_msgs/msg/JointState', 5, 'name', 'string[]'), ('sensor_msgs/msg/JointState', 6, 'position', 'float64[]')",
        "message_type, pos, path, type",
    ),
)
def h1(spark, sf_dir):
    return _paths(spark, S.parse("sensor_msgs/msg/JointState", JOINT))


@query("h2_indented", _values("('t/msg/N', 0, 'header', 'std_msgs/Header'), ('t/msg/N', 1, 'header.stamp', 'builtin_interfaces/Time'), ('t/msg/N', 2, 'header.stamp.sec', 'int32'), ('t/msg/N', 3, 'header.stamp.nanosec', 'uint32'), ('t/msg/N', 4, 'header.frame_id', 'string'), ('t/msg/N', 5, 'count', 'int32')", "message_type, pos, path, type"))
def h2(spark, sf_dir):
    return _paths(spark, S.parse("t/msg/N", INDENTED))


@query("h3_idl", _values("('demo/msg/Path', 0, 'poses', 'demo/msg/Pose[2]'), ('demo/msg/Path', 1, 'poses.x', 'float64'), ('demo/msg/Path', 2, 'poses.y', 'float64'), ('demo/msg/Path', 3, 'poses.cov', 'float64[36]'), ('demo/msg/Path', 4, 'poses.raw', 'uint8[]'), ('demo/msg/Path', 5, 'name', 'string'), ('demo/msg/Path', 6, 'done', 'bool')", "message_type, pos, path, type"))
def h3(spark, sf_dir):
    return _paths(spark, S.parse("demo/msg/Path", IDL))


@query("h4_ros2_idl", _values("('std_msgs/msg/Pair', 0, 'key', 'string'), ('std_msgs/msg/Pair', 1, 'value', 'int64')", "message_type, pos, path, type"))
def h4(spark, sf_dir):
    return _paths(spark, S.parse("std_msgs/msg/Pair", ROS2_IDL))


@query("h5_auto_detect", _values("('a', 'int32'), ('b', 'string'), ('c', 'float64')", "path, type"))
def h5(spark, sf_dir):
    some = [S.parse("x/A", "int32 a"), S.parse("x/B", "struct B { string b; };".replace("struct B", "module x { struct B") + " };"), S.parse("x/C", "===\nIDL: x/C\nmodule x { struct C { double c; }; };")]
    return spark.createDataFrame([p for s in some for p in s.paths()], "path string, type string")


@query("h6_builtins", _values("('builtin_interfaces/Duration', 2), ('builtin_interfaces/Time', 2), ('builtin_interfaces/msg/Duration', 2), ('builtin_interfaces/msg/Time', 2), ('std_msgs/Header', 2), ('std_msgs/msg/Header', 2)", "name, n"))
def h6(spark, sf_dir):
    return spark.createDataFrame([(n, len(m.fields)) for n, m in S.builtins().items()], "name string, n int")


@query("h7_ros1", _values("('data', 'string')", "path, type"))
def h7(spark, sf_dir):
    return spark.createDataFrame(S.parse("test_pkg/TestMsg", "Header header\nstring data", ros1=True).paths(), "path string, type string")


@query("h8_listing", f"with {SQL} select message_type, min(encoding) as encoding, count(distinct topic)::bigint as n_topics, max(len(string_split(coalesce(schema, ''), chr(10))))::bigint as n_lines from chan group by 1")
def h8(spark, sf_dir):
    return H.listing(channels(spark, sf_dir))


@query("h9_validate", f"with {SQL} select distinct message_type, case when schema is null then 'warning' when encoding = 'json' then 'error' else 'ok' end as status from chan")
def h9(spark, sf_dir):
    return H.validate(channels(spark, sf_dir)).select("message_type", "status")


@query("h9_show", f"with {SQL} select topic, message_type, schema as head, 1::bigint as n_lines from chan where contains(topic, 'conv') or contains(message_type, 'conv')")
def h9_show(spark, sf_dir):
    return H.show(channels(spark, sf_dir), "conv")


@query("h9_diff", f"with {SQL} select distinct message_type, case when message_type = 'std_msgs/msg/String' then 'modified' when message_type = 'demo_msgs/msg/View' then 'removed' else 'same' end as status from chan")
def h9_diff(spark, sf_dir):
    old = channels(spark, sf_dir)
    new = old.where("message_type <> 'demo_msgs/msg/View'").withColumn("schema", F.when(F.col("message_type") == "std_msgs/msg/String", "string text").otherwise(F.col("schema")))
    return H.diff(old, new)


@query("h10_fields", f"with {SQL} select distinct message_type, 0::bigint as pos, 'data' as path, 'string' as type from chan where encoding = 'cdr'")
def h10(spark, sf_dir):
    return H.fields(channels(spark, sf_dir).where("encoding = 'cdr'"))


@query("h12_spark_type", _values("('header', 'struct<stamp:struct<sec:int,nanosec:bigint>,frame_id:string>'), ('name', 'array<string>'), ('position', 'array<double>')", "name, type"))
def h12(spark, sf_dir):
    kind = struct_type(S.parse("sensor_msgs/msg/JointState", JOINT))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in kind], "name string, type string")


@query("a17_alignment", _values("('sensor_msgs/msg/JointState', 8), ('std_msgs/Header', 4), ('x/A', 1)", "name, alignment"))
def a17(spark, sf_dir):
    joint = S.parse("sensor_msgs/msg/JointState", JOINT)
    small = S.parse("x/A", "uint8 a\nbool b")
    rows = [("sensor_msgs/msg/JointState", joint.alignment(S.Ref(joint.name))), ("std_msgs/Header", joint.alignment(S.Ref("std_msgs/Header"))), ("x/A", small.alignment(S.Ref("x/A")))]
    return spark.createDataFrame(rows, "name string, alignment int")


@query("j12_variants", _values("('sensor_msgs/JointState', 'sensor_msgs/msg/JointState'), ('sensor_msgs::msg::JointState', 'sensor_msgs/msg/JointState'), ('JointState', 'sensor_msgs/msg/JointState'), ('Header', 'std_msgs/Header'), ('std_msgs/msg/Header', 'std_msgs/msg/Header')", "asked, found"))
def j12(spark, sf_dir):
    s = S.parse("sensor_msgs/msg/JointState", JOINT)
    asked = ["sensor_msgs/JointState", "sensor_msgs::msg::JointState", "JointState", "Header", "std_msgs/msg/Header"]
    return spark.createDataFrame([(a, s.resolve(a).name) for a in asked], "asked string, found string")


@query("t13_package_rename", _values("('own_msgs/msg/JointState', 'header', 'std_msgs/Header'), ('own_msgs/msg/JointState', 'name', 'string[]'), ('own_msgs/msg/JointState', 'position', 'float64[]')", "name, field, type"))
def t13(spark, sf_dir):
    moved = S.parse("sensor_msgs/msg/JointState", JOINT).rename_package("sensor_msgs", "own_msgs")
    return spark.createDataFrame([(moved.name, f.name, S.spell(f.type)) for f in moved.top.fields], "name string, field string, type string")
