"""Rename rules for topics, types and schema texts, compiled to column expressions on the channel dimension.

Order: topics, then types, then types by topic. Exact rules win over wildcards. Of topic wildcards the longest pattern
comes first (equal lengths in the order given), of type wildcards the first given.
"""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidRuleError, NotFoundError, TopicCollisionError, TypeCollisionError
from ..functions.text import wildcard_regex
from ..model import channel_keys

#: Characters that end a type reference in a schema text.
_EDGE = r"\s<>,\[\]{}();"


def _replacement(target: str) -> str:
    """The Java replacement of a wildcard target: its n-th star stands for the n-th group."""
    out, n = [], 0
    for c in target:
        if c == "*":
            n += 1
            out.append(f"${n}")
        else:
            out.append("\\" + c if c in "$\\" else c)
    return "".join(out)


def _whole(old: str) -> str:
    return f"(?<![^{_EDGE}])" + re.escape(old) + f"(?![^{_EDGE}])"


def _namespace(name: str) -> str:
    """What stands before the last separator of a type name or pattern."""
    if name.endswith("*"):
        return name[:-1].rstrip("/.")
    return name.rpartition("/" if "/" in name else ".")[0]


@dataclass
class Rules:
    """A list of rename rules; the ``with_`` methods return the list itself, so calls chain."""

    topics: dict[str, str] = field(default_factory=dict)
    topic_wildcards: list[tuple[str, str]] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)
    type_wildcards: list[tuple[str, str]] = field(default_factory=list)
    topic_types: dict[tuple[str, str], str] = field(default_factory=dict)

    def with_topic_rename(self, source: str, target: str) -> Rules:
        self.topics[source] = target
        return self

    def with_topic_rename_wildcard(self, pattern: str, target: str) -> Rules:
        if "*" not in pattern:
            raise InvalidRuleError(f"{pattern!r} has no star")
        if target.count("*") > pattern.count("*"):
            raise InvalidRuleError(f"{target!r} has more stars than {pattern!r}")
        self.topic_wildcards.append((pattern, target))
        return self

    def with_type_rename(self, source: str, target: str) -> Rules:
        self.types[source] = target
        return self

    def with_type_rename_wildcard(self, pattern: str, target: str) -> Rules:
        if not pattern.endswith("*") or "*" in pattern[:-1] or not target.endswith("*"):
            raise InvalidRuleError(f"{pattern!r} and {target!r} must end with their only star")
        self.type_wildcards.append((pattern, target))
        return self

    def with_topic_type_rename(self, topic: str, source: str, target: str) -> Rules:
        self.topic_types[(topic, source)] = target
        return self

    # Expressions

    def topic(self, topic: Column) -> Column:
        out = topic
        for pattern, target in reversed(sorted(self.topic_wildcards, key=lambda r: -len(r[0]))):
            regex = wildcard_regex(pattern, group=True)
            out = F.when(topic.rlike(regex), F.regexp_replace(topic, regex, _replacement(target))).otherwise(out)
        return _lookup(self.topics, topic, out)

    def type(self, message_type: Column, topic: Column | None = None) -> Column:
        out = message_type
        for pattern, target in reversed(self.type_wildcards):
            head = pattern[:-1]
            out = F.when(message_type.startswith(head), F.concat(F.lit(target[:-1]), F.substring(message_type, len(head) + 1, 1 << 20))).otherwise(out)
        out = _lookup(self.types, message_type, out)
        for (of, source), target in self.topic_types.items():
            if topic is not None:
                out = F.when((topic == of) & (message_type == source), target).otherwise(out)
        return out

    def schema(self, text: Column, old_type: Column | None = None, new_type: Column | None = None) -> Column:
        """The schema text with its references renamed, in the spellings with ``/``, ``::`` and ``.``."""
        spaces = [(_namespace(p), _namespace(t)) for p, t in sorted(self.type_wildcards, key=lambda r: -len(r[0]))]
        for old, new in spaces:
            text = F.regexp_replace(text, f"(?<![^{_EDGE}])" + re.escape(old) + "/", _literal(new + "/"))
            text = _modules(text, old, new)
        for old, new in sorted(self.types.items(), key=lambda r: -len(r[0])):
            for a, b in ((old, new), (old.replace("/", "::"), new.replace("/", "::").replace(".", "::")), (old.replace("/msg/", ".").replace("/", "."), new.replace("/msg/", ".").replace("/", "."))):
                text = F.regexp_replace(text, _whole(a), _literal(b))
            text = _modules(text, _namespace(old), _namespace(new))
        return text

    # Use

    def apply(self, channels: DataFrame, on_collision: str = "suffix") -> DataFrame:
        """``channels`` renamed. Topics that meet within a file get ``_1``, ``_2``, ... in order of id, or raise with ``fail``."""
        topic, kind = F.col("topic"), F.col("message_type")
        schema = {"schema": self.schema(F.col("schema"))} if "schema" in channels.columns else {}
        out = channels.withColumns({"topic": self.topic(topic), "message_type": self.type(kind, topic), **schema, "__before": topic})
        file = ["file"] if "file" in channels.columns else []
        # Windows over the dimension only. Channels that shared a topic before still share it.
        out = out.withColumn("__first", F.min("channel_id").over(Window.partitionBy(*file, "__before")))
        out = out.withColumn("__n", F.dense_rank().over(Window.partitionBy(*file, "topic").orderBy("__first", "__before")) - 1)
        if on_collision == "fail":
            met = out.where("__n > 0 and topic <> __before").select("topic").limit(1).collect()
            if met:
                raise TopicCollisionError(f"two topics would be named {met[0].topic!r}")
        named = F.when(F.col("__n") > 0, F.concat("topic", F.lit("_"), F.col("__n").cast("string"))).otherwise(F.col("topic"))
        return out.withColumn("topic", named).drop("__n", "__before", "__first")

    def missing(self, channels: DataFrame) -> DataFrame:
        """``kind, source`` of the exact rules whose source no channel has."""
        spark = channels.sparkSession
        wanted = [("topic", t, None) for t in self.topics] + [("type", t, None) for t in self.types] + [("topic type", s, t) for t, s in self.topic_types]
        rules = spark.createDataFrame(wanted, "kind string, source string, topic string")
        have = channels.select(F.lit("topic").alias("kind"), F.col("topic").alias("source"), F.lit(None).cast("string").alias("topic"))
        have = have.union(channels.select(F.lit("type"), "message_type", F.lit(None).cast("string"))).union(channels.select(F.lit("topic type"), "message_type", "topic")).distinct()
        same = [rules[c].eqNullSafe(have[c]) for c in ("kind", "source", "topic")]
        return rules.join(have, same, "left_anti").select("kind", "source")

    def collisions(self, channels: DataFrame) -> DataFrame:
        """``target, n_schemas`` of the new type names that channels with different schemas would share."""
        moved = channels.select(self.type(F.col("message_type"), F.col("topic")).alias("target"), F.coalesce("schema", F.lit("")).alias("schema"), "message_type")
        return moved.groupBy("target").agg(F.countDistinct("schema").alias("n_schemas"), F.countDistinct("message_type").alias("n_types")).where("n_schemas > 1 and n_types > 1").select("target", "n_schemas")

    def validate(self, channels: DataFrame) -> None:
        for row in self.missing(channels).orderBy("kind", "source").limit(1).collect():
            raise NotFoundError(f"no {row.kind} {row.source!r} in the recording")
        for row in self.collisions(channels).orderBy("target").limit(1).collect():
            raise TypeCollisionError(f"{row.n_schemas} schemas would be named {row.target!r}")


def transform_channels(channels: DataFrame, *steps) -> DataFrame:
    """Custom transforms on the dimension: each step is a Python function of a topic that gives the new one, or None to drop it."""
    spark = channels.sparkSession
    topics = [r.topic for r in channels.select("topic").distinct().collect()]  # 65 536 a file at most
    moved = []
    for t in topics:
        new = t
        for step in steps:
            new = step(new)
            if new is None:
                break
        if new is not None:
            moved.append((t, new))
    table = spark.createDataFrame(moved, "topic string, __new string")
    return channels.join(F.broadcast(table), "topic").withColumn("topic", F.col("__new")).drop("__new").select(*channels.columns)


def by_rule_table(channels: DataFrame, rules: DataFrame) -> DataFrame:
    """``channels`` renamed by a table of rules (pattern: an expression; target; priority): the first match by priority wins.

    The theta join runs between two dimensions; the smaller, the rules, is broadcast.
    """
    both = channels.join(F.broadcast(rules), F.expr("topic rlike pattern"), "left")
    best = both.withColumn("__n", F.row_number().over(Window.partitionBy(*channel_keys(channels)).orderBy(F.col("priority").asc_nulls_last()))).where("__n = 1")
    return best.withColumn("topic", F.coalesce(F.expr("regexp_replace(topic, pattern, target)"), "topic")).select(*channels.columns)


def _literal(text: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", text)


def _modules(text: Column, old: str, new: str) -> Column:
    """IDL: qualified names and module heads of a namespace."""
    if not old or old == new:
        return text
    a, b = re.split(r"[/.]", old), re.split(r"[/.]", new)
    text = F.regexp_replace(text, r"(?<![\w:])" + "::".join(map(re.escape, a)) + "::", _literal("::".join(b) + "::"))
    return F.regexp_replace(text, r"\bmodule " + re.escape(a[0]) + r" \{", _literal(f"module {b[0]} {{"))


def _lookup(exact: dict[str, str], key: Column, otherwise: Column) -> Column:
    if not exact:
        return otherwise
    table = F.create_map(*(F.lit(x) for pair in exact.items() for x in pair))
    return F.coalesce(F.try_element_at(table, key), otherwise)


def from_json(text: str) -> Rules:
    """Rules of a JSON configuration: topic_renames, topic_wildcards, type_renames, topic_type_renames."""
    data, rules = json.loads(text), Rules()
    for r in data.get("topic_renames", []):
        rules.with_topic_rename(r["from"], r["to"])
    for r in data.get("topic_wildcards", []):
        rules.with_topic_rename_wildcard(r["pattern"], r["target"])
    for r in data.get("type_renames", []):
        rules.with_type_rename(r["from"], r["to"])
    for r in data.get("topic_type_renames", []):
        rules.with_topic_type_rename(r["topic"], r["from_type"], r["to_type"])
    return rules


def from_toml(text: str) -> Rules:
    """Rules of a TOML configuration: a table of type mappings and a list of topic mappings, with stars or without."""
    data, rules = tomllib.loads(text), Rules()
    for source, target in data.get("type_mappings", {}).items():
        (rules.with_type_rename_wildcard if source.endswith("*") else rules.with_type_rename)(source, target)
    for r in data.get("topic_mappings", []):
        (rules.with_topic_rename_wildcard if "*" in r["from"] else rules.with_topic_rename)(r["from"], r["to"])
    return rules


#: Vendor types and the names they are brought to; {brand} stands for the package of the user's choice.
VENDOR_TYPES = {
    "genie": {
        "genie_msgs/msg/ArmState": "{brand}.msg.ArmState",
        "genie_msgs/msg/BatteryStatus": "sensor_msgs.msg.BatteryState",
        "genie_msgs/msg/EndState": "{brand}.msg.EndEffectorState",
        "genie_msgs/msg/FaultStatus": "{brand}.msg.FaultStatus",
        "genie_msgs/msg/HeadState": "{brand}.msg.HeadState",
        "genie_msgs/msg/PeriStatus": "{brand}.msg.PeripheralStatus",
        "genie_msgs/msg/Position": "geometry_msgs.msg.Pose",
        "genie_msgs/msg/PublicFaultMsg": "{brand}.msg.FaultStatus",
        "genie_msgs/msg/SceneStatus": "{brand}.msg.SceneStatus",
        "genie_msgs/msg/WaistState": "{brand}.msg.TorsoState",
        "genie_msgs/msg/WholeBodyStatus": "{brand}.msg.WholeBodyStatus",
    },
    "others": {
        "kuavo_msgs/sensorsData": "{brand}.msg.SensorsData",
        "upperlimb/Pose": "{brand}.msg.EndEffectorPose",
        "nmx.msg.CameraExtrinsic": "geometry_msgs.msg.Transform",
        "nmx.msg.JointStates": "sensor_msgs.msg.JointState",
    },
}
VENDOR_TOPICS = {
    ("/lowdim/joint", "nmx.msg.LowdimData"): "{brand}.msg.JointStates",
    ("/lowdim/tcp", "nmx.msg.LowdimData"): "{brand}.msg.eef_pose",
    ("/lowdim/ee_state", "nmx.msg.LowdimData"): "{brand}.msg.ee_state",
    ("/lowdim/airexo_joint", "nmx.msg.LowdimData"): "{brand}.msg.airexo_joint",
    ("/camera/intrinsic/camid_1", "nmx.msg.LowdimData"): "{brand}.msg.camid_1_intrinsic",
    ("/camera/color/compressed/jpg/camid_1", "nmx.msg.Image"): "sensor_msgs.msg.CompressedImage",
    ("/camera/depth/compressed/png/camid_1", "nmx.msg.Image"): "sensor_msgs.msg.CompressedImage",
}


def preset(name: str, brand: str) -> Rules:
    """The rules of ``genie``, ``nmx`` or ``full``, with the target package as ``brand``."""
    if name not in ("genie", "nmx", "full"):
        raise InvalidRuleError(f"unknown preset {name!r}")
    rules = Rules()
    for group in {"genie": ["genie"], "nmx": [], "full": ["genie", "others"]}[name]:
        for source, target in VENDOR_TYPES[group].items():
            rules.with_type_rename(source, target.format(brand=brand))
    if name != "genie":
        for (topic, source), target in VENDOR_TOPICS.items():
            rules.with_topic_type_rename(topic, source, target.format(brand=brand))
    return rules
