"""The command line: inspect, convert, extract, search and schema, over containers at a path.

    python -m logfold.cli inspect topics recording.mcap --filter camera
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .api import Reader
from .codecs import jsons
from .functions import text as X
from .model import SESSION
from .operators import filters as P
from .operators import inspect as I
from .operators import order as O
from .operators import rename as R
from .operators import rewrite as W
from .operators import schemas as H
from .operators import search as S


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="logfold", description="Inspect, search, extract and convert recordings.")
    groups = top.add_subparsers(dest="group", required=True)

    def command(group, name, *arguments):
        p = group.add_parser(name)
        p.add_argument("input")
        for names, options in arguments:
            p.add_argument(*names, **options)

    def group(name):
        return groups.add_parser(name).add_subparsers(dest="command", required=True)

    out, limit = (("output",), {}), (("-n", "--limit"), {"type": int, "default": 10})
    inspect = group("inspect")
    command(inspect, "info")
    command(inspect, "topics", (("--filter",), {}))
    command(inspect, "schema", (("pattern",), {"nargs": "?", "default": ""}))
    command(inspect, "stats")
    convert = group("convert")
    command(convert, "to-mcap", out)
    command(convert, "to-bag", out)
    command(convert, "normalize", out, (("--config",), {}), (("--preset",), {}), (("--brand",), {"default": "common"}))
    extract = group("extract")
    command(extract, "messages", out, (("-c", "--count"), {"type": int, "default": 100}))
    command(extract, "topics", (("topics",), {}), out)
    command(extract, "per-topic", out, (("-c", "--count"), {"type": int, "default": 1}))
    command(extract, "time-range", (("range",), {}), out)
    command(extract, "fixture", out)
    search = group("search")
    command(search, "bytes", (("pattern",), {}), limit)
    command(search, "string", (("pattern",), {}), limit)
    command(search, "topics", (("pattern",), {}))
    command(search, "types", (("pattern",), {}))
    command(search, "fields", (("topic",), {}))
    command(search, "values", (("topic",), {}), (("field",), {}), limit)
    schema = group("schema")
    command(schema, "list", (("--standard-only",), {"action": "store_true"}), (("--group-by-type",), {"action": "store_true"}))
    command(schema, "show", (("pattern",), {}))
    command(schema, "validate")
    command(schema, "diff", (("other",), {}))
    return top


def run(spark: SparkSession, arguments: Sequence[str]) -> DataFrame | dict:
    """The result of a command: rows to show, or counts of what was written."""
    a = parser().parse_args(arguments)
    source = Reader(spark, a.input)
    messages, channels = source.messages, source.channels
    name = f"{a.group} {a.command}"
    if name == "inspect info":
        files = source.files
        return files.select("path", "format", X.human_size(F.col("size")).alias("size"), "message_count", "n_channels", X.format_time(F.col("start_time")).alias("start"), X.format_duration(F.col("duration")).alias("duration"))
    if name == "inspect topics":
        some = channels.where(P.contains(a.filter, "topic", "message_type")) if a.filter else channels
        return some.groupBy("topic", "message_type", "encoding").agg(F.sum("message_count").alias("n")).orderBy("topic")
    if name in ("inspect schema", "schema show"):
        return H.show(channels, a.pattern)
    if name == "inspect stats":
        total = F.sum("n").over(Window.partitionBy())
        per = channels.groupBy("topic").agg(F.sum("message_count").alias("n"))
        return per.select("topic", "n", F.round(F.col("n") * 100.0 / total, 1).alias("share")).orderBy(F.desc("n"), "topic")
    if a.group == "convert":
        if a.command != "normalize":
            return W.convert(spark, a.input, a.output, a.command.removeprefix("to-"))
        if a.config:
            with open(a.config) as f:
                rules = (R.from_json if a.config.endswith(".json") else R.from_toml)(f.read())
        else:
            rules = R.preset(a.preset or "full", a.brand)
        return W.rewrite(spark, a.input, a.output, rules, validate=False, on_error="passthrough")
    if a.group == "extract":
        full = channels.select("file", "channel_id", "schema", "schema_encoding", "schema_data", "callerid")
        kept = {
            "messages": lambda: O.first_messages(messages, a.count, "sequence"),
            "topics": lambda: messages.where(P.any_contains([t.strip() for t in a.topics.split(",") if t.strip()])),
            "per-topic": lambda: O.first_per_channel(messages, a.count, "sequence", channel="topic"),
            "time-range": lambda: messages.where(P.in_time(*P.parse_time_range(a.range))),
            "fixture": lambda: O.first_per_channel(messages, 1, "sequence", channel="topic"),
        }[a.command]()
        W.write(kept.join(F.broadcast(full), ["file", "channel_id"]), a.output, "bag" if a.output.endswith(".bag") else "mcap")
        return {"messages": Reader(spark, a.output).message_count()}
    if name == "search bytes":
        return S.find_bytes(messages.select("topic", "log_time", "data"), "data", a.pattern, limit=a.limit).select("topic", "log_time", "offset", "context")
    if name == "search string":
        rows = messages.select("topic", "log_time", F.decode("data", "ISO-8859-1").alias("data"))
        return S.find_string(rows, "data", a.pattern.encode().decode("latin-1"), limit=a.limit).select("topic", "log_time", "offset", "context")
    if name in ("search topics", "search types"):
        return channels.where(P.contains(a.pattern, "topic" if a.command == "topics" else "message_type")).select("topic", "message_type", "encoding").distinct().orderBy("topic")
    if name == "search fields":
        return H.fields(channels.where(F.col("topic") == a.topic))
    if name == "search values":
        read = source.decode(a.topic)
        variant = dict(read.dtypes)["message"] == "variant"
        value = jsons.value(F.col("message"), f"$.{a.field}", "string") if variant else F.col(f"message.{a.field}").cast("string")
        return read.select("log_time", value.alias("value")).limit(a.limit)
    if name == "schema list":
        return I.topics_of_type(channels) if a.group_by_type else H.listing(channels, a.standard_only).orderBy("message_type")
    if name == "schema validate":
        return H.validate(channels)
    return H.diff(channels, Reader(spark, a.other).channels).orderBy("message_type")


def main() -> None:
    spark = SparkSession.builder.config(map=SESSION).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found = run(spark, sys.argv[1:])
    if isinstance(found, dict):
        print("\n".join(f"{k}: {v}" for k, v in found.items()))
    else:
        found.show(1000, truncate=False)


if __name__ == "__main__":
    main()
