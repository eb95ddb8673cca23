"""Formatting and parsing functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers below this (the year 3000 in seconds) are seconds, others nanoseconds.
SECONDS_LIMIT = 32_503_680_000


def whole(n: Column, by: int) -> Column:
    """Division of non-negative whole numbers, rounded down."""
    return F.call_function("div", n.cast("long"), F.lit(by).cast("long"))


def format_duration(ns: Column) -> Column:
    """``2h 5m``, ``3m 4s``, ``1.250s`` or ``17ms``."""
    s, ms = whole(ns, 10**9), whole(F.pmod(ns, F.lit(10**9)), 10**6)
    return (
        F.when(s >= 3600, F.format_string("%dh %dm", whole(s, 3600), whole(s % 3600, 60)))
        .when(s >= 60, F.format_string("%dm %ds", whole(s, 60), s % 60))
        .when(s > 0, F.format_string("%d.%03ds", s, ms))
        .otherwise(F.format_string("%dms", ms))
    )


def format_time(ns: Column) -> Column:
    """Whole seconds in UTC."""
    return F.concat(F.date_format(F.timestamp_seconds(whole(ns, 10**9)), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def parse_time(text: Column) -> Column:
    """Nanoseconds from seconds, nanoseconds or RFC 3339; null for anything else."""
    number = F.when(text.rlike(r"^\d+$"), text.try_cast("long"))
    stamp = F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.unix_micros(F.try_to_timestamp(text)) * 1000)
    return F.when(number < SECONDS_LIMIT, number * 10**9).when(number.isNotNull(), number).otherwise(stamp)


def human_size(n: Column) -> Column:
    """Bytes with two digits and the unit of 1024s."""
    x = n.cast("double")
    out = F.format_string("%.2f TB", x / 1024.0**4)
    for k, unit in reversed(list(enumerate(["B", "KB", "MB", "GB"]))):
        out = F.when(x < 1024.0 ** (k + 1), F.format_string(f"%.2f {unit}", x / 1024.0**k)).otherwise(out)
    return out


def human_duration(ns: Column) -> Column:
    """A duration in the largest fitting unit with two digits; N/A for 0."""
    s = ns / F.lit(1e9)
    return (
        F.when(ns == 0, "N/A")
        .when(s < 1, F.format_string("%.2f ms", s * 1000))
        .when(s < 60, F.format_string("%.2f seconds", s))
        .when(s < 3600, F.format_string("%.2f minutes (%.0fs)", s / 60, s))
        .otherwise(F.format_string("%.2f hours (%.0fs)", s / 3600, s))
    )


def frequency(n: Column, ns: Column) -> Column:
    """Messages a second; 0 where either is 0."""
    return F.when((n == 0) | (ns == 0), F.lit(0.0)).otherwise(n / (ns / F.lit(1e9)))


def package_of(name: Column) -> Column:
    """What stands before the first separator of a type name, ``/`` before ``.``; empty without one."""
    return F.when(name.contains("/"), F.substring_index(name, "/", 1)).when(name.contains("."), F.substring_index(name, ".", 1)).otherwise("")


def message_name_of(name: Column) -> Column:
    """What stands behind the last separator."""
    return F.when(name.contains("/"), F.substring_index(name, "/", -1)).otherwise(F.substring_index(name, ".", -1))


def namespace_of(name: Column) -> Column:
    """What stands before the last separator."""
    return F.when(name.contains("/"), F.regexp_extract(name, r"^(.*)/[^/]*$", 1)).otherwise(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1))


def convert_type_name(name: Column, target: str) -> Column:
    """A type name in the spelling of ``ros1`` (a/B), ``ros2`` (a/msg/B) or ``proto`` (a.B)."""
    package, last = namespace_of(name), message_name_of(name)
    if target == "proto":
        return F.when(package == "", last).otherwise(F.concat(F.replace(package, F.lit("/"), F.lit(".")), F.lit("."), last))
    slashed = F.replace(package, F.lit("."), F.lit("/"))
    if target == "ros1":
        return F.when(package == "", last).otherwise(F.concat(slashed, F.lit("/"), last))
    if target == "ros2":
        bare = (package != "") & ~package.contains("/")
        return F.when(bare, F.concat(slashed, F.lit("/msg/"), last)).otherwise(F.concat(package, F.lit("/"), last))
    raise ValueError(f"unknown spelling {target!r}")


def type_spelling(name: Column) -> Column:
    return F.when(name.contains("/msg/"), "ros2").when(name.contains("/"), "ros1").when(name.contains("."), "proto").otherwise("unknown")


def wildcard_regex(pattern: str, group: bool = False, single: bool = False) -> str:
    """An anchored regular expression of a wildcard pattern: ``*`` is any text (a group), with ``single`` ``?`` any character."""
    import re

    star = "(.*)" if group else ".*"
    parts = re.split(r"([*?])" if single else r"([*])", pattern)
    return "^" + "".join(star if p == "*" else "." if p == "?" and single else re.escape(p) for p in parts) + "$"


def detect_encoding(encoding: Column, schema_encoding: Column | None = None) -> Column:
    """cdr, protobuf or json by what the names contain; the schema's where the encoding says nothing; else cdr."""

    def one(c: Column) -> Column:
        c = F.lower(c)
        return F.when(c.contains("cdr") | c.contains("ros2"), "cdr").when(c.contains("proto"), "protobuf").when(c.contains("json"), "json")

    found = [one(encoding)] + ([one(schema_encoding)] if schema_encoding is not None else [])
    return F.coalesce(*found, F.lit("cdr"))


def parse_encoding(name: Column, lenient: bool = False) -> Column:
    """The encoding of an exact name, null if unknown; lenient takes further spellings."""
    n = F.lower(name)
    if lenient:
        return F.when(n.isin("cdr", "ros1", "ros2"), "cdr").when(n.isin("protobuf", "proto", "pb"), "protobuf").when(n == "json", "json")
    return F.when(n.isin("cdr", "protobuf", "json"), n)
