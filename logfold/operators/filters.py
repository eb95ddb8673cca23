"""Predicates on topics, types and times, and what they keep."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SECONDS_LIMIT, wildcard_regex
from ..model import channel_keys, counted

#: Packages that count as standard.
STANDARD = ("sensor_msgs", "std_msgs", "geometry_msgs", "nav_msgs", "tf2_msgs", "trajectory_msgs", "visualization_msgs", "diagnostic_msgs", "actionlib_msgs")


def topic_filter(include: list[str] | None = None, exclude: list[str] | None = None, include_regex: str | None = None, exclude_regex: str | None = None, column: str = "topic") -> Column:
    """Exact lists and unanchored expressions; all that are given must hold."""
    c = F.col(column)
    tests = []
    if include is not None:
        tests.append(c.isin(*include))
    if exclude:
        tests.append(~c.isin(*exclude))
    if include_regex is not None:
        tests.append(c.rlike(include_regex))
    if exclude_regex is not None:
        tests.append(~c.rlike(exclude_regex))
    return reduce(Column.__and__, tests, F.lit(True))


def glob_filter(include: list[str] = (), regexes: list[str] = (), exclude: list[str] = (), column: str = "topic") -> Column:
    """Whole-name globs or whole-name expressions, without the exactly excluded names. Nothing given includes all."""
    c = F.col(column)
    some = [c.rlike(wildcard_regex(g, single=True)) for g in include] + [c.rlike(f"^(?:{r})$") for r in regexes]
    keep = reduce(Column.__or__, some) if some else F.lit(True)
    return keep & ~c.isin(*exclude) if exclude else keep


def custom_topics(channels: DataFrame, test: Callable[[str], bool]) -> DataFrame:
    """Channels whose topic passes a Python predicate. It runs on the distinct topics only, in the workers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([test(t) for t in batch.column(0).to_pylist()], pa.bool_()))

    names = channels.select("topic").distinct().mapInArrow(run, "topic string")
    return channels.join(names, "topic", "left_semi")


def of_channels(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """Messages of the given channels; those of unknown channels go."""
    keys = channel_keys(messages, channels)
    return messages.join(counted(channels.select(*keys).distinct()), keys, "left_semi")


def channel_by_topic(channels: DataFrame, topic: str) -> DataFrame:
    """The channel of a topic with the least id."""
    return channels.where(F.col("topic") == topic).orderBy(*channel_keys(channels)).limit(1)


def contains(pattern: str, *columns: str, case: bool = False) -> Column:
    """Any column contains the text; an empty pattern matches all that is not null."""
    cut = (lambda c: c) if case else F.lower
    return reduce(Column.__or__, (cut(F.col(c)).contains(pattern if case else pattern.lower()) for c in columns))


def any_contains(patterns: list[str], column: str = "topic") -> Column:
    """The column holds one of the texts."""
    return reduce(Column.__or__, (F.col(column).contains(p) for p in patterns), F.lit(False))


def is_standard(column: str = "message_type") -> Column:
    return F.col(column).rlike("^(" + "|".join(STANDARD) + ")/")


def in_time(start: int | None = None, end: int | None = None) -> Column:
    """The closed time range: both bounds are times of messages."""
    tests = ([F.col("log_time") >= start] if start is not None else []) + ([F.col("log_time") <= end] if end is not None else [])
    return reduce(Column.__and__, tests, F.lit(True))


def parse_time(text: str) -> int:
    """Nanoseconds of seconds, nanoseconds or RFC 3339."""
    text = text.strip()
    if re.fullmatch(r"\d+", text):
        n = int(text)
        return n * 10**9 if n < SECONDS_LIMIT else n
    when = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if when.tzinfo is None:
        raise ValueError(f"{text!r} has no zone")
    whole = when.astimezone(timezone.utc)
    return int(whole.replace(microsecond=0).timestamp()) * 10**9 + whole.microsecond * 1000


def parse_time_range(text: str) -> tuple[int, int]:
    """``a,b``, ``a:b`` or ``a-b``; the end must be behind the start."""
    for separator in (",", ":", "-"):
        places = [m.start() for m in re.finditer(re.escape(separator), text)]
        for at in places:
            try:
                start, end = parse_time(text[:at]), parse_time(text[at + 1 :])
            except ValueError:
                continue
            if end <= start:
                raise ValueError("the range ends before it starts")
            return start, end
    raise ValueError(f"{text!r} is no time range")
