"""Sequences and first messages per channel, without one task per channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import channel_keys


def time_slices(messages: DataFrame, slices: int, time: str = "log_time"):
    """A column that deals rows into at most ``slices`` consecutive ranges of time. The bounds reach the driver, one number each."""
    at = messages.approxQuantile(time, [i / slices for i in range(1, slices)], 0.01 / slices if slices <= 64 else 1e-4) if slices > 1 else []
    bounds = sorted(set(map(int, at)))
    expr = F.lit(0)
    if bounds:
        expr = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(time)))
    return expr


def _of(messages: DataFrame, channel: str) -> list[str]:
    """The columns that name a channel; an id counts within its file."""
    return channel_keys(messages) if channel == "channel_id" else [channel]


def with_sequence(messages: DataFrame, key: str, channel: str = "channel_id", time: str = "log_time", slices: int = 16, name: str = "sequence") -> DataFrame:
    """A gapless number from 0 per channel, in order of time and key.

    Rows are numbered within (channel, slice of time); counts of the earlier slices, a table of channels times slices,
    give where each slice starts. A channel that holds most rows is thus spread over the slices.
    """
    of = _of(messages, channel)
    sliced = messages.withColumn("__slice", time_slices(messages, slices, time))
    counts = sliced.groupBy(*of, "__slice").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*of).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*of, "__slice", F.coalesce(before, F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy(*of, "__slice").orderBy(time, key)) - 1
    numbered = sliced.withColumn("__within", within)
    # The windows' partitioning serves the join, so only the counts are shuffled for it.
    joined = numbered.join(starts, [*of, "__slice"])
    return joined.withColumn(name, (F.col("__start") + F.col("__within")).cast("bigint")).drop("__slice", "__start", "__within")


def with_gap(messages: DataFrame, key: str, channel: str = "channel_id", time: str = "log_time", slices: int = 16) -> DataFrame:
    """The time to the channel's previous message as ``gap``, null for the first.

    As for sequences, rows are compared within (channel, slice of time); a slice's first row takes the last time of the
    earlier slices from a table of channels times slices.
    """
    of = _of(messages, channel)
    sliced = messages.withColumn("__slice", time_slices(messages, slices, time))
    lasts = sliced.groupBy(*of, "__slice").agg(F.max(time).alias("__last"))
    before = F.max("__last").over(Window.partitionBy(*of).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    inherited = lasts.select(*of, "__slice", before.alias("__before"))
    lag = F.lag(time).over(Window.partitionBy(*of, "__slice").orderBy(time, key))
    joined = sliced.withColumn("__lag", lag).join(inherited, [*of, "__slice"])
    return joined.withColumn("gap", F.col(time) - F.coalesce("__lag", "__before")).drop("__slice", "__lag", "__before")


def first_per_channel(messages: DataFrame, n: int, key: str, channel: str = "channel_id", time: str = "log_time", salts: int = 16) -> DataFrame:
    """The first n messages of each channel. Salted parts give their first n, of which the first n stay."""
    salted = messages.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    of = _of(messages, channel)
    part = Window.partitionBy(*of, "__salt").orderBy(time, key)
    some = salted.withColumn("__n", F.row_number().over(part)).where(F.col("__n") <= n).drop("__n", "__salt")
    whole = Window.partitionBy(*of).orderBy(time, key)
    return some.withColumn("__n", F.row_number().over(whole)).where(F.col("__n") <= n).drop("__n")


def first_messages(messages: DataFrame, n: int, key: str) -> DataFrame:
    """The first n messages of a recording by time, channel and key."""
    return messages.orderBy("log_time", *channel_keys(messages), key).limit(n)
