"""Joining channels by time, and even resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, value: str, key: str, slice_ns: int = 86_400_000_000_000, tolerance_ns: int | None = None) -> DataFrame:
    """Each left row with the last right value of the same ``by`` at or before its time.

    Both sides are merged and carried forward within (by, slice of time), so a hot key is spread over its slices; what
    a slice inherits is the last right row of any earlier slice, found over one row per (by, slice).
    """
    tag = lambda df, side, v: df.select(F.col(by).alias("by"), F.col(time).alias("t"), F.lit(side).alias("side"), v.alias("v"), (F.col(key) if side else F.lit(None)).alias("k"))
    rows = tag(left, 1, F.lit(None).cast(right.schema[value].dataType)).unionByName(tag(right, 0, F.col(value)))
    rows = rows.withColumn("slice", F.call_function("div", "t", F.lit(slice_ns)))
    seen = F.when(F.col("side") == 0, F.struct("t", "v"))
    last = rows.where("side = 0").groupBy("by", "slice").agg(F.max_by(F.struct("t", "v"), F.struct("t", "v")).alias("last"))
    slices = rows.select("by", "slice").distinct().join(last, ["by", "slice"], "left")
    over = Window.partitionBy("by").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    inherited = slices.select("by", "slice", F.last("last", ignorenulls=True).over(over).alias("before"))
    within = Window.partitionBy("by", "slice").orderBy("t", "side", "v").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("now", F.last(seen, ignorenulls=True).over(within)).where("side = 1").join(inherited, ["by", "slice"])
    found = F.coalesce("now", "before")
    if tolerance_ns is not None:
        found = F.when(F.col("t") - found["t"] <= tolerance_ns, found)
    return held.select(F.col("k").alias(key), F.col("by").alias(by), F.col("t").alias(time), found["t"].alias("matched_time"), found["v"].alias(value))


def resample(messages: DataFrame, fps: int, channel: str, time: str, value: str) -> DataFrame:
    """The last value of each channel in each frame of 1/fps seconds that has one."""
    frame = F.call_function("div", F.col(time) * fps, F.lit(1_000_000_000))
    return messages.groupBy(channel, frame.alias("frame")).agg(F.max_by(value, F.struct(time, value)).alias(value))


def features(frames: DataFrame, channel: str, value: str, names: list[str]) -> DataFrame:
    """A column per named channel and a row per frame."""
    return frames.groupBy("frame").pivot(channel, names).agg(F.max(value))
