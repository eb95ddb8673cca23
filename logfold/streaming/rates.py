"""Rates, sessions and running numbers over a stream of messages (topic, event time ``ts``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chunk presets for latency and throughput: bytes, messages, milliseconds.
PRESETS = {"default": (8 << 20, 100_000, 100), "max_throughput": (32 << 20, 500_000, 500), "high_throughput": (16 << 20, 250_000, 200), "low_latency": (1 << 20, 10_000, 50)}


def tumbling(events: DataFrame, width: str, key: str = "topic", late: str = "1 hour") -> DataFrame:
    """Messages per key and window; rows later than the watermark go in a stream."""
    return events.withWatermark("ts", late).groupBy(key, F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def sliding(events: DataFrame, width: str, step: str, key: str = "topic", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(key, F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """Runs of messages with no pause of ``gap`` or longer."""
    return events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def numbered(events: DataFrame, key: str, salt: str) -> DataFrame:
    """A running number per (key, salt) in a stream, in order of arrival and event time: state is one number."""

    def step(group, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        rows["sequence"] = range(at, at + len(rows))
        state.update((at + len(rows),))
        yield rows[["id", key, salt, "sequence"]]

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    out = f"id {kinds['id']}, {key} {kinds[key]}, {salt} {kinds[salt]}, sequence long"
    return events.groupBy(key, salt).applyInPandasWithState(step, out, "at long", "append", "NoTimeout")


def preset_options(name: str) -> dict[str, str]:
    """A processing-time trigger and the source's files a batch, from a chunk preset."""
    size, _, ms = PRESETS[name]
    return {"processingTime": f"{ms} milliseconds", "maxBytesPerTrigger": str(size)}


def run_once(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into a table, and return the table."""
    if mode == "complete":
        raise ValueError("files take appended rows only")
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
