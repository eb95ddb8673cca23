"""User-defined table and aggregate functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class FindBytes:
    """Offsets of the non-overlapping occurrences of a pattern in a payload, with the bytes around each."""

    def eval(self, data: bytes, pattern: bytes, context: int):
        at = data.find(pattern) if data is not None and pattern else -1
        while at >= 0:
            yield at, bytes(data[max(0, at - context) : at + len(pattern) + context])
            at = data.find(pattern, at + len(pattern))


def register(spark: SparkSession) -> None:
    """``find_bytes(data, pattern, context)`` for LATERAL joins in SQL."""
    spark.udtf.register("find_bytes", F.udtf(FindBytes, returnType="offset long, around binary"))


def median_udaf():
    """The median of a group, as an aggregate over Arrow batches (exact; a group has to fit a worker)."""

    @F.pandas_udf("double")
    def median(values: pd.Series) -> float:
        return float(values.median())

    return median
