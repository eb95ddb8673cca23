"""Container formats of files, by magic and then by extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bag, mcap


def detect(head: bytes, path: str = "") -> str | None:
    """``mcap``, ``bag`` or None."""
    if head.startswith(mcap.MAGIC):
        return "mcap"
    if head.startswith(b"#ROSBAG V"):
        return "bag"
    lower = path.lower()
    return "mcap" if lower.endswith(".mcap") else "bag" if lower.endswith(".bag") else None


def format_of(path: Column, head: Column | None = None) -> Column:
    """The same as a column, over listings or ``binaryFile`` rows."""
    by_name = F.when(F.lower(path).endswith(".mcap"), "mcap").when(F.lower(path).endswith(".bag"), "bag")
    if head is None:
        return by_name
    return F.when(F.substring(head, 1, 8) == F.lit(mcap.MAGIC), "mcap").when(F.substring(head, 1, len(bag.MAGIC) - 4).startswith(F.lit(b"#ROSBAG V")), "bag").otherwise(by_name)
