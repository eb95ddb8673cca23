"""Scratch folders that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``, or below a folder of our own where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="logfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/logfold/{tag}-{uuid.uuid4().hex}"
    if path.startswith("file:"):
        atexit.register(shutil.rmtree, local(path), ignore_errors=True)
    return path


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")
