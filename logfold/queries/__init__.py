"""The registered queries: name -> callable (spark, sf_dir), and SQL for the same rows."""

from . import files, inspect, interfaces, payloads, relational, schemas, selection, streams, values  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
