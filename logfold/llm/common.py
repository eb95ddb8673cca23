"""What the operators share: shared tables that cut lineage, and small column helpers."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The tables of ``cut`` and where they stand.
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Names of so many rows (two longs each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: White space as the word rules of this package see it (a regular expression class).
SPACE = r"[\x20\x09-\x0D]"
#: Characters that separate words where only letters, digits and non-ASCII count, lower and upper case alike.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a folder of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="logfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later jobs start from the table, so a lost executor costs a reread and no recomputation.
    The table goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/logfold/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Python stages that run inside get Arrow batches of at most so many rows: wide rows take little memory then."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop(*tables: DataFrame | None) -> None:
    """Delete tables of ``cut`` that nothing to come reads."""
    for t in tables:
        if t is not None and (path := _PLACES.pop(t, None)):
            _remove(t.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffles of plans that nothing refers to any more, which it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are. Pure ASCII takes the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(*of: Column) -> Column:
    """A hash that names a row by its id and text (and more), the same in every pass over the input."""
    return F.xxhash64(*of)


def own_column(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def record(df: DataFrame) -> Column:
    """A whole row as one struct ``record``, so that no name of the input meets a name of the operator."""
    return F.struct(*(own_column(c) for c in df.columns)).alias("record")


def columns(df: DataFrame) -> list[tuple[str, Column]]:
    """The names of ``df`` and its columns as they stand in ``record``."""
    return [(c, F.col("record").getField(c).alias(c)) for c in df.columns]


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", *others: str) -> DataFrame:
    """``docs`` without the rows that ``gone`` (doc_id, row) names; row: ``row_key`` of the id and the other columns (``text``).

    Only a list that a count proves small is broadcast.
    """
    away = cut(gone.select(F.col("doc_id").alias("of"), "row").distinct(), "gone")
    away = away.hint("broadcast" if away.count() <= BROADCAST_ROWS else "merge")
    own = docs.select(record(docs), F.col(id_col).alias("id"), row_key(F.col(id_col), *map(F.col, others or ("text",))).alias("key"))
    return own.join(away, (own["key"] == away["row"]) & own["id"].eqNullSafe(away["of"]), "left_anti").select(*(v for _, v in columns(docs)))


def schema_with(df: DataFrame, more: str) -> T.StructType:
    """The columns of ``df`` and those of a DDL string, all of them nullable."""
    fields = [*df.schema.fields, *T.StructType.fromDDL(more).fields]
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
