"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly by seeded hashes: a record's shard is the one that scores highest in rendezvous
hashing of its id (so one more shard takes rows only into itself), its bucket within the shard a hash of the whole record.
A shard has as many buckets as bring their mean to ``bucket_bytes``, whatever its size.
Pass 2 takes one bucket at a time into memory, brings it into a canonical order, applies a seeded Fisher-Yates shuffle
and writes it: a folder per shard, with each record's bucket and its place there. Counts of the written buckets say
where each starts among the shard's slots, so the slots are gapless.

The order depends on the seed and the records alone (for spread repetitions also on their numbers), so a retried task repeats it.

Defined results: a null text weighs ``overhead`` bytes; records with a null id share a shard, spread over its buckets;
records that repeat in all columns are interchangeable and get a slot each: where they would fill more than a quarter of
a bucket they are spread over the shard's buckets by their numbers in the input. Records keep all their columns inside
``record``, whatever their names and types. An empty table returns no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, own_column, record, schema_with, shared_dir

#: The counts of at most so many buckets, and so many repeated records, are broadcast; more are joined by a shuffle.
BROADCAST_BUCKETS = 100_000
#: Tasks of pass 2 at most; beyond, a task takes several buckets one after the other.
MOST_TASKS = 20_000


def _hashable(column: Column, kind: T.DataType) -> Column:
    """The column, or its text where it holds a map or variant, which Spark does not hash."""
    text = kind.simpleString()
    return F.to_json(F.struct(column)) if "map<" in text or "variant" in text else column


def _limited(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS else df


def rendezvous(key: Column, n_shards: int, seed: int) -> tuple[Column, Column]:
    """The shard of a key among ``n_shards``, and among one more."""

    def scored(j: int) -> Column:
        return F.struct(F.xxhash64(key, F.lit(seed), F.lit(j)).alias("score"), F.lit(j).alias("shard"))

    best = F.greatest(*map(scored, range(n_shards))) if n_shards > 1 else scored(0)
    grown = F.greatest(best, scored(n_shards))
    return best["shard"], grown["shard"]


def write(
    docs: DataFrame, path: str, n_shards: int = 24, seed: int = 20, bucket_bytes: int = 32 << 20, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Both passes: every row of ``docs`` as Parquet below ``path``, a folder per shard, files in order of bucket and place."""
    own, grown = rendezvous(F.col(id_col), n_shards, seed)
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + overhead
    digest = F.xxhash64(*(_hashable(own_column(f.name), f.dataType) for f in docs.schema), F.lit(seed))
    marked = docs.select(record(docs), size.alias("size"), own.alias("shard"), grown.alias("grown_shard"), digest.alias("digest"))
    weights = cut(marked.groupBy("shard", "digest").agg(F.sum("size").alias("n"), F.count("*").alias("times")), "weights")
    heavy = weights.where((F.col("times") > 1) & (F.col("n") > bucket_bytes // 4)).select("digest", F.lit(True).alias("heavy"))
    bytes_of = {r.shard: r.n for r in weights.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row per shard
    buckets = [max(1, -(-bytes_of.get(k, 0) // bucket_bytes)) for k in range(n_shards)]
    before = [sum(buckets[:k]) for k in range(n_shards)]
    of_shard = lambda some: F.element_at(F.array(*map(F.lit, some)), F.col("shard") + 1)
    spread = F.when(F.col("heavy"), F.xxhash64("digest", F.monotonically_increasing_id())).otherwise(F.col("digest"))
    # At most four heavy digests for each bucket's worth of bytes.
    scattered = marked.join(_limited(heavy), "digest", "left").withColumn("bucket", F.pmod(spread, of_shard(buckets)).cast("int")).drop("heavy")
    tasks = min(sum(buckets), MOST_TASKS)
    dealt = scattered.withColumn("bucket_id", of_shard(before) + F.col("bucket"))
    dealt = dealt.repartitionById(tasks, F.pmod("bucket_id", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket_id")

    def fisher_yates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _by_bucket(batches):
            order = np.argsort(bucket.column("digest").to_numpy(), kind="stable")
            draw = np.random.Generator(np.random.PCG64([seed, bucket.column("shard")[0].as_py(), bucket.column("bucket")[0].as_py()]))
            draw.shuffle(order)  # numpy's Fisher-Yates
            for at in range(0, len(order), 4096):
                some = bucket.take(pa.array(order[at : at + 4096])).drop_columns(["digest", "bucket_id"])
                yield from some.append_column("place", pa.array(np.arange(at, at + len(some), dtype=np.int64))).combine_chunks().to_batches()

    dealt = dealt.select("record", "size", "shard", "grown_shard", "bucket", "digest", "bucket_id")
    out = schema_with(dealt.drop("digest", "bucket_id"), "place long")
    done = dealt.mapInArrow(fisher_yates, out)
    done.sortWithinPartitions("shard", "bucket", "place").write.partitionBy("shard").parquet(path)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of batches sorted by bucket_id, a table for each bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("bucket_id")).to_numpy()
        edges = [0, *(np.nonzero(np.diff(ids))[0] + 1), len(ids)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and held[-1].column("bucket_id")[0].as_py() != ids[a]:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``record, size, shard, grown_shard, bucket, slot`` of written shards. schema: that of the documents."""
    fields = [T.StructField("record", schema), *T.StructType.fromDDL("size long, grown_shard int, bucket int, place long, shard int").fields]
    rows = spark.read.schema(T.StructType(fields)).parquet(path)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    return rows.join(_limited(bases), ["shard", "bucket"]).select("record", "size", "shard", "grown_shard", "bucket", (F.col("base") + F.col("place")).alias("slot"))


def shuffled(docs: DataFrame, **options) -> DataFrame:
    """``record, size, shard, grown_shard, bucket, slot`` for every row of ``docs``, written below the shared folder and read from there."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/logfold/shards-{uuid.uuid4().hex}"
    write(docs, path, **options)
    return read_shards(spark, path, docs.schema)
