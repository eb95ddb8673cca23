"""A corpus made ready for training, in five stages.

Quality rules, line deduplication, near-duplicate removal, benchmark decontamination and encoding. Each stage reads
what its predecessor kept, written as Parquet; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.llm import decontaminate, linededup, pieces, quality, simhash
from logfold.llm.common import cut, read


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars brought up to date with the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; so do documents whose worded lines all went."""
    return _sized(linededup.keep(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of their five-word shingles of 0.8 or more, the least doc_id stays.

    SimHash fingerprints give links by the bit-sliced comparison, the shingle sets confirm them, and the sets' own join
    finds the links that lie beyond the fingerprints' radius.
    """
    return simhash.one_of_each(docs, words_per_shingle=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text."""
    found = pieces.encode(docs, pieces.default_model())
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("encoding", encoding),
]

#: The stages of divergence, components and merges have no SQL for the whole; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"stage-{i + 1}")
    return docs
