"""The corpus pipeline: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm import common, cotrain, queries, simhash, tiling, winnow
from tessaline.llm.packing import pack


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the co-trained classifier rejects.

    Each row is judged by itself, so rows that share an id or have none don't touch each other. A null text is
    judged as an empty one; an empty table stays empty; without labels all rows stay.
    """
    return cotrain.accepted_rows(docs, _table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes later repeated runs of lines (five words or more) out of the texts; all rows stay.

    Rows of one id and one text lose the same lines; null ids come last in the order of places; a null text stays null.
    n_chars is that of the text left (0 of a null).
    """
    kept = winnow.dedup_lines(docs).select(docs.columns)
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies (5-word shingles, similarity 0.8).

    The row of the smallest id stays (null ids last), then of the smallest text hash, then the smallest by its columns
    in order; so one row stays of rows that share an id and a text. All blank and null texts are one group.
    """
    near = simhash.near_copies(docs)
    first = near.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "own")).alias("first"))
    first = first.select(F.coalesce(F.col("first.id").cast("string"), F.lit("")).alias("__id"), F.col("first.own").alias("__own"))
    first = common.written(first, "near-kept")
    keys = {"__id": F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), "__own": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))}
    kept = docs.withColumns(keys).join(first, ["__id", "__own"], "left_semi")
    return kept.groupBy("__id", "__own").agg(F.min(F.struct(*(F.col(c) for c in docs.columns))).alias("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that cover half of a benchmark item or more.

    Each row is judged by itself, whatever its id; null and empty texts are clean; an empty benchmark leaves all rows.
    """
    return tiling.clean_rows(docs, _table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the packed sequences; null texts, null and repeated ids are packed as they come."""
    return pack(docs, queries.bpe_path())


STAGES = [
    ("quality_cotraining", quality), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination), ("packing", packing),
]
#: No SQL: learned weights and greedy tiles; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
