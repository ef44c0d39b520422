"""Reading the line formats of a key index: snapshots and write-ahead logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.schemas import FREE, SAVE


def parse(lines: DataFrame) -> DataFrame:
    """Rows (op, key, file, start, end, seq) of text lines (value, seq); malformed lines are left out.

    Snapshot lines are key|file|start|end, log lines S|key|file|start|end and D|key.
    """
    p = F.split("value", r"\|")
    n = F.size(p)
    part = lambda i: F.try_element_at(p, F.lit(i + 1))
    saved, freed = (part(0) == SAVE) & (n == 5), (part(0) == FREE) & (n == 2)
    shift = F.when(saved, 1).otherwise(0)
    at = lambda i: F.try_element_at(p, (shift + i + 1).cast("int"))
    rows = lines.select(
        F.when(freed, FREE).otherwise(SAVE).alias("op"), F.when(freed, part(1)).otherwise(at(0)).alias("key"),
        F.when(~freed, at(1)).alias("file"), F.when(~freed, at(2)).try_cast("bigint").alias("start"), F.when(~freed, at(3)).try_cast("bigint").alias("end"), "seq",
        (saved | freed | (n == 4)).alias("known"),
    )
    valid = (F.col("op") == FREE) | ((F.col("start") >= 0) & (F.col("end") > F.col("start")))
    return rows.where(F.col("known") & F.coalesce(valid, F.lit(False)) & (F.col("key") != "")).drop("known")


def replay(lines: DataFrame) -> DataFrame:
    """The index (key, file, start, end) after all lines in the order of seq."""
    rows = parse(lines)
    last = rows.groupBy("key").agg(F.max_by(F.struct("op", "file", "start", "end"), "seq").alias("s"))
    return last.where(F.col("s.op") == SAVE).select("key", "s.file", "s.start", "s.end")


def legacy(rows: DataFrame, table: str) -> DataFrame:
    """Entries of an index shared by tables that belong to one."""
    return rows.where(F.col("file") == table)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of one file with their numbers (value, seq)."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.posexplode(F.split("value", "\r?\n")).alias("seq", "value")).where("value != ''")
