"""Shared pieces of the corpus operators: written tables, byte-bounded slices, tokens, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.session import shared_folder

#: Text bytes that a worker handles at once; a longer single text is handled alone.
SLICE_BYTES = 4 << 20


def written(df: DataFrame, label: str, group_bytes: int | None = None) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there and lost executors cost no recomputation.

    group_bytes: for rows of megabytes, the size of Parquet's row groups, which are written and read as a whole. Unless
    told otherwise Parquet looks at sizes every hundred rows only.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    if group_bytes:
        writer = writer.options(**{"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1})
    writer.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table.written_to = path
    return table


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """Holds a setting of the session within the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to."""
    gc.collect()
    spark._jvm.System.gc()


def trim() -> None:
    """Gives memory that this worker freed back to the system: workers live on, and others need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch with about `most` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        # Taken, not sliced: Arrow's string kernels misread arrays that begin within a buffer.
        yield batch.take(pa.array(np.arange(start, stop))) if start or stop < batch.num_rows else batch
        start = stop


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z only) words between ASCII white space, and the row of each word. A null has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    rows, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    keep = pc.not_equal(words, "")
    return words.filter(keep), rows.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64)


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Of sorted row numbers, where each of n rows begins and ends: n + 1 offsets."""
    return np.searchsorted(rows, np.arange(n + 1))


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of the undirected `edges` (a, b long): rows (node, root), root the smallest node.

    Alternates large-star and small-star steps, each a partial aggregate and an equi-join, until no edge
    changes. Nodes without an edge to another have no row. Every round is a written table.
    """
    e = written(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        label,
    )
    seen = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = e.where("u != v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = written(e.select("e.*").where("u != v").distinct(), label)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
