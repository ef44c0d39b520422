"""Operation logs in Parquet: append, compaction with an atomic switch, range reads."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline import schemas
from tessaline.errors import Conflict, InvalidRequest
from tessaline.operators import kv


class LogStore:
    """A log (schemas.KV_LOG) in a folder, partitioned by table.

    Versions are folders, each with a manifest row in `_versions`; the last manifest counts. Compaction writes
    the latest view to a new version and then its manifest, so readers see the old version or the new one.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _manifests(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[str]:
        fs, path = self._manifests()
        if not fs.exists(path):
            return []
        rows = self.spark.read.schema("number bigint, folder string").json(f"{self.path}/_versions").orderBy("number").collect()
        return [r["folder"] for r in rows]

    def _commit(self, folder: str, number: int) -> None:
        """Writes manifest `number`, unless another writer did: a file is created once or not at all."""
        fs, path = self._manifests()
        fs.mkdirs(path)
        try:
            out = fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{number:012d}.json"), False)
        except Py4JJavaError as e:
            raise Conflict(f"version {number} was committed by another writer") from e
        out.write(bytearray(json.dumps({"number": number, "folder": folder}).encode()))
        out.close()

    def append(self, log: DataFrame) -> None:
        versions = self._versions()
        folder = versions[-1] if versions else f"v-{uuid.uuid4().hex}"
        log.select("table", "key", "op", "seq", "payload", "encrypted", "ts").write.mode("append").partitionBy("table").parquet(f"{self.path}/{folder}")
        if not versions:
            self._commit(folder, 0)

    def log(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], schemas.KV_LOG)
        return self.spark.read.schema(schemas.KV_LOG).parquet(f"{self.path}/{versions[-1]}")

    def compact(self) -> None:
        """Rewrites the log as the saves that still count. Nothing may be appended meanwhile."""
        folder, number = f"v-{uuid.uuid4().hex}", len(self._versions())
        last = kv.latest(self.log()).select("table", "key", F.lit(schemas.SAVE).alias("op"), "seq", "payload", "encrypted", F.current_timestamp().alias("ts"))
        last.write.partitionBy("table").parquet(f"{self.path}/{folder}")
        self._commit(folder, number)


def read_range(payload: Column, start: int, end: int) -> Column:
    """Bytes from start to before end; an error if the value is shorter."""
    if start < 0 or end < start:
        raise InvalidRequest("bad range")
    return F.when(F.octet_length(payload) >= end, F.substring(payload, start + 1, end - start)).otherwise(F.raise_error(F.lit("range past the end")).cast("binary"))


def read_chunk(payload: Column, offset: int, size: int) -> Column:
    """At most `size` bytes from an offset, less at the end."""
    return F.substring(payload, offset + 1, size)


def chunks(rows: DataFrame, payload: str, size: int) -> DataFrame:
    """Every value in pieces (chunk_no, chunk) of `size` bytes."""
    last = F.greatest(F.ceil(F.octet_length(payload) / F.lit(size)), F.lit(1)).cast("int")
    numbered = rows.select("*", F.explode(F.sequence(F.lit(0), last - 1)).alias("chunk_no"))
    return numbered.withColumn("chunk", F.col(payload).substr((F.col("chunk_no") * size + 1).cast("int"), F.lit(size)))


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows (path, length, content)."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")
