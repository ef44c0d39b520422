"""Declared tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessaline.errors import InvalidRequest, NotFound
from tessaline.schemas import SQL_TABLES


def struct_of(request: dict) -> T.StructType:
    """The schema of a request {tableName, columns}; primary key, default and byte limit become column metadata."""
    name, columns = (request.get("tableName") or "").strip(), request.get("columns") or []
    if not name or not columns:
        raise InvalidRequest("a table needs a name and a column")
    fields = []
    for c in columns:
        kind = T.StructType.fromDDL(f"`{c['name']}` {c['type']}")[0].dataType
        meta = {k: c[k] for k in ("isPrimaryKey", "default", "maxByteSize") if c.get(k) is not None}
        fields.append(T.StructField(c["name"], kind, not c.get("isPrimaryKey", False), meta))
    return T.StructType(fields)


class Catalog:
    """Executes requests with the verb create_table; other verbs are refused.

    With a folder, declarations last: each is a file of its name, replaced when the table is declared anew.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.tables, self.folder = spark, {}, folder.rstrip("/") if folder else None
        if self.folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                for row in spark.read.schema("request string").parquet(f"{self.folder}/*").collect():
                    self._declare(json.loads(row["request"]))

    def execute(self, request: str | dict) -> str:
        try:
            request = json.loads(request) if isinstance(request, str) else request
        except json.JSONDecodeError as e:
            raise InvalidRequest(f"malformed request: {e}") from e
        if request.get("query") != "create_table":
            raise InvalidRequest(f"unknown verb {request.get('query')!r}")
        name = self._declare(request)
        if self.folder:
            self.spark.createDataFrame([(json.dumps(request),)], "request string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return name

    def _declare(self, request: dict) -> str:
        struct = struct_of(request)
        name = re.sub(r"\W", "_", request["tableName"].strip())
        self.tables[name] = (struct, request["columns"])
        self.spark.createDataFrame([], struct).createOrReplaceTempView(name)
        return name

    def get(self, name: str) -> T.StructType:
        if name not in self.tables:
            raise NotFound(name)
        return self.tables[name][0]

    def rows(self) -> DataFrame:
        """The declared tables as rows (schemas.SQL_TABLES)."""
        out = [(n, [(c["name"], c["type"], c.get("isPrimaryKey"), c.get("default"), c.get("maxByteSize")) for c in cols]) for n, (_, cols) in self.tables.items()]
        return self.spark.createDataFrame(out, SQL_TABLES)
