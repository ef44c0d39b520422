"""References between records: fields whose value names a key of another table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.errors import InvalidRequest
from tessaline.functions.names import POINTER, strip_pointer


def is_pointer(value: Column) -> Column:
    """Whether a JSON text is an array of two strings."""
    parsed = F.try_parse_json(value)
    kind = F.schema_of_variant(parsed)
    items = F.try_variant_get(parsed, "$", "array<string>")
    return F.coalesce((kind == "ARRAY<STRING>") & (F.size(items) == 2), F.lit(False))


def pointers(objects: DataFrame) -> DataFrame:
    """Rows (table, key, field, to_table, to_key) of the pointers in JSON objects (table, key, json)."""
    fields = objects.select("table", "key", F.explode(F.from_json("json", "map<string,string>")).alias("field", "value")).where(is_pointer(F.col("value")))
    pair = F.from_json("value", "array<string>")
    return fields.select("table", "key", "field", F.get(pair, 1).alias("to_table"), F.get(pair, 0).alias("to_key"))


def invalid_pointers(objects: DataFrame, existing: DataFrame) -> DataFrame:
    """What a pointer object can't have: fields without the prefix, other values, targets that aren't there."""
    fields = objects.select("table", "key", F.explode(F.from_json("json", "map<string,string>")).alias("field", "value"))
    shape = fields.where(~F.col("field").startswith(POINTER) | ~is_pointer(F.col("value"))).select("table", "key", "field", F.lit("not a pointer").alias("reason"))
    missing = pointers(objects).join(existing.select(F.col("table").alias("to_table"), F.col("key").alias("to_key")).distinct(), ["to_table", "to_key"], "left_anti")
    return shape.unionByName(missing.select("table", "key", "field", F.lit("no target").alias("reason")))


def _substituted(objects: DataFrame, resolved: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """JSON objects (table, key, json) with pointers (in `fields`, else all) replaced by the object they name, without prefix."""
    cells = objects.select("table", "key", F.explode_outer(F.expr("cast(try_parse_json(json) as map<string,variant>)")).alias("field", "value"))
    text = F.to_json("value")
    wanted = is_pointer(text) & (F.lit(True) if fields is None else F.col("field").isin(fields))
    pair = F.from_json(text, "array<string>")
    cells = cells.select("table", "key", "field", text.alias("text"), F.coalesce(wanted, F.lit(False)).alias("wanted"), F.when(wanted, F.get(pair, 0)).alias("to_key"), F.when(wanted, F.get(pair, 1)).alias("to_table"))
    target = resolved.select(F.col("table").alias("to_table"), F.col("key").alias("to_key"), F.col("json").alias("target"))
    met = cells.join(target, ["to_table", "to_key"], "left")
    name = F.when(F.col("wanted"), strip_pointer(F.col("field"))).otherwise(F.col("field"))
    value = F.when(F.col("wanted"), F.coalesce("target", F.lit("null"))).otherwise(F.coalesce("text", F.lit("null")))
    met = met.select("table", "key", name.alias("x"), value.alias("v"), "field", "wanted")
    cell = F.when(F.col("field").isNotNull(), F.struct(F.col("x").alias("n"), F.concat(F.to_json(F.expr("cast(x as variant)")), F.lit(":"), F.col("v")).alias("c")))
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["c"]), ",")
    return met.groupBy("table", "key").agg(F.concat(F.lit("{"), inner, F.lit("}")).alias("json"))


def resolve_json(objects: DataFrame, depth: int = 3, fields: list[str] | None = None) -> DataFrame:
    """Objects (table, key, json) with their pointers replaced by the objects named, nested, to `depth` levels.

    fields: only those of the outer object; what they name is resolved in full. A pointer without a target becomes null,
    pointers below `depth` levels (so all that loop) stay as they are. Fields are in the order of their names.
    """
    if depth < 1:
        raise InvalidRequest("a level at least")
    resolved = objects.select("table", "key", "json")
    for level in range(depth):
        resolved = _substituted(objects, resolved, fields if level == depth - 1 else None)
    return resolved


def resolve(rows: DataFrame, steps: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Follows one chain: for each (column, target, key of target, alias) a left join adds the target as a struct.

    A missing target is null. column may name a field of an earlier alias.
    """
    out = rows
    for column, target, key, alias in steps:
        side = target.select(F.col(key).alias("__key"), F.struct("*").alias(alias))
        out = out.join(side, F.col(column) == F.col("__key"), "left").drop("__key")
    return out


def dangling(rows: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no target."""
    return rows.join(target.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def reachable(edges: DataFrame, roots: DataFrame, most: int = 100) -> DataFrame:
    """Rows (root, node, depth, loop): what each root reaches over edges (src, dst), by recursion in SQL.

    loop marks a node that its own path already has; there the path ends. Of several paths the shortest counts.
    """
    spark = edges.sparkSession
    names = [f"refs_{uuid.uuid4().hex}" for _ in range(2)]
    edges.select("src", "dst").createOrReplaceTempView(names[0])
    roots.select("root").distinct().createOrReplaceTempView(names[1])
    return spark.sql(f"""
        WITH RECURSIVE walk MAX RECURSION LEVEL {most} AS (
          SELECT root, root AS node, 0 AS depth, array(root) AS path, false AS loop FROM {names[1]}
          UNION ALL
          SELECT w.root, e.dst, w.depth + 1, concat(w.path, array(e.dst)), array_contains(w.path, e.dst)
          FROM walk w JOIN {names[0]} e ON w.node = e.src WHERE NOT w.loop)
        SELECT root, node, CAST(min(depth) AS BIGINT) AS depth, bool_or(loop) AS loop FROM walk GROUP BY root, node""")
