"""Incremental tables: positional lists kept as a log of changes (schemas.INC_LOG).

Ids are places counted from the oldest entry, from 0. Lists that only grow or are overwritten are read with
a window; lists with inserts are folded in the order of seq (`state`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline.errors import Conflict, InvalidRequest
from tessaline.schemas import ADD, DROP, INSERT, OVERWRITE, SKIP, TOP, UNKEY

ENTRY = "struct<entry_key:string,payload:binary,skip:boolean>"
LIST = ["table", "key"]


def sizes(requests: DataFrame) -> DataFrame:
    """The entry size of each list: that of its first write (schemas.INC_META) from (table, key, seq, entry_size)."""
    valid = requests.where(F.col("entry_size") > 0)
    return valid.groupBy(*LIST).agg(F.min_by("entry_size", "seq").cast("bigint").alias("entry_size"))


def checked(log: DataFrame, meta: DataFrame) -> DataFrame:
    """The log with `warning` where a request's size isn't the stored one; too long entries raise an error."""
    out = log.join(meta.withColumnRenamed("entry_size", "stored_size"), LIST)
    fits = F.coalesce(F.octet_length("payload"), F.lit(0)) <= F.col("stored_size")
    ok = F.when(fits, F.col("payload")).otherwise(F.raise_error(F.lit("entry longer than the entry size")).cast("binary"))
    out = out.withColumn("payload", ok)
    if "entry_size" in log.columns:
        differs = F.col("entry_size").isNotNull() & (F.col("entry_size") != F.col("stored_size"))
        out = out.withColumn("warning", F.when(differs, F.lit("entry size differs; the stored one is used")))
    return out


def positions(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """Adds id, the place of each row of an append-only list."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("id", (F.row_number().over(w) - 1).cast("bigint"))


def _at(x: Column, n: Column, one_more: int) -> Column:
    """The place that a change means: counted from the newest (top) or the oldest."""
    return F.when(F.coalesce(x["count_from"], F.lit(TOP)) == TOP, n - (1 - one_more) - x["pos"]).otherwise(x["pos"])


def state(log: DataFrame) -> DataFrame:
    """Rows (table, key, id, entry_key, payload, skip) of all lists after all their changes.

    Changes before the last drop don't count. A place outside the list is an error, as is a key that another entry has. One list is folded in
    one task, and each insert costs its length; `compacted` turns its log into plain appends.
    """
    last_drop = F.max(F.when(F.col("op") == DROP, F.col("seq"))).over(Window.partitionBy(*LIST))
    live = log.withColumn("dropped", last_drop).where("dropped is null or seq > dropped")
    change = F.struct("seq", "op", "pos", "count_from", "entry_key", "payload")
    lists = live.groupBy(*LIST).agg(F.array_sort(F.collect_list(change)).alias("changes"))
    empty = F.array().cast(f"array<{ENTRY}>")

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc)
        entry = F.struct(x["entry_key"].alias("entry_key"), x["payload"].alias("payload"), F.lit(False).alias("skip")).cast(ENTRY)
        bad = F.raise_error(F.concat(F.lit("no such place: "), F.coalesce(x["pos"].cast("string"), F.lit("null")))).cast(f"array<{ENTRY}>")
        i, j = _at(x, n, 1), _at(x, n, 0)
        inserted = F.concat(F.slice(acc, F.lit(1), i.cast("int")), F.array(entry), F.slice(acc, (i + 1).cast("int"), n))

        # A key may be at one place only; setting it where it is changes nothing.
        twice = F.size(F.filter(acc, lambda e, k: (e["entry_key"] == x["entry_key"]) & ((x["op"] != OVERWRITE) | (k != j)))) > 0
        keyed = x["op"].isin(ADD, INSERT, OVERWRITE) & x["entry_key"].isNotNull()
        clash = F.raise_error(F.concat(F.lit("another entry has the key "), x["entry_key"])).cast(f"array<{ENTRY}>")

        def put(f) -> Column:
            return F.transform(acc, lambda old, k: F.when(k == j, f(old)).otherwise(old))

        over = put(lambda old: F.struct(F.coalesce(x["entry_key"], old["entry_key"]).alias("entry_key"), x["payload"].alias("payload"), F.lit(False).alias("skip")).cast(ENTRY))
        skip = put(lambda old: F.struct(old["entry_key"].alias("entry_key"), old["payload"].alias("payload"), F.lit(True).alias("skip")).cast(ENTRY))
        unkey = put(lambda old: F.struct(F.lit(None).cast("string").alias("entry_key"), old["payload"].alias("payload"), old["skip"].alias("skip")).cast(ENTRY))
        here = (j >= 0) & (j < n)
        return (
            F.when(keyed & twice, clash)
            .when(x["op"] == ADD, F.concat(acc, F.array(entry)))
            .when((x["op"] == INSERT) & (i >= 0) & (i <= n), inserted)
            .when((x["op"] == OVERWRITE) & here, over).when((x["op"] == SKIP) & here, skip).when((x["op"] == UNKEY) & here, unkey)
            .otherwise(bad)
        )

    folded = lists.select(*LIST, F.posexplode(F.aggregate("changes", empty, step)).alias("id", "e"))
    return folded.select(*LIST, F.col("id").cast("bigint").alias("id"), "e.*")


def compacted(lists: DataFrame) -> DataFrame:
    """The log of plain appends (and skips) that gives these lists; ids become seq."""
    adds = lists.select(*LIST, F.col("id").alias("seq"), F.lit(ADD).alias("op"), F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("count_from"), "entry_key", "payload")
    n = F.count("*").over(Window.partitionBy(*LIST))
    skips = lists.withColumn("n", n).where("skip").select(*LIST, (F.col("n") + F.col("id")).alias("seq"), F.lit(SKIP).alias("op"), F.col("id").alias("pos"), F.lit("bottom").alias("count_from"), F.lit(None).cast("string").alias("entry_key"), F.lit(None).cast("binary").alias("payload"))
    return adds.unionByName(skips)


def first_entries(lists: DataFrame, n: int, by: list[str] = LIST) -> DataFrame:
    """The n oldest entries of each list; skipped ones go after the cut, so ids can have gaps."""
    w = Window.partitionBy(*by).orderBy("id")
    return lists.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).where(~F.coalesce("skip", F.lit(False))).drop("rn")


def last_entries(lists: DataFrame, n: int, by: list[str] = LIST) -> DataFrame:
    """The n newest entries of each list, local_id 0 the newest; skipped ones go after the cut."""
    w = Window.partitionBy(*by).orderBy(F.desc("id"))
    kept = lists.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).where(~F.coalesce("skip", F.lit(False)))
    return kept.withColumn("local_id", (F.col("rn") - 1).cast("bigint")).drop("rn")


def by_id(lists: DataFrame, n: int) -> DataFrame:
    """The entry at a place of each list; skipped ones are not found."""
    if n < 0:
        raise InvalidRequest("ids begin at 0")
    return lists.where((F.col("id") == n) & ~F.coalesce("skip", F.lit(False)))


def by_key(lists: DataFrame, entry_key: str) -> DataFrame:
    """The entry with an entry key in each list."""
    if not entry_key:
        raise InvalidRequest("an entry key is needed")
    return lists.where((F.col("entry_key") == entry_key) & ~F.coalesce("skip", F.lit(False)))


def check_entry_keys(lists: DataFrame, new: DataFrame) -> DataFrame:
    """Passes new rows (table, key, entry_key, ...) on; a key that is there already, or twice in them, is a conflict.

    Rows with an id overwrite that place: a key that is there already is no conflict.
    """
    keyed = new.where(F.col("entry_key").isNotNull())
    held = lists.select(*LIST, "entry_key", *([F.col("id").alias("held_at")] if "id" in new.columns else [])).distinct()
    taken = keyed.join(held, [*LIST, "entry_key"])
    if "id" in new.columns:
        taken = taken.where(~F.col("held_at").eqNullSafe(F.col("id")))
    twice = keyed.groupBy(*LIST, "entry_key").count().where("count > 1")
    clash = taken.select(*LIST, "entry_key").union(twice.select(*LIST, "entry_key")).first()
    if clash:
        raise Conflict(f"{clash['table']}/{clash['key']} has {clash['entry_key']}")
    return new


def record_count(lists: DataFrame, meta: DataFrame) -> DataFrame:
    """Records of each list and the bytes of their fixed-width file."""
    counts = lists.groupBy(*LIST).agg(F.count("*").alias("n"))
    return counts.join(meta, LIST).select(*LIST, "n", (F.col("n") * (F.col("entry_size") + 3)).alias("file_bytes"))
