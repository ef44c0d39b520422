"""Key-value operators: views over an append-only log of saves and frees (schemas.KV_LOG).

Saving and freeing are appended rows; the state of a key is its row of the greatest seq. Every view is one
aggregate on (table, key) with partial aggregation before the shuffle, so a hot key costs no more than others. As
payloads are of any width, it sorts each task's rows by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.errors import InvalidRequest, NotFound
from tessaline.functions import codec, names
from tessaline.schemas import FREE, SAVE


def operation(rows: DataFrame, op: str, table: Column, key: Column, seq: Column, payload: Column | None = None, encrypted: bool = False) -> DataFrame:
    """Log rows from any table."""
    empty = F.lit(None).cast("binary")
    return rows.select(
        table.cast("string").alias("table"), key.cast("string").alias("key"), F.lit(op).alias("op"), seq.cast("bigint").alias("seq"),
        (empty if payload is None else payload.cast("binary")).alias("payload"), F.lit(encrypted).alias("encrypted"), F.current_timestamp().alias("ts"),
    )


def save(rows: DataFrame, table: Column, key: Column, seq: Column, payload: Column) -> DataFrame:
    return operation(rows, SAVE, table, key, seq, payload)


def save_encrypted(rows: DataFrame, table: Column, key: Column, seq: Column, payload: Column, secret: str) -> DataFrame:
    return operation(rows, SAVE, table, key, seq, codec.encrypt(payload.cast("binary"), secret), True)


def free(rows: DataFrame, table: Column, key: Column, seq: Column) -> DataFrame:
    return operation(rows, FREE, table, key, seq)


def latest(log: DataFrame) -> DataFrame:
    """The last value of every key that wasn't freed since: (table, key, seq, payload, encrypted).

    Rows without a key or with a blank table are not keys. Of equal seq the save wins, then the greater payload.
    """
    valid = log.where(F.col("key").isNotNull() & (F.trim("table") != ""))
    state = F.struct("seq", "op", F.coalesce("payload", F.unhex(F.lit(""))).alias("payload"), "encrypted")
    last = valid.groupBy("table", "key").agg(F.max(state).alias("s"))
    return last.where(F.col("s.op") == SAVE).select("table", "key", "s.seq", "s.payload", "s.encrypted")


def read(log: DataFrame, table: str, key: str) -> DataFrame:
    """The row of one key; the equality reaches the scan. No row if there is none."""
    if not table or not table.strip() or not key:
        raise InvalidRequest("table and key are needed")
    return latest(log.where((F.col("table") == table) & (F.col("key") == key)))


def read_value(log: DataFrame, table: str, key: str, secret: str | None = None) -> bytes:
    """The value of one key, decrypted with `secret`."""
    rows = read(log, table, key).limit(1)
    row = (rows.withColumn("payload", codec.decrypt(F.col("payload"), secret, strict=True)) if secret is not None else rows).first()
    if row is None:
        raise NotFound(f"{table}/{key}")
    return bytes(row["payload"])


def read_many(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of all (table, key) in keys."""
    return latest(log.join(keys.select("table", "key").distinct(), ["table", "key"], "left_semi"))


def read_encrypted(log: DataFrame, secret: str) -> DataFrame:
    """The latest values, decrypted; null with a wrong key."""
    return latest(log).withColumn("payload", codec.decrypt(F.col("payload"), secret))


def keys_by_regex(log: DataFrame, table: str, pattern: str, most: int = 0) -> DataFrame:
    """Keys of a table that hold a match anywhere, in order; `most` of them if positive.

    An anchored pattern's literal beginning is also asked for as a prefix, which the scan can use.
    """
    if not table or not table.strip():
        raise InvalidRequest("a table is needed")
    prefix = names.literal_prefix(pattern)
    rows = log.where(F.col("table") == table)
    if prefix:
        rows = rows.where(F.col("key").startswith(prefix))
    rows = rows.where(F.col("key").rlike(names.java_pattern(pattern)))
    last = rows.groupBy("key").agg(F.max(F.struct("seq", "op")).alias("s")).where(F.col("s.op") == SAVE)
    keys = last.select("key").orderBy("key")
    return keys.limit(most) if most > 0 else keys


def with_fallback(local: DataFrame, *peers: DataFrame) -> DataFrame:
    """Latest values of this node, and of other nodes for keys that it lacks: the first node that has one."""
    nodes = [latest(n).withColumn("node", F.lit(i)) for i, n in enumerate((local, *peers))]
    every = nodes[0]
    for n in nodes[1:]:
        every = every.unionByName(n)
    row = F.struct("seq", "payload", "encrypted", "node")
    return every.groupBy("table", "key").agg(F.min_by(row, "node").alias("r")).select("table", "key", "r.*")
