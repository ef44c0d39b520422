"""The change feed and its subscriptions.

subscriptions: rows (conn, table, key, expires_at); a null table stands for every table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaline.schemas import FREE, SAVE

TTL_SECONDS = 60


def grant(keys: DataFrame, now: Column, ttl: int = TTL_SECONDS, auth_key: Column | None = None) -> DataFrame:
    """A single-use auth key for each row of keys (table, keys), good for `ttl` seconds; rows without keys get none."""
    given = F.uuid() if auth_key is None else auth_key
    return keys.where(F.size("keys") > 0).withColumns({"auth_key": given, "expires_at": now + F.expr(f"INTERVAL {ttl} SECONDS")})


def _used(grants: DataFrame, attempts: DataFrame, now: Column | None) -> DataFrame:
    """The first attempt (auth_key, conn, at) on each grant in its time; later ones find the key used up."""
    when = F.col("at") if now is None else now
    met = attempts.join(grants.select("auth_key", "expires_at"), "auth_key").where(when <= F.col("expires_at"))
    return met.groupBy("auth_key").agg(F.min(F.struct("at", "conn")).alias("first")).select("auth_key", "first.conn", "first.at")


def attach(grants: DataFrame, attempts: DataFrame, now: Column | None = None) -> DataFrame:
    """Bindings (conn, table, key) of attempts (conn, auth_key, at) with a good auth key; only the first use counts.

    An attempt's time is `at`; with `now` all are of that time, and `at` is their order.
    """
    return grants.join(_used(grants, attempts, now), "auth_key").select("conn", "table", F.explode("keys").alias("key")).distinct()


def refused(grants: DataFrame, attempts: DataFrame, now: Column | None = None) -> DataFrame:
    """Attempts with an unknown, expired or used auth key."""
    return attempts.join(_used(grants, attempts, now), ["auth_key", "conn", "at"], "left_anti").withColumn("error", F.lit("invalid_or_expired_auth_key"))


def pending(grants: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """Grants that still wait for their use."""
    return grants.where(F.col("expires_at") >= now).join(_used(grants, attempts, None), "auth_key", "left_anti")


def disable(bindings: DataFrame, keys: DataFrame) -> DataFrame:
    """Bindings without those of the keys (table, key)."""
    return bindings.join(keys.select("table", "key").distinct(), ["table", "key"], "left_anti")


def unsubscribed(bindings: DataFrame, keys: DataFrame) -> DataFrame:
    """The message (conn, key, message) for each binding that `disable` ends."""
    gone = bindings.join(keys.select("table", "key").distinct(), ["table", "key"], "left_semi")
    return gone.select("conn", "key", F.to_json(F.struct(F.lit("unsubscribed").alias("event"), "key")).alias("message"))


def notified(bindings: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows (key, notified): connections told that the key is disabled; 0 where none was bound."""
    told = unsubscribed(bindings, keys).groupBy("key").agg(F.countDistinct("conn").alias("n"))
    return keys.select("key").distinct().join(told, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("notified"))


def stats(bindings: DataFrame, waiting: DataFrame | None = None) -> DataFrame:
    """One row: connections, keys with bindings, bindings, and, if given, auth keys that wait for their use."""
    found = bindings.agg(F.countDistinct("conn").alias("clients"), F.countDistinct("table", "key").alias("keys"), F.count("*").alias("bindings"))
    if waiting is None:
        return found
    return found.crossJoin(waiting.agg(F.count("*").alias("pending")))  # one row each


def events(log: DataFrame) -> DataFrame:
    """Change events (table, key, event, data) of a key-value log, batch or stream."""
    kind = F.when(F.col("op") == SAVE, "updated").when(F.col("op") == FREE, "deleted")
    return log.select("table", "key", "seq", kind.alias("event"), F.when(F.col("op") == SAVE, F.col("payload").cast("string")).alias("data"))


def list_events(log: DataFrame) -> DataFrame:
    """Change events of list changes (table, key, seq, op, id, payload)."""
    body = F.struct(F.col("op").alias("type"), F.struct(F.col("id").cast("string").alias("id"), F.col("payload").cast("string").alias("data")).alias("new_data"))
    return log.select("table", "key", "seq", F.lit("inc_table_update").alias("event"), F.to_json(body).alias("data"))


def fan_out(changes: DataFrame, bindings: DataFrame) -> DataFrame:
    """A message (conn, seq, message) for each change and connection bound to its key.

    The first `deleted` after a binding began (column `since`, else from the start) is its last message: the binding
    ends there. For a batch of changes, or a stream's batches one by one (`run_batches`).
    """
    since = F.col("since") if "since" in bindings.columns else F.lit(None).cast("bigint")
    b = bindings.select("conn", F.col("table").alias("bound"), F.col("key").alias("bound_key"), since.alias("since"))
    on = (F.col("key") == F.col("bound_key")) & (F.col("bound").isNull() | (F.col("bound") == F.col("table"))) & (F.col("since").isNull() | (F.col("seq") >= F.col("since")))
    # One row for each binding and table, however many changes there are.
    last = changes.where(F.col("event") == "deleted").join(b, on).groupBy("conn", "bound", "bound_key", "since").agg(F.min("seq").alias("until"))
    last = last.select(F.col("conn").alias("c"), F.col("bound").alias("t"), F.col("bound_key").alias("k"), F.col("since").alias("s"), "until")
    b = b.join(last, (F.col("conn") == F.col("c")) & F.col("bound").eqNullSafe(F.col("t")) & (F.col("bound_key") == F.col("k")) & F.col("since").eqNullSafe(F.col("s")), "left").drop("c", "t", "k", "s")
    met = changes.join(b, on & (F.col("until").isNull() | (F.col("seq") <= F.col("until"))))
    return met.select("conn", "seq", F.to_json(F.struct("event", "key", "data")).alias("message"))


def ended(changes: DataFrame, bindings: DataFrame) -> DataFrame:
    """The bindings that a `deleted` among the changes ends."""
    gone = changes.where(F.col("event") == "deleted").select(F.col("table").alias("t"), F.col("key").alias("k")).distinct()
    return bindings.join(gone, (F.col("key") == F.col("k")) & (F.col("table").isNull() | (F.col("table") == F.col("t"))), "left_semi")


def run_batches(changes: DataFrame, bindings: Callable[[], DataFrame], deliver: Callable[[DataFrame, int], None], checkpoint: str, unbind: Callable[[DataFrame], None] | None = None):
    """Starts the feed: each micro-batch is matched with the bindings of that moment and handed to `deliver`; those
    that it ends go to `unbind`, so that the next batch finds them gone."""

    def batch(df: DataFrame, number: int) -> None:
        now = bindings()
        deliver(fan_out(df, now), number)
        if unbind:
            unbind(ended(df, now))

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream(spark: SparkSession, folder: str, schema: T.StructType | str, files: str = "*.parquet") -> DataFrame:
    """The rows of a folder's files, as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def latest_stream(changes: DataFrame, key: Column, value: Column, order: Column, path: str, checkpoint: str):
    """Keeps the latest value of each key of a stream as files: each batch appends the keys that it changed, with its number.

    `latest_of` reads them. State is a row for each key on the executors; nothing comes to the driver.
    """
    state = changes.groupBy(key.alias("key")).agg(F.max_by(value, order).alias("value"))

    def append(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return state.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows (key, value) of `latest_stream` as of its last batch. schema: of a file, the batch's number last."""
    rows = spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*")
    return rows.groupBy("key").agg(F.max_by("value", "batch").alias("value"))


def quiet_sessions(changes: DataFrame, at: Column, key: Column, gap: str = "60 seconds", late: str = "5 minutes") -> DataFrame:
    """Sessions of each key that end after a gap without a change (an extension; late rows are left out)."""
    rows = changes.select(key.alias("key"), at.cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy(F.session_window("at", gap).alias("w"), "key").agg(F.count("*").alias("changes")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes")
