"""Request metrics and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def requests(rows: DataFrame, duration: Column, at: Column) -> DataFrame:
    """One row: count, total, whole average and the last request."""
    d = duration.cast("bigint")
    return rows.agg(F.count("*").alias("requests"), F.sum(d).alias("total_ns"), F.max(at).alias("last_request")).select(
        "requests", "total_ns", F.when(F.col("requests") > 0, F.floor(F.col("total_ns") / F.col("requests"))).alias("avg_ns"), "last_request"
    )


def timings(rows: DataFrame, name: Column, duration: Column) -> DataFrame:
    return rows.groupBy(name.alias("name")).agg(F.count("*").alias("calls"), F.sum(duration).alias("total"), F.avg(duration).alias("average"))


def alive(peers: DataFrame, now: Column, idle_seconds: int = 11) -> DataFrame:
    """Peers (address, last_active) heard of within the idle limit."""
    return peers.where(F.unix_seconds(now) - F.unix_seconds("last_active") <= idle_seconds)


def network(peers: DataFrame, server_ip: str = "", port: int = 0, pending: int = 0) -> DataFrame:
    """One row: this server, the sorted addresses of connected peers, their number, and answers that are awaited."""
    found = peers.agg(F.sort_array(F.collect_set("address")).alias("peers"))
    return found.select(
        F.lit(server_ip).alias("server_ip"), F.lit(port).alias("port"), F.size("peers").cast("bigint").alias("connected_peers"), "peers",
        F.lit(pending).cast("bigint").alias("pending_responses"),
    )


def api(rows: DataFrame, duration_ns: Column, at: Column, started: Column, now: Column) -> DataFrame:
    """One row: seconds since the start, requests, their average in milliseconds, and the last one's time."""
    found = requests(rows, duration_ns, at)
    return found.select(
        (F.unix_micros(now) - F.unix_micros(started)).cast("double").alias("micros"), F.col("requests").alias("total_requests"),
        F.coalesce(F.col("avg_ns") / 1e6, F.lit(0.0)).alias("average_response_ms"), F.col("last_request"),
    ).select((F.col("micros") / 1e6).alias("uptime_seconds"), "total_requests", "average_response_ms", "last_request")


def health(api_: DataFrame, subscriptions: DataFrame, net: DataFrame) -> DataFrame:
    """One row with the status and the three reports; each has one row."""
    one = lambda df, alias: df.select(F.lit(1).alias("j"), F.struct("*").alias(alias))
    out = one(api_, "api").join(one(subscriptions, "subscriptions"), "j").join(one(net, "network"), "j")
    return out.select(F.lit("ok").alias("status"), F.current_timestamp().alias("timestamp"), "api", "subscriptions", "network")
