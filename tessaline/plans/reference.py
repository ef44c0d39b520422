"""Named queries over the key-value, incremental-table and related operators, each with its SQL.

The bundled tables carry them: events are a key-value log (key: user, value: event type, a free for `error`),
conversations are incremental tables (one for each conversation), orders, customers, nations and regions
are a chain of references.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.functions import codec, names
from tessaline.operators import inc, kv, metrics, refs, space
from tessaline.plans.catalog import Catalog
from tessaline.schemas import ADD, BOTTOM, DROP, FREE, INSERT, OVERWRITE, SAVE, TOP, UNKEY
from tessaline.session import shared_folder, table
from tessaline.sources import store, wal
from tessaline.streaming import feed

SECRET = "correct horse"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """events as a log: seq orders by time and event."""
    e = table(spark, sf, "events")
    op = F.when(F.col("event_type") == "error", FREE).otherwise(SAVE)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.lit("events").alias("table"), F.col("user_id").cast("string").alias("key"), op.alias("op"), F.struct(micros.alias("us"), "event_id").alias("order"),
        (micros * 1_000 + F.col("event_id") % 1_000).alias("seq"), F.col("event_type").cast("binary").alias("payload"), F.lit(False).alias("encrypted"), F.col("ts").cast("timestamp").alias("ts"),
    )


def _ordered(spark: SparkSession, sf: str) -> DataFrame:
    """The event log with seq unique: the number of the event."""
    return event_log(spark, sf).withColumn("seq", F.col("order.event_id"))


LAST = "SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {} DESC) = 1"


@query(f"SELECT user_id AS key, event_type AS value FROM ({LAST.format('ts DESC, event_id')})")
def kv_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("key")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("value"))


@query(f"SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value FROM ({LAST.format('event_id')}) WHERE event_type <> 'error'")
def kv_latest_after_free(spark: SparkSession, sf: str) -> DataFrame:
    return kv.latest(_ordered(spark, sf)).select("key", codec.as_text(F.col("payload")).alias("value"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS value FROM orders WHERE o_orderkey = 7")
def kv_point_read(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where(F.col("o_orderkey") == 7)
    log = kv.save(o, F.lit("orders"), F.col("o_orderkey"), F.col("o_orderkey"), F.col("o_orderpriority"))
    return kv.read(log, "orders", "7").select("key", codec.as_text(F.col("payload")).alias("value"))


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)")
def kv_multi_read(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, sf, "orders").join(keys, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return kv.save(table(spark, sf, "customer"), F.lit("customer"), F.col("c_name"), F.col("c_custkey"), F.col("c_mktsegment"))


@query("SELECT c_name AS key FROM customer WHERE regexp_matches(c_name, '[[:digit:]]*7[0-3]$')")
def kv_keys_by_regex(spark: SparkSession, sf: str) -> DataFrame:
    return kv.keys_by_regex(_names(spark, sf), "customer", "[[:digit:]]*7[0-3]$")


@query("SELECT DISTINCT c_name AS key FROM customer WHERE regexp_matches(c_name, '^C.*5') ORDER BY key LIMIT 10")
def kv_keys_by_regex_limit(spark: SparkSession, sf: str) -> DataFrame:
    return kv.keys_by_regex(_names(spark, sf), "customer", "^C.*5", 10)


@query("SELECT conv_id, turn, text FROM conversations")
def kv_encrypted_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    sealed = c.withColumn("sealed", codec.encrypt(F.col("text").cast("binary"), SECRET))
    return sealed.select("conv_id", "turn", codec.decrypt(F.col("sealed"), SECRET).cast("string").alias("text"))


@query("SELECT conv_id, turn, CAST(NULL AS VARCHAR) AS text, CAST(octet_length(encode(text)) + 28 AS BIGINT) AS sealed_bytes FROM conversations")
def kv_wrong_key(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    sealed = c.withColumn("sealed", codec.encrypt(F.col("text").cast("binary"), SECRET))
    return sealed.select("conv_id", "turn", codec.decrypt(F.col("sealed"), "wrong").cast("string").alias("text"), F.octet_length("sealed").cast("bigint").alias("sealed_bytes"))


HEADER = """'01' || CASE WHEN n + 2 < 256 THEN '0102' || lpad(to_hex(n + 2), 2, '0')
    WHEN n + 2 < 65536 THEN '0202' || lpad(to_hex((n + 2) % 256), 2, '0') || lpad(to_hex((n + 2) // 256), 2, '0')
    ELSE '0402' || lpad(to_hex((n + 2) % 256), 2, '0') || lpad(to_hex((n + 2) // 256 % 256), 2, '0') || lpad(to_hex((n + 2) // 65536 % 256), 2, '0') || lpad(to_hex((n + 2) // 16777216), 2, '0') END"""


@query(f"SELECT doc_id, {HEADER} || hex(encode(text)) AS envelope FROM (SELECT doc_id, text, octet_length(encode(text)) AS n FROM documents)")
def envelope_encode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.hex(codec.encode_envelope(F.col("text").cast("binary"))).alias("envelope"))


@query("SELECT doc_id, text FROM documents")
def envelope_decode(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "documents").withColumn("raw", codec.encode_envelope(F.col("text").cast("binary")))
    return raw.select("doc_id", codec.as_text(codec.decode_envelope(F.col("raw"))).alias("text"))


@query("SELECT conv_id, turn, lpad('01' || hex(encode(role)), 38, '0') AS record FROM conversations")
def inc_record_encode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.hex(codec.encode_record(F.col("role").cast("binary"), 16)).alias("record"))


@query("SELECT conv_id, turn, role FROM conversations")
def inc_record_decode(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "conversations").withColumn("raw", codec.encode_record(F.col("role").cast("binary"), 16))
    return raw.select("conv_id", "turn", codec.decode_record(F.col("raw")).cast("string").alias("role"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(trim(p_brand || '/' || p_type), '[/\\\\:*?\"<>|]', '_', 'g'), '\\.\\.', '__', 'g') AS name FROM part")
def sanitized_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", names.sanitize(F.concat_ws("/", "p_brand", "p_type")).alias("name"))


@query("SELECT o_orderkey, 'orders' AS tab, CAST(o_orderkey AS VARCHAR) AS key FROM orders")
def parsed_paths(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/read/orders/"), F.col("o_orderkey").cast("string"), F.lit("/extra"))
    return table(spark, sf, "orders").select("o_orderkey", names.path_argument(path, 0).alias("tab"), names.path_argument(path, 1).alias("key"))


# --- incremental tables ------------------------------------------------------------------------------------------


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    return inc.positions(table(spark, sf, "conversations"), ["conv_id"], ["turn"])


def _adds(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None)
    return table(spark, sf, "conversations").select(
        F.lit("chat").alias("table"), F.col("conv_id").cast("string").alias("key"), F.col("turn").cast("bigint").alias("seq"), F.lit(ADD).alias("op"), none.cast("bigint").alias("pos"),
        none.cast("string").alias("count_from"), F.concat_ws("-", "conv_id", "turn").alias("entry_key"), F.col("role").cast("binary").alias("payload"),
    )


def _change(log: DataFrame, op: str, pos: int, count_from: str, payload: str, seq: int = 1 << 40) -> DataFrame:
    one = log.select("table", "key").distinct()
    return log.unionByName(one.select(
        "table", "key", F.lit(seq).cast("bigint").alias("seq"), F.lit(op).alias("op"), F.lit(pos).cast("bigint").alias("pos"), F.lit(count_from).alias("count_from"),
        F.lit(None).cast("string").alias("entry_key"), F.lit(payload).cast("binary").alias("payload"),
    ))


def _shown(lists: DataFrame) -> DataFrame:
    return lists.select(F.col("key").cast("bigint").alias("conv_id"), "id", codec.as_text(F.col("payload")).alias("role"))


PLACED = "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS id, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations"


@query(f"SELECT conv_id, turn, CAST(id AS BIGINT) AS id FROM ({PLACED})")
def inc_positions(spark: SparkSession, sf: str) -> DataFrame:
    return _positions(spark, sf).select("conv_id", "turn", "id")


@query(f"SELECT conv_id, CAST(id AS BIGINT) AS id, role FROM ({PLACED}) WHERE id = 2")
def inc_read_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return inc.by_id(_positions(spark, sf).withColumn("skip", F.lit(False)), 2).select("conv_id", "id", "role")


@query(f"SELECT conv_id, CAST(n - 1 - id AS BIGINT) AS local_id, role, text FROM ({PLACED}) WHERE n - 1 - id < 3")
def inc_last_n(spark: SparkSession, sf: str) -> DataFrame:
    return inc.last_entries(_positions(spark, sf).withColumn("skip", F.lit(False)), 3, ["conv_id"]).select("conv_id", "local_id", "role", "text")


@query(f"SELECT conv_id, CAST(id AS BIGINT) AS id, role, text FROM ({PLACED}) WHERE id < 2")
def inc_first_n(spark: SparkSession, sf: str) -> DataFrame:
    return inc.first_entries(_positions(spark, sf).withColumn("skip", F.lit(False)), 2, ["conv_id"]).select("conv_id", "id", "role", "text")


@query(f"SELECT conv_id, CAST(n - 1 - id AS BIGINT) AS local_id, role FROM ({PLACED}) WHERE n - 1 - id < 3 AND role <> 'user'")
def inc_last_n_skip(spark: SparkSession, sf: str) -> DataFrame:
    return inc.last_entries(_positions(spark, sf).withColumn("skip", F.col("role") == "user"), 3, ["conv_id"]).select("conv_id", "local_id", "role")


@query(f"SELECT conv_id, CAST(id AS BIGINT) AS id, CASE WHEN id = n - 1 THEN 'edited' ELSE role END AS role FROM ({PLACED})")
def inc_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(inc.state(_change(_adds(spark, sf), OVERWRITE, 0, TOP, "edited")))


def _inserted(at: str) -> str:
    return f"SELECT conv_id, CAST(CASE WHEN id >= {at} THEN id + 1 ELSE id END AS BIGINT) AS id, role FROM ({PLACED}) UNION ALL SELECT conv_id, CAST({at} AS BIGINT), 'inserted' FROM (SELECT DISTINCT conv_id, n FROM ({PLACED}))"


@query(_inserted("n - 1"))
def inc_insert_top(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(inc.state(_change(_adds(spark, sf), INSERT, 1, TOP, "inserted")))


@query(_inserted("1"))
def inc_insert_bottom(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(inc.state(_change(_adds(spark, sf), INSERT, 1, BOTTOM, "inserted")))


@query(f"SELECT conv_id, CAST(id AS BIGINT) AS id, role FROM ({PLACED}) WHERE conv_id || '-' || turn = '3-1'")
def inc_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(inc.by_key(inc.state(_adds(spark, sf)), "3-1"))


@query("SELECT conv_id, count(*) AS n, CAST(count(*) * 19 AS BIGINT) AS file_bytes FROM conversations GROUP BY conv_id")
def inc_record_count(spark: SparkSession, sf: str) -> DataFrame:
    log = _adds(spark, sf)
    meta = inc.sizes(log.withColumn("entry_size", F.lit(16)))
    return inc.record_count(log, meta).select(F.col("key").cast("bigint").alias("conv_id"), "n", "file_bytes")


@query("SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS id, event_type FROM events e WHERE event_id > coalesce((SELECT max(event_id) FROM events d WHERE d.user_id = e.user_id AND d.event_type = 'error'), -1)")
def inc_delete_reset(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    log = e.select(
        F.lit("events").alias("table"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", DROP).otherwise(ADD).alias("op"),
        F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("count_from"), F.lit(None).cast("string").alias("entry_key"), F.col("event_type").cast("binary").alias("payload"),
    )
    return inc.state(log).select(F.col("key").cast("bigint").alias("user_id"), "id", codec.as_text(F.col("payload")).alias("event_type"))


@query("SELECT conv_id, role, max(octet_length(encode(text))) AS longest, CASE WHEN max(octet_length(encode(text))) <> 16 THEN 'entry size differs; the stored one is used' END AS warning FROM conversations GROUP BY conv_id, role")
def inc_size_warning(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.max(F.octet_length("text").cast("bigint")).alias("entry_size"))
    log = c.select(F.lit("chat").alias("table"), F.col("conv_id").cast("string").alias("key"), "role", "entry_size", F.lit("x").cast("binary").alias("payload"))
    meta = log.select("table", "key").distinct().withColumn("entry_size", F.lit(16).cast("bigint"))
    return inc.checked(log, meta).select(F.col("key").cast("bigint").alias("conv_id"), "role", F.col("entry_size").alias("longest"), "warning")


# --- references --------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def ptr_resolve_all(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    steps = [("o_custkey", t("customer"), "c_custkey", "c"), ("c.c_nationkey", t("nation"), "n_nationkey", "n"), ("n.n_regionkey", t("region"), "r_regionkey", "r")]
    return refs.resolve(t("orders"), steps).select("o_orderkey", "c.c_name", "n.n_name", "r.r_name")


@query("SELECT o_orderkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def ptr_resolve_some(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    return refs.resolve(t("orders"), [("o_custkey", t("customer"), "c_custkey", "c")]).select("o_orderkey", "c.c_name", "c.c_nationkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5)")
def ptr_dangling(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "part").where("p_size > 5")
    return refs.dangling(table(spark, sf, "lineitem"), "l_partkey", found, "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


EDGES = "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'r' || r_regionkey, 'n' || (r_regionkey * 3) FROM region"


@query(f"""WITH RECURSIVE e AS ({EDGES}), walk AS (
  SELECT src AS root, src AS node, 0 AS depth, [src] AS path, false AS loop FROM (SELECT DISTINCT src FROM e)
  UNION ALL SELECT root, dst, depth + 1, list_append(path, dst), list_contains(path, dst) FROM walk JOIN e ON node = src WHERE NOT loop)
SELECT root, node, CAST(min(depth) AS BIGINT) AS depth, bool_or(loop) AS loop FROM walk GROUP BY root, node""")
def ptr_recursive_depth(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    edges = n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst")).union(
        r.select(F.concat(F.lit("r"), "r_regionkey"), F.concat(F.lit("n"), F.col("r_regionkey") * 3)))
    return refs.reachable(edges, edges.select(F.col("src").alias("root")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, 'nation' AS to_table, CAST(c_nationkey AS VARCHAR) AS to_key FROM customer")
def ptr_fields(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    body = F.to_json(F.struct(F.array(F.col("c_nationkey").cast("string"), F.lit("nation")).alias("$ptr_nation"), F.col("c_name").alias("name"), F.array(F.lit(1), F.lit(2)).alias("pair")))
    objects = c.select(F.lit("customer").alias("table"), F.col("c_custkey").cast("string").alias("key"), body.alias("json"))
    return refs.pointers(objects).select("key", "to_table", "to_key")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus ELSE o_orderpriority END AS value FROM orders")
def read_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    key, seq = F.col("o_orderkey"), F.col("o_orderkey")
    local = kv.save(o.where("o_orderstatus = 'F'"), F.lit("orders"), key, seq, F.col("o_orderstatus"))
    peer = kv.save(o, F.lit("orders"), key, seq, F.col("o_orderpriority"))
    return kv.with_fallback(local, peer).select("key", codec.as_text(F.col("payload")).alias("value"))


# --- storage -----------------------------------------------------------------------------------------------------


@query("SELECT 'events' AS tab, count(*) AS rows, CAST(sum(octet_length(encode(event_type))) AS BIGINT) AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn > 1 AND event_type <> 'error'")
def space_reclaimable(spark: SparkSession, sf: str) -> DataFrame:
    return space.reclaimable(_ordered(spark, sf)).withColumnRenamed("table", "tab")


@query("SELECT 'events' AS tab, count(*) FILTER (event_type = 'error') AS frees, count(*) FILTER (event_type <> 'error') AS saves FROM events")
def space_counters(spark: SparkSession, sf: str) -> DataFrame:
    return space.counters(_ordered(spark, sf)).withColumnRenamed("table", "tab")


BLOCKS = "SELECT p_brand AS file, CAST(p_partkey * 100 AS BIGINT) AS s, CAST(p_partkey * 100 + p_size AS BIGINT) AS e FROM part"


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_brand").alias("file"), (F.col("p_partkey") * 100).alias("start"), (F.col("p_partkey") * 100 + F.col("p_size")).alias("end"))


@query(f"SELECT file, s AS first, e AS last, e - s AS size FROM ({BLOCKS}) WHERE e - s >= 20 QUALIFY row_number() OVER (PARTITION BY file ORDER BY e - s, s, e) = 1")
def space_best_fit(spark: SparkSession, sf: str) -> DataFrame:
    return space.best_fit(_blocks(spark, sf), 20).select("file", F.col("start").alias("first"), F.col("end").alias("last"), "size")


@query(f"SELECT file, s AS first, s + 3 AS last FROM ({BLOCKS}) WHERE e - s > 5 UNION ALL SELECT file, s + 5, e FROM ({BLOCKS}) WHERE e - s > 5 UNION ALL SELECT file, s, e FROM ({BLOCKS}) WHERE e - s <= 5 AND s < e")
def space_subtract(spark: SparkSession, sf: str) -> DataFrame:
    b = _blocks(spark, sf)
    used = b.where("end - start > 5").select("file", (F.col("start") + 3).alias("start"), (F.col("start") + 5).alias("end"))
    return space.subtract(b, used).select("file", F.col("start").alias("first"), F.col("end").alias("last"))


@query(f"SELECT CAST(user_id AS VARCHAR) AS key, event_type AS file, CAST(event_id AS BIGINT) AS first, CAST(event_id + 5 AS BIGINT) AS last FROM ({LAST.format('event_id')}) WHERE event_type <> 'error'")
def wal_replay(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    user, event = F.col("user_id").cast("string"), F.col("event_id")
    line = F.when(F.col("event_type") == "error", F.concat_ws("|", F.lit("D"), user)).otherwise(F.concat_ws("|", F.lit("S"), user, "event_type", event.cast("string"), (event + 5).cast("string")))
    broken = e.limit(0).select(F.lit("S|bad|x|5|2").alias("value"), event.alias("seq")).union(e.sparkSession.createDataFrame([("S|bad|x|5|2", 1 << 50), ("nonsense", 1 << 51)], "value string, seq bigint"))
    return wal.replay(e.select(line.alias("value"), event.alias("seq")).union(broken)).select("key", "file", F.col("start").alias("first"), F.col("end").alias("last"))


@query("SELECT doc_id, CAST(i AS BIGINT) AS chunk_no, substr(hex(encode(text)), CAST(i * 2000 + 1 AS BIGINT), 2000) AS chunk FROM documents, generate_series(0, greatest(CAST(ceil(octet_length(encode(text)) / 1000.0) AS BIGINT) - 1, 0)) AS g(i)")
def value_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of every document, as hex: a chunk may end within a letter."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))
    return store.chunks(d, "payload", 1000).select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.hex("chunk").alias("chunk"))


# --- metrics and feed --------------------------------------------------------------------------------------------


@query("SELECT count(*) AS requests, CAST(sum(CAST(trunc(value * 1000) AS BIGINT)) AS BIGINT) AS total_ns, CAST(floor(sum(CAST(trunc(value * 1000) AS BIGINT)) / count(*)) AS BIGINT) AS avg_ns, max(event_id) AS last_request FROM events")
def health_request_stats(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.requests(table(spark, sf, "events"), (F.col("value") * 1000).cast("bigint"), F.col("event_id"))


@query("SELECT event_type AS name, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 6) AS average FROM events GROUP BY event_type")
def timing_by_name(spark: SparkSession, sf: str) -> DataFrame:
    t = metrics.timings(table(spark, sf, "events"), F.col("event_type"), F.col("value"))
    return t.select("name", "calls", F.round("total", 4).alias("total"), F.round("average", 6).alias("average"))


BOUND = "SELECT DISTINCT 'conn' || (user_id % 7) AS conn, CAST(user_id AS VARCHAR) AS key FROM events"


def _bindings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.concat(F.lit("conn"), F.col("user_id") % 7).alias("conn"), F.lit("events").alias("table"), F.col("user_id").cast("string").alias("key")).distinct()


GRANTED = "SELECT user_id, min(ts) AS granted, min(ts) + INTERVAL 1 DAY AS good_to FROM events GROUP BY user_id"
ATTEMPTS = f"SELECT e.user_id, 'conn' || event_id AS conn, ts AS tried, good_to FROM events e JOIN ({GRANTED}) g ON e.user_id = g.user_id AND ts > granted"
ATTACHED = f"SELECT user_id, conn, tried FROM ({ATTEMPTS}) WHERE tried <= good_to QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY tried, conn) = 1"


def _grants(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each user's first event grants its key for a day; every later one is an attempt to use the grant."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    first = e.groupBy("user_id").agg(F.min("ts").alias("granted"))
    keys = first.select(F.lit("events").alias("table"), F.array(F.col("user_id").cast("string")).alias("keys"), "user_id", "granted")
    grants = feed.grant(keys, F.col("granted"), 86_400, F.md5(F.col("user_id").cast("string")))
    attempts = e.join(first, "user_id").where("ts > granted").select(F.md5(F.col("user_id").cast("string")).alias("auth_key"), F.concat(F.lit("conn"), "event_id").alias("conn"), F.col("ts").alias("at"))
    return grants, attempts


@query(f"SELECT conn, CAST(user_id AS VARCHAR) AS key FROM ({ATTACHED})")
def feed_grant_attach(spark: SparkSession, sf: str) -> DataFrame:
    return feed.attach(*_grants(spark, sf)).select("conn", "key")


@query(f"SELECT a.conn, 'invalid_or_expired_auth_key' AS error FROM ({ATTEMPTS}) a LEFT JOIN ({ATTACHED}) b ON a.user_id = b.user_id AND a.conn = b.conn WHERE b.conn IS NULL")
def feed_refused(spark: SparkSession, sf: str) -> DataFrame:
    return feed.refused(*_grants(spark, sf)).select("conn", "error")


@query("SELECT count(DISTINCT user_id) AS granted, count(DISTINCT user_id) AS distinct_keys FROM events")
def auth_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A key minted for each user: as many different ones as users."""
    users = table(spark, sf, "events").select(F.lit("events").alias("table"), F.array(F.col("user_id").cast("string")).alias("keys")).distinct()
    return feed.grant(users, F.current_timestamp()).agg(F.count("*").alias("granted"), F.countDistinct("auth_key").alias("distinct_keys"))


@query(f"SELECT (SELECT count(DISTINCT conn) FROM ({BOUND})) AS clients, (SELECT count(DISTINCT key) FROM ({BOUND})) AS keys, (SELECT count(*) FROM ({BOUND})) AS bindings, count(*) AS pending FROM ({GRANTED}) g WHERE user_id NOT IN (SELECT user_id FROM ({ATTACHED})) AND good_to >= (SELECT max(granted) FROM ({GRANTED}))")
def subscription_stats(spark: SparkSession, sf: str) -> DataFrame:
    grants, attempts = _grants(spark, sf)
    latest = grants.agg(F.max("granted").alias("now"))
    waiting = feed.pending(grants.crossJoin(latest), attempts, F.col("now"))  # one row
    return feed.stats(_bindings(spark, sf), waiting)


FIRST_DELETE = "SELECT user_id, min(event_id) AS gone FROM events WHERE event_type = 'error' GROUP BY user_id"
FANOUT = f"""SELECT conn, event_id AS seq, CASE WHEN event_type = 'error' THEN '{{"event":"deleted","key":"' || b.key || '"}}' ELSE '{{"event":"updated","key":"' || b.key || '","data":"' || event_type || '"}}' END AS message
  FROM events e JOIN ({BOUND}) b ON b.key = CAST(e.user_id AS VARCHAR) LEFT JOIN ({FIRST_DELETE}) d ON d.user_id = e.user_id WHERE gone IS NULL OR event_id <= gone"""


@query(FANOUT)
def feed_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """The messages of all changes; a deleted key's bindings end with it."""
    return feed.fan_out(feed.events(_ordered(spark, sf)), _bindings(spark, sf))


@query(f"SELECT count(*) FILTER (message LIKE '%deleted%') AS deleted, count(*) FILTER (message LIKE '%updated%') AS updated, count(DISTINCT conn) AS clients FROM ({FANOUT})")
def feed_delete_removes(spark: SparkSession, sf: str) -> DataFrame:
    m = feed.fan_out(feed.events(_ordered(spark, sf)), _bindings(spark, sf))
    return m.agg(F.count_if(F.col("message").contains("deleted")).alias("deleted"), F.count_if(F.col("message").contains("updated")).alias("updated"), F.countDistinct("conn").alias("clients"))


@query(f"SELECT conn, event_id AS seq FROM events e JOIN ({BOUND}) b ON b.key = CAST(e.user_id AS VARCHAR) LEFT JOIN ({FIRST_DELETE}) d ON d.user_id = e.user_id WHERE gone IS NULL OR event_id <= gone")
def feed_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The feed run over the event files as a stream: delivered messages are appended as files."""
    root = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    raw = feed.stream(spark, sf, table(spark, sf, "events").schema, "events.parquet")
    op = F.when(F.col("event_type") == "error", FREE).otherwise(SAVE)
    log = raw.select(F.lit("events").alias("table"), F.col("user_id").cast("string").alias("key"), op.alias("op"), F.col("event_id").alias("seq"), F.col("event_type").cast("binary").alias("payload"))
    bound = _bindings(spark, sf)
    running = feed.run_batches(feed.events(log), lambda: bound, lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/state")
    running.awaitTermination()
    return spark.read.schema("conn string, seq bigint, message string").parquet(f"{root}/out/batch=*").select("conn", "seq")


LOW_KEYS = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events WHERE CAST(user_id AS VARCHAR) < '5'"


def _low_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _bindings(spark, sf).where("key < '5'").select("table", "key").distinct()


@query(f"SELECT conn, key FROM ({BOUND}) WHERE key >= '5'")
def feed_disable(spark: SparkSession, sf: str) -> DataFrame:
    return feed.disable(_bindings(spark, sf), _low_keys(spark, sf)).select("conn", "key")


@query(f"SELECT conn, '{{\"event\":\"unsubscribed\",\"key\":\"' || key || '\"}}' AS message FROM ({BOUND}) WHERE key < '5'")
def feed_unsubscribed(spark: SparkSession, sf: str) -> DataFrame:
    return feed.unsubscribed(_bindings(spark, sf), _low_keys(spark, sf)).select("conn", "message")


@query(f"SELECT key, count(DISTINCT conn) AS notified FROM ({BOUND}) WHERE key < '5' GROUP BY key UNION ALL SELECT 'nobody', 0")
def feed_notified(spark: SparkSession, sf: str) -> DataFrame:
    keys = _low_keys(spark, sf)
    return feed.notified(_bindings(spark, sf), keys.union(keys.sparkSession.createDataFrame([("events", "nobody")], keys.schema)))


@query(f"SELECT conv_id, CAST(id AS BIGINT) AS seq, '{{\"type\":\"add\",\"new_data\":{{\"id\":\"' || id || '\",\"data\":\"' || role || '\"}}}}' AS data FROM ({PLACED})")
def feed_inc_update_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = _positions(spark, sf).select(F.lit("chat").alias("table"), F.col("conv_id").alias("key"), F.col("id").alias("seq"), F.lit(ADD).alias("op"), "id", F.col("role").cast("binary").alias("payload"))
    return feed.list_events(rows).select(F.col("key").alias("conv_id"), "seq", "data")


@query(SQL["kv_latest"])
def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The latest values, kept by a stream over the event files."""
    changes = feed.stream(spark, sf, table(spark, sf, "events").schema, "events.parquet")
    root = f"{shared_folder(spark)}/latest-{uuid.uuid4().hex}"
    feed.latest_stream(changes, F.col("user_id"), F.col("event_type"), F.struct("ts", "event_id"), f"{root}/out", f"{root}/state").awaitTermination()
    return feed.latest_of(spark, f"{root}/out", "key bigint, value string, batch int")


# --- operators seen through a query of their own ------------------------------------------------------------------


@query("SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS key, text AS value FROM conversations")
def kv_save_encrypted(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    log = kv.save_encrypted(c, F.lit("chat"), F.concat_ws("-", "conv_id", "turn"), F.col("turn"), F.col("text"), SECRET)
    return kv.read_encrypted(log, SECRET).select("key", codec.as_text(F.col("payload")).alias("value"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS value FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def kv_read_many(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderkey")
    log = kv.save(table(spark, sf, "orders"), F.lit("orders"), o, o, F.col("o_orderstatus"))
    keys = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.lit("orders").alias("table"), F.col("l_orderkey").cast("string").alias("key"))
    return kv.read_many(log, keys).select("key", codec.as_text(F.col("payload")).alias("value"))


def _keyed(lists: DataFrame) -> DataFrame:
    return lists.select(F.col("key").cast("bigint").alias("conv_id"), "id", "entry_key")


def _change_key(log: DataFrame, op: str, pos: int, count_from: str, prefix: str) -> DataFrame:
    changed = _change(log, op, pos, count_from, "edited")
    return changed.withColumn("entry_key", F.when(F.col("seq") == 1 << 40, F.concat(F.lit(prefix), "key")).otherwise(F.col("entry_key")))


KEYED = f"SELECT conv_id, id, n, conv_id || '-' || turn AS entry_key FROM ({PLACED})"


@query(f"SELECT conv_id, CAST(CASE WHEN id >= 1 THEN id + 1 ELSE id END AS BIGINT) AS id, entry_key FROM ({KEYED}) UNION ALL SELECT DISTINCT conv_id, 1, 'new-' || conv_id FROM conversations")
def entry_key_insert(spark: SparkSession, sf: str) -> DataFrame:
    return _keyed(inc.state(_change_key(_adds(spark, sf), INSERT, 1, BOTTOM, "new-")))


@query(f"SELECT conv_id, CAST(id AS BIGINT) AS id, CASE WHEN id = n - 1 THEN 'set-' || conv_id ELSE entry_key END AS entry_key FROM ({KEYED})")
def entry_key_set(spark: SparkSession, sf: str) -> DataFrame:
    return _keyed(inc.state(_change_key(_adds(spark, sf), OVERWRITE, 0, TOP, "set-")))


@query(f"SELECT conv_id, CAST(id AS BIGINT) AS id, CASE WHEN id > 0 THEN entry_key END AS entry_key FROM ({KEYED})")
def entry_key_remove(spark: SparkSession, sf: str) -> DataFrame:
    return _keyed(inc.state(_change(_adds(spark, sf), UNKEY, 0, BOTTOM, "")))


@query("SELECT p_partkey, lpad(to_hex(p_size), 2, '0') || '00000000000000' || lpad(to_hex(octet_length(encode(p_name))), 2, '0') || '000000' || hex(encode(p_name)) AS meta, CAST(p_size AS BIGINT) AS entry_size, p_name AS name FROM part")
def meta_codec(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "part").withColumn("raw", codec.encode_meta(F.col("p_size"), F.col("p_name")))
    m = codec.decode_meta(F.col("raw"))
    return raw.select("p_partkey", F.hex("raw").alias("meta"), m["entry_size"].alias("entry_size"), m["name"].alias("name"))


@query("SELECT n_nationkey, 'nation_' || n_name AS field, n_name AS plain FROM nation")
def ptr_stripped(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", names.strip_pointer(F.concat(F.lit("$ptr_nation_"), "n_name")).alias("field"), names.strip_pointer(F.col("n_name")).alias("plain"))


def _objects(spark: SparkSession, sf: str) -> DataFrame:
    """Customers, nations and regions as JSON objects that point at each other."""
    def objects(name: str, key: str, *fields) -> DataFrame:
        return table(spark, sf, name).select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*fields)).alias("json"))

    point = lambda key, to: F.array(F.col(key).cast("string"), F.lit(to)).alias(f"$ptr_{to}")
    return objects("customer", "c_custkey", F.col("c_name").alias("name"), point("c_nationkey", "nation")).union(
        objects("nation", "n_nationkey", F.col("n_name").alias("name"), point("n_regionkey", "region"))).union(objects("region", "r_regionkey", F.col("r_name").alias("name")))


NATION_JSON = """'{"name":"' || n_name || '","region":{"name":"' || r_name || '"}}'"""


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS key, '{{"name":"' || c_name || '","nation":' || coalesce({NATION_JSON}, 'null') || '}}' AS json
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def ptr_json_resolved(spark: SparkSession, sf: str) -> DataFrame:
    return refs.resolve_json(_objects(spark, sf), 2).where(F.col("table") == "customer").select("key", "json")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS key, '{"$ptr_other":["1","region"],"region":{"name":"' || r_name || '"}}' AS json FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'lost', '{"$ptr_other":["1","region"],"region":null}'""")
def ptr_json_some(spark: SparkSession, sf: str) -> DataFrame:
    """Only one of two pointer fields is followed; a target that isn't there is null."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_regionkey").cast("string").alias("to"))
    n = n.union(n.sparkSession.createDataFrame([("lost", "nowhere")], "key string, to string"))
    body = F.to_json(F.struct(F.array("to", F.lit("region")).alias("$ptr_region"), F.array(F.lit("1"), F.lit("region")).alias("$ptr_other")))
    objects = n.select(F.lit("pairs").alias("table"), "key", body.alias("json")).union(_objects(spark, sf).where(F.col("table") == "region"))
    return refs.resolve_json(objects, 1, ["$ptr_region"]).where(F.col("table") == "pairs").select("key", "json")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS key, 'label' AS field, 'not a pointer' AS reason FROM supplier
  UNION ALL SELECT CAST(s_suppkey AS VARCHAR), '$ptr_pair', 'not a pointer' FROM supplier
  UNION ALL SELECT CAST(s_suppkey AS VARCHAR), '$ptr_nation', 'no target' FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1)""")
def ptr_object_check(spark: SparkSession, sf: str) -> DataFrame:
    """What suppliers' pointer objects may not have: a field without the prefix, one that is no pair, targets not there."""
    body = F.to_json(F.struct(F.array(F.col("s_nationkey").cast("string"), F.lit("nation")).alias("$ptr_nation"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("$ptr_pair"), F.col("s_name").alias("label")))
    objects = table(spark, sf, "supplier").select(F.lit("supplier").alias("table"), F.col("s_suppkey").cast("string").alias("key"), body.alias("json"))
    there = table(spark, sf, "nation").where("n_regionkey <> 1").select(F.lit("nation").alias("table"), F.col("n_nationkey").cast("string").alias("key"))
    return refs.invalid_pointers(objects, there).select("key", "field", "reason")


@query("SELECT c_custkey, substr(c_name, 3, 7) AS part FROM customer")
def range_read(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", store.read_range(F.col("c_name").cast("binary"), 2, 9).cast("string").alias("part"))


@query(f"SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value, 2 AS versions FROM ({LAST.format('event_id')}) WHERE event_type <> 'error'")
def store_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended to a stored log in two writes, compacted, and read as the plain rows of the new version."""
    logs = store.LogStore(spark, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}")
    log = _ordered(spark, sf)
    logs.append(log.where("op = 'S'"))
    logs.append(log.where("op = 'D'"))
    logs.compact()
    return logs.log().select("key", codec.as_text(F.col("payload")).alias("value"), F.lit(len(logs._versions())).alias("versions"))


@query("SELECT 'part' || p_partkey AS key, CASE WHEN p_size > 25 THEN 'moved' ELSE p_brand END AS file, CAST(p_partkey AS BIGINT) AS first, CAST(p_partkey + p_size AS BIGINT) AS last FROM part WHERE p_size > 10")
def snapshot_replay(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot's lines, and after them a log that moves and frees some."""
    p = table(spark, sf, "part")
    key, span = F.concat(F.lit("part"), "p_partkey"), [F.col("p_partkey").cast("string"), (F.col("p_partkey") + F.col("p_size")).cast("string")]
    old = p.select(F.concat_ws("|", key, "p_brand", *span).alias("value"), F.col("p_partkey").alias("seq"))
    line = F.when(F.col("p_size") > 25, F.concat_ws("|", F.lit("S"), key, F.lit("moved"), *span)).when(F.col("p_size") <= 10, F.concat_ws("|", F.lit("D"), key))
    new = p.select(line.alias("value"), (F.col("p_partkey") + (1 << 40)).alias("seq")).where("value is not null")
    return wal.replay(old.union(new)).select("key", "file", F.col("start").alias("first"), F.col("end").alias("last"))


@query("SELECT 'part' || p_partkey AS key, p_brand AS file FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def legacy_import(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    lines = p.select(F.concat_ws("|", F.concat(F.lit("part"), "p_partkey"), "p_brand", F.lit("0"), F.lit("5")).alias("value"), F.col("p_partkey").alias("seq"))
    brand = p.agg(F.min("p_brand")).first()[0]
    return wal.legacy(wal.replay(lines), brand).select("key", "file")


LAST_SEEN = "SELECT 'user' || user_id AS address, max(ts) AS last_active FROM events GROUP BY user_id"


def _peers(spark: SparkSession, sf: str) -> DataFrame:
    """Users as peers, heard of at their events; `now` is the last event of all."""
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    seen = e.groupBy(F.concat(F.lit("user"), "user_id").alias("address")).agg(F.max("ts").alias("last_active"))
    return seen.crossJoin(e.agg(F.max("ts").alias("now")))  # one row


MEMBERS = f"SELECT address FROM ({LAST_SEEN}) WHERE date_part('epoch', date_trunc('second', (SELECT max(ts) FROM events))) - date_part('epoch', date_trunc('second', last_active)) <= 86400"


@query(MEMBERS)
def network_members(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.alive(_peers(spark, sf), F.col("now"), 86_400).select("address")


NETWORK = f"SELECT '10.0.0.1' AS server_ip, 7000 AS port, count(*) AS connected_peers, coalesce(string_agg(address, ',' ORDER BY address), '') AS peers, CAST(3 AS BIGINT) AS pending FROM ({MEMBERS})"


def _network(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.network(metrics.alive(_peers(spark, sf), F.col("now"), 86_400), "10.0.0.1", 7000, 3)


@query(NETWORK)
def network_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _network(spark, sf).select("server_ip", "port", "connected_peers", F.array_join("peers", ",").alias("peers"), F.col("pending_responses").alias("pending"))


@query(f"""SELECT 'ok' AS status, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS uptime_seconds, count(*) AS total_requests,
  floor(sum(CAST(trunc(value * 1000) AS BIGINT)) / count(*)) / 1e6 AS average_response_ms, max(event_id) AS last_request,
  (SELECT count(*) FROM ({BOUND})) AS bindings, (SELECT connected_peers FROM ({NETWORK})) AS connected_peers FROM events""")
def health(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    ends = e.agg(F.min("at").alias("started"), F.max("at").alias("now")).first()
    api = metrics.api(e, (F.col("value") * 1000).cast("bigint"), F.col("event_id"), F.lit(ends["started"]), F.lit(ends["now"]))
    one = metrics.health(api, feed.stats(_bindings(spark, sf)), _network(spark, sf))
    return one.select("status", "api.*", "subscriptions.bindings", "network.connected_peers")


@query("SELECT * FROM (VALUES ('people', 'id', 'bigint', true), ('people', 'name', 'string', false), ('places', 'city', 'string', false)) t(table_name, column_name, kind, is_key)")
def declared_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Declared through one catalog and read through another of the same folder."""
    folder = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    first = Catalog(spark, folder)
    first.execute('{"query": "create_table", "tableName": "people", "columns": [{"name": "old", "type": "int"}]}')
    first.execute('{"query": "create_table", "tableName": "people", "columns": [{"name": "id", "type": "bigint", "isPrimaryKey": true}, {"name": "name", "type": "string"}]}')
    first.execute({"query": "create_table", "tableName": "places", "columns": [{"name": "city", "type": "string"}]})
    rows = Catalog(spark, folder).rows().select("table_name", F.explode("columns").alias("c"))
    return rows.select("table_name", F.col("c.name").alias("column_name"), F.col("c.type").alias("kind"), F.coalesce("c.isPrimaryKey", F.lit(False)).alias("is_key"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
