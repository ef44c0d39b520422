"""Edges of the operators: codecs, lists, references, storage, catalog, feed."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from tessaline import schemas
from tessaline.errors import Conflict, InvalidRequest, NotFound
from tessaline.functions import codec, names
from tessaline.operators import inc, kv, metrics, refs, space
from tessaline.plans.catalog import Catalog
from tessaline.sources import store, wal
from tessaline.streaming import feed


def one(spark, column, **values):
    kinds = {bytes: "binary", str: "string", int: "bigint", type(None): "binary"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n", [0, 1, 253, 254, 65533, 65534])
def test_envelope(spark, n):
    payload = bytes(i % 251 for i in range(n))
    raw = bytes(one(spark, codec.encode_envelope(F.col("p")), p=payload))
    end = n + 2
    size = 1 if end < 256 else 2 if end < 65536 else 4
    assert raw == bytes([1, size, 2]) + end.to_bytes(size, "little") + payload
    assert bytes(one(spark, codec.decode_envelope(F.col("p")), p=raw)) == payload


def test_envelope_of_eight_bytes_and_bad_sizes(spark):
    assert bytes(one(spark, codec.decode_envelope(F.col("p")), p=b"\1\x08\2" + (5).to_bytes(8, "little") + b"abc")) == b"abc"
    assert bytes(one(spark, codec.decode_envelope(F.col("p")), p=b"\1\3\2\5abc")) == b""
    assert one(spark, codec.encode_envelope(F.col("p")), p=None) is None


def test_records(spark):
    for payload in (b"", b"\1", b"\0\1x", b"x" * 8):
        raw = bytes(one(spark, codec.encode_record(F.col("p"), 8), p=payload))
        assert raw == (b"\1" + payload).rjust(11, b"\0")
        assert bytes(one(spark, codec.decode_record(F.col("p")), p=raw)) == payload
        hidden = bytes(one(spark, codec.set_skipped(F.col("p")), p=raw))
        assert one(spark, codec.is_skipped(F.col("p")), p=hidden) and not one(spark, codec.is_skipped(F.col("p")), p=raw)
        assert bytes(one(spark, codec.decode_record(F.col("p")), p=hidden)) == payload
    assert one(spark, codec.encode_record(F.col("p"), 8), p=b"x" * 9) is None
    assert bytes(one(spark, codec.decode_record(F.col("p")), p=b"\0" * 11)) == b""


def test_meta(spark):
    raw = bytes(one(spark, codec.encode_meta(F.col("n"), F.col("s")), n=16, s="liste-é.tbl"))
    assert raw == (16).to_bytes(8, "little") + (12).to_bytes(4, "little") + "liste-é.tbl".encode()
    assert tuple(one(spark, codec.decode_meta(F.col("p")), p=raw)) == (16, "liste-é.tbl")
    assert one(spark, codec.decode_meta(F.col("p")), p=raw[:-1]) is None


@pytest.mark.parametrize("key", ["k", "a key that is longer than thirty-two bytes", "éà"])
def test_encryption(spark, key):
    raw = key.encode()
    want = (raw * 32)[:32]
    row = spark.range(1).select(codec.derive_key(key).alias("k"), codec.encrypt(F.lit("top").cast("binary"), key).alias("c"))
    got = row.select("k", "c", codec.decrypt(F.col("c"), key).alias("p"), codec.decrypt(F.col("c"), "no").alias("q")).first()
    assert bytes(got["k"]) == want and len(got["c"]) == 3 + 28 and bytes(got["p"]) == b"top" and got["q"] is None
    with pytest.raises(InvalidRequest):
        codec.derive_key("")


def test_names(spark):
    for raw, want in (("a/b", "a_b"), (" ", "default"), ("..", "__"), (None, "default"), ('x\\:*?"<>|y', "x________y")):
        assert spark.range(1).select(names.sanitize(F.lit(raw).cast("string")).alias("x")).first()["x"] == want
    path = F.lit("/save/t/k/more")
    assert tuple(spark.range(1).select(names.path_argument(path, 0), names.path_argument(path, 1), names.path_argument(F.lit("/save/t"), 1)).first()) == ("t", "k", None)
    assert spark.range(1).select(names.strip_pointer(F.lit("$ptr_x")).alias("x")).first()["x"] == "x"


def test_patterns():
    assert names.java_pattern("[[:alpha:]]+") == r"[\p{Alpha}]+" and names.java_pattern("[[:^digit:]]") == r"[\P{Digit}]"
    for bad in ("(?=a)", r"(a)\1", "(", "[[:nope:]]"):
        with pytest.raises(InvalidRequest):
            names.java_pattern(bad)
    assert names.literal_prefix("^key1") == "key1" and names.literal_prefix("^key1*") == "key" and names.literal_prefix("key") == names.literal_prefix("^a|b") == ""


def log(spark, rows):
    return spark.createDataFrame([(t, k, op, s, None if p is None else p.encode(), False, None) for t, k, op, s, p in rows], schemas.KV_LOG)


ROWS = [("t", "a", "S", 1, "one"), ("t", "a", "S", 3, "three"), ("t", "b", "S", 2, "two"), ("t", "b", "D", 4, None), ("u", "a", "S", 1, ""), ("t", None, "S", 9, "x"), (" ", "k", "S", 9, "x"), ("t", "a", "S", 3, "three")]


def test_kv(spark):
    df = log(spark, ROWS)
    assert {(r["table"], r["key"], bytes(r["payload"])) for r in kv.latest(df).collect()} == {("t", "a", b"three"), ("u", "a", b"")}
    assert kv.read_value(df, "t", "a") == b"three"
    for bad, error in ((("t", "b"), NotFound), (("t", "zz"), NotFound), (("", "a"), InvalidRequest), (("t", ""), InvalidRequest)):
        with pytest.raises(error):
            kv.read_value(df, *bad)
    keys = spark.createDataFrame([("t", "a"), ("t", "b")], "table string, key string")
    assert kv.read_many(df, keys).count() == 1
    assert [r["key"] for r in kv.keys_by_regex(df, "t", "[ab]").collect()] == ["a"]
    assert kv.keys_by_regex(df, "t", "", -1).count() == 1 and kv.latest(log(spark, [])).count() == 0
    sealed = kv.save_encrypted(spark.range(1), F.lit("t"), F.lit("s"), F.lit(1), F.lit("secret"), "pw")
    assert kv.read_value(sealed, "t", "s", "pw") == b"secret" and kv.read_encrypted(sealed, "no").first()["payload"] is None
    freed = kv.free(spark.range(1), F.lit("t"), F.lit("a"), F.lit(10))
    assert kv.latest(df.unionByName(freed)).where("table = 't'").count() == 0
    both = kv.with_fallback(df.where("table = 't'"), log(spark, [("t", "a", "S", 99, "peer"), ("t", "z", "S", 1, "peer")]))
    assert {(r["key"], bytes(r["payload"]), r["node"]) for r in both.collect()} == {("a", b"three", 0), ("z", b"peer", 1)}


def inc_log(spark, changes):
    return spark.createDataFrame([("t", "l", s, op, pos, cf, k, None if p is None else p.encode()) for s, (op, pos, cf, k, p) in enumerate(changes)], schemas.INC_LOG)


def model(changes):
    out = []
    for op, pos, cf, k, p in changes:
        n = len(out)
        if op == "add":
            out.append([k, p, False])
        elif op == "drop":
            out = []
        elif op == "insert":
            i = n - pos if cf == "top" else pos
            if not 0 <= i <= n:
                return None
            out.insert(i, [k, p, False])
        else:
            i = n - 1 - pos if cf == "top" else pos
            if not 0 <= i < n:
                return None
            if op == "overwrite":
                out[i] = [k or out[i][0], p, False]
            elif op == "skip":
                out[i][2] = True
            else:
                out[i][0] = None
    return out


def shown(df):
    return [[r["entry_key"], bytes(r["payload"]).decode(), r["skip"]] for r in df.orderBy("id").collect()]


def test_list_changes_in_any_order(spark):
    rng = random.Random(4)
    for _ in range(6):
        changes = [("add", None, None, f"k{i}", f"v{i}") for i in range(3)]
        for i in range(8):
            op, cf = rng.choice(["add", "insert", "insert", "overwrite", "skip", "unkey"]), rng.choice(["top", "bottom"])
            changes.append((op, rng.randint(0, 2), cf, rng.choice([None, f"n{i}"]), f"w{i}"))
        if rng.random() < 0.3:
            changes.insert(5, ("drop", None, None, None, None))
            changes[6:6] = [("add", None, None, None, f"z{i}") for i in range(3)]
        want = model(changes)
        assert want is not None
        lists = inc.state(inc_log(spark, changes))
        assert shown(lists) == want
        assert shown(inc.state(inc.compacted(lists))) == want


def test_places_outside_the_list(spark):
    for op, cf, pos in itertools.product(["insert", "overwrite"], ["top", "bottom"], [2]):
        changes = [("add", None, None, None, "a"), (op, pos, cf, None, "x")]
        assert model(changes) is None
        with pytest.raises(Exception, match="no such place"):
            inc.state(inc_log(spark, changes)).collect()


def test_entry_keys_in_the_middle(spark):
    changes = [("add", None, None, "alpha", "first"), ("add", None, None, "beta", "second"), ("insert", 1, "bottom", "gamma", "middle")]
    lists = inc.state(inc_log(spark, changes))
    assert [x[1] for x in shown(lists)] == ["first", "middle", "second"]
    assert {k: bytes(inc.by_key(lists, k).first()["payload"]) for k in ("alpha", "beta", "gamma")} == {"alpha": b"first", "beta": b"second", "gamma": b"middle"}
    assert inc.by_key(lists, "missing").count() == 0 and inc.by_id(lists, 9).count() == 0
    new = spark.createDataFrame([("t", "l", "delta"), ("t", "l", None)], "table string, key string, entry_key string")
    assert inc.check_entry_keys(lists, new).count() == 2
    for clash in ([("t", "l", "alpha")], [("t", "l", "new"), ("t", "l", "new")]):
        with pytest.raises(Conflict):
            inc.check_entry_keys(lists, spark.createDataFrame(clash, "table string, key string, entry_key string"))


def test_reads_cut_before_they_skip(spark):
    changes = [*(("add", None, None, None, str(i)) for i in range(4)), ("skip", 0, "top", None, None), ("skip", 0, "bottom", None, None)]
    lists = inc.state(inc_log(spark, changes))
    assert [(r["local_id"], bytes(r["payload"])) for r in inc.last_entries(lists, 2).collect()] == [(1, b"2")]
    assert [(r["id"], bytes(r["payload"])) for r in inc.first_entries(lists, 2).collect()] == [(1, b"1")]
    assert inc.last_entries(lists, 0).count() == 0 and inc.by_id(lists, 3).count() == 0
    meta = inc.sizes(spark.createDataFrame([("t", "l", 2, 99), ("t", "l", 1, 8), ("t", "m", 1, 0)], "table string, key string, seq bigint, entry_size bigint"))
    assert [tuple(r) for r in inc.record_count(lists, meta).collect()] == [("t", "l", 4, 44)]
    with pytest.raises(Exception, match="longer"):
        inc.checked(inc_log(spark, [("add", None, None, None, "123456789")]), meta).collect()


def test_references(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("x", "d"), ("d", "e"), ("b", "d")], "src string, dst string")
    got = {(r["node"]): (r["depth"], r["loop"]) for r in refs.reachable(edges, spark.createDataFrame([("a",)], "root string")).collect()}
    assert got == {"a": (0, True), "b": (1, False), "c": (2, False), "d": (1, False), "e": (2, False)}
    objects = spark.createDataFrame([("t", "1", '{"$ptr_x": ["k", "u"], "plain": 3, "pair": [1, 2]}'), ("t", "2", '{"$ptr_y": ["gone", "u"]}'), ("t", "3", None)], "table string, key string, json string")
    assert [tuple(r) for r in refs.pointers(objects).orderBy("key").collect()] == [("t", "1", "$ptr_x", "u", "k"), ("t", "2", "$ptr_y", "u", "gone")]
    existing = spark.createDataFrame([("u", "k")], "table string, key string")
    bad = {(r["key"], r["field"], r["reason"]) for r in refs.invalid_pointers(objects, existing).collect()}
    assert bad == {("1", "plain", "not a pointer"), ("1", "pair", "not a pointer"), ("2", "$ptr_y", "no target")}


def test_free_space(spark):
    blocks = spark.createDataFrame([("f", 0, 10), ("f", 20, 30), ("f", 40, 50), ("f", 60, 70), ("f", 80, 90), ("g", 0, 5)], "file string, start bigint, end bigint")
    spans = spark.createDataFrame([("f", 0, 10), ("f", 20, 25), ("f", 45, 50), ("f", 62, 64), ("f", 66, 68)], "file string, start bigint, end bigint")
    assert sorted(map(tuple, space.subtract(blocks, spans).collect())) == [("f", 25, 30), ("f", 40, 45), ("f", 60, 62), ("f", 64, 66), ("f", 68, 70), ("f", 80, 90), ("g", 0, 5)]
    assert [tuple(r) for r in space.best_fit(blocks, 6).collect()] == [("f", 0, 10, 10)]
    assert space.superseded(log(spark, ROWS[:4])).count() == 2


def left_over(block, spans):
    """What spans leave of a block, by cutting it with one after the other."""
    left = [block[1:]]
    for f, a, z in spans:
        if f == block[0] and a < z:
            left = [(x, y) for p, q in left for x, y in ((p, min(q, a)), (max(p, z), q)) if x < y]
    return [(block[0], x, y) for x, y in left if x < y]


@pytest.mark.parametrize("reach", [12, 300, 70_000, 1 << 40, 1 << 62])
def test_subtract_by_brute_force(spark, reach):
    rng, kind = random.Random(reach), "file string, start bigint, end bigint"

    def ranges(n):
        starts = [(rng.choice(["f", "g", "", None]), rng.randrange(-reach, reach)) for _ in range(n)]
        return [(f, a, a + rng.randrange(-1, min(reach, rng.choice([3, 20, 900, reach])) + 1)) for f, a in starts]

    blocks, spans = ranges(150), ranges(60)
    blocks += blocks[:20] + [("f", -(1 << 63), (1 << 63) - 1), ("f", None, 5), ("g", 5, None), ("h", 0, 5)]
    spans += spans[:5] + [("g", -(1 << 63), -reach // 2), ("i", 0, 9), ("f", None, 3)]
    got = space.subtract(spark.createDataFrame(blocks, kind), spark.createDataFrame(spans, kind)).collect()
    whole = [x for x in spans if None not in x[1:]]
    want = [x for b in blocks if None not in b[1:] for x in left_over(b, whole)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    none = spark.createDataFrame([], kind)
    assert space.subtract(none, none).count() == 0 and space.subtract(none, spark.createDataFrame(spans, kind)).count() == 0
    assert space.subtract(spark.createDataFrame(blocks[:9], kind), none).count() == sum(a < z for _, a, z in blocks[:9])


def test_subtract_of_one_large_file(spark):
    b = spark.range(150_000).select(F.lit("f").alias("file"), (F.col("id") * 100).alias("start"), (F.col("id") * 100 + 40).alias("end"))
    s = b.select("file", (F.col("start") + 3).alias("start"), (F.col("start") + 5).alias("end"))
    began = time.perf_counter()
    assert space.subtract(b, s).agg(F.count("*"), F.sum(F.col("end") - F.col("start"))).first()[:] == (300_000, 150_000 * 38)
    assert time.perf_counter() - began < 60


def test_reclaimable_is_what_was_superseded(spark):
    rng, schema = random.Random(1), "table string, key string, seq long, op string, payload binary"
    rows = [(rng.choice("ab"), rng.choice(["x", "y", None]), i - 50, rng.choice([schemas.SAVE, schemas.FREE]), bytes(rng.randrange(9))) for i in range(200)]
    rows += [("one", "k", 1, schemas.SAVE, b"zz"), ("far", "k", 2**63 - 1, schemas.SAVE, b"a"), ("far", "k", -(2**63), schemas.SAVE, b"bcd")]
    rows += [("tie", "k", 5, schemas.SAVE, b"a"), ("tie", "k", 5, schemas.SAVE, b"abc"), ("tie", "k", 5, schemas.FREE, None), ("none", "k", 1, schemas.SAVE, None), ("none", "k", 2, schemas.FREE, None)]
    given = spark.createDataFrame(rows, schema)
    got = {r["table"]: (r["rows"], r["bytes"]) for r in space.reclaimable(given).collect()}
    old = space.superseded(given.where("table in ('a', 'b')")).groupBy("table").agg(F.count("*"), F.sum(F.octet_length("payload")))
    assert got == {t: (n, b) for t, n, b in old.collect()} | {"far": (1, 3), "tie": (1, 1), "none": (1, 0)}
    assert space.reclaimable(given.limit(0)).count() == 0


def test_wal(spark, tmp_path):
    (tmp_path / "wal.log").write_text("S|a|t|0|5\nS|b|t|5|9\nD|b\nbad\nS|c|t|9|3\nS|d|t|x|3\n\nold|t|1|2\nS|a|t|7|8\n")
    lines = wal.read_lines(spark, str(tmp_path / "wal.log"))
    assert sorted(map(tuple, wal.replay(lines).collect())) == [("a", "t", 7, 8), ("old", "t", 1, 2)]
    assert wal.legacy(wal.replay(lines), "zz").count() == 0


def test_store(spark, tmp_path):
    s = store.LogStore(spark, str(tmp_path / "log"))
    assert s.log().count() == 0
    s.append(log(spark, ROWS[:3]))
    s.append(log(spark, ROWS[3:5]))
    before = {tuple(r) for r in kv.latest(s.log()).select("table", "key", "seq").collect()}
    s.compact()
    assert {tuple(r) for r in kv.latest(s.log()).select("table", "key", "seq").collect()} == before and s.log().count() == 2
    s.append(log(spark, [("t", "a", "S", 50, "new")]))
    assert kv.read_value(s.log(), "t", "a") == b"new"
    row = spark.createDataFrame([(b"abcdefg",)], "p binary")
    assert bytes(row.select(store.read_range(F.col("p"), 1, 3)).first()[0]) == b"bc" and bytes(row.select(store.read_chunk(F.col("p"), 5, 9)).first()[0]) == b"fg"
    with pytest.raises(Exception, match="past the end"):
        row.select(store.read_range(F.col("p"), 1, 30)).collect()
    assert store.chunks(row, "p", 3).count() == 3
    assert store.raw_files(spark, str(tmp_path / "log/_versions/*.json")).count() == 2


def test_catalog(spark):
    c = Catalog(spark)
    request = {"query": "create_table", "tableName": "people", "columns": [{"name": "id", "type": "bigint", "isPrimaryKey": True}, {"name": "n", "type": "string", "maxByteSize": 9}]}
    assert c.execute(request) == "people" and spark.table("people").columns == ["id", "n"] and c.get("people")["n"].metadata == {"maxByteSize": 9}
    assert c.rows().first()["table_name"] == "people"
    for bad in ({"query": "drop"}, "{", {"query": "create_table", "tableName": " "}, {"query": "create_table", "tableName": "x", "columns": []}):
        with pytest.raises(InvalidRequest):
            c.execute(bad)
    with pytest.raises(NotFound):
        c.get("nobody")


def test_feed(spark, tmp_path):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    keys = spark.createDataFrame([("t", ["a", "b"]), ("t", [])], "table string, keys array<string>")
    feed_path = str(tmp_path / "grants")
    feed.grant(keys, now).write.parquet(feed_path)
    grants = spark.read.parquet(feed_path)
    attempts = grants.select(F.explode(F.array(F.lit("c1"), F.lit("c2"))).alias("conn"), "auth_key").withColumn("at", F.when(F.col("conn") == "c1", 1).otherwise(2))
    bindings = feed.attach(grants, attempts, now)
    assert {tuple(r) for r in bindings.collect()} == {("c1", "t", "a"), ("c1", "t", "b")}
    late = now + F.expr("INTERVAL 61 SECONDS")
    assert feed.attach(grants, attempts, late).count() == 0 and feed.refused(grants, attempts, late).count() == 2
    assert tuple(feed.stats(bindings).first()) == (1, 2, 2)
    log(spark, ROWS[:4]).write.parquet(str(tmp_path / "changes"))
    changes = feed.events(feed.stream(spark, str(tmp_path / "changes"), schemas.KV_LOG))
    got = []
    feed.run_batches(changes, lambda: bindings, lambda df, _: got.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["seq"], r["message"]) for r in got) == [
        (1, '{"event":"updated","key":"a","data":"one"}'), (2, '{"event":"updated","key":"b","data":"two"}'),
        (3, '{"event":"updated","key":"a","data":"three"}'), (4, '{"event":"deleted","key":"b"}'),
    ]


def test_health(spark):
    api = metrics.requests(spark.createDataFrame([(10, 1), (21, 2)], "d bigint, at bigint"), F.col("d"), F.col("at"))
    assert tuple(api.first()) == (2, 31, 15, 2)
    none = metrics.requests(spark.createDataFrame([], "d bigint, at bigint"), F.col("d"), F.col("at"))
    assert none.first()["requests"] == 0 and none.first()["avg_ns"] is None
    peers = spark.createDataFrame([("b", 100), ("a", 95), ("z", 10)], "address string, s bigint").select("address", F.timestamp_seconds("s").alias("last_active"))
    net = metrics.network(metrics.alive(peers, F.timestamp_seconds(F.lit(105))))
    assert net.first()["peers"] == ["a", "b"]
    subs = feed.stats(spark.createDataFrame([], "conn string, table string, key string"))
    assert metrics.health(api, subs, net).first()["status"] == "ok"


def test_patterns_mean_what_they_mean_in_re2(spark):
    from tessaline.functions import names

    def hits(pattern, *texts):
        df = spark.createDataFrame([(t,) for t in texts], "x string")
        return [r["x"] for r in df.where(F.col("x").rlike(names.java_pattern(pattern))).collect()]

    assert hits("^abc$", "abc", "abc\n") == ["abc"] and hits("a.c", "a\rc", "a\nc") == ["a\rc"] and hits(r"a\sc", "a\x0bc", "a c") == ["a c"]
    assert hits("[$]", "a$", "a") == ["a$"] and hits(r"a\$", "a$", "a") == ["a$"] and hits("(?m)^b$", "a\nb\nc", "ab") == ["a\nb\nc"]
    assert hits("[[:space:]x]y", "\x0by", "xy", "ay") == ["\x0by", "xy"] and hits("(?P<n>a)b", "ab") == ["ab"] and hits("[]a]z", "]z", "az", "bz") == ["]z", "az"]


def test_entry_keys_stay_unique(spark):
    from tessaline.operators import inc

    rows = [("t", "k", 1, "add", None, None, "k1", b"a"), ("t", "k", 2, "add", None, None, "k2", b"b")]
    log = lambda *more: spark.createDataFrame([*rows, *more], "table string, key string, seq bigint, op string, pos bigint, count_from string, entry_key string, payload binary")
    same = inc.state(log(("t", "k", 3, "overwrite", 0, "bottom", "k1", b"c"))).orderBy("id").collect()
    assert [(r["entry_key"], bytes(r["payload"])) for r in same] == [("k1", b"c"), ("k2", b"b")]
    for op, pos in (("overwrite", 0), ("insert", 0), ("add", None)):
        with pytest.raises(Exception, match="another entry has the key k2"):
            inc.state(log(("t", "k", 3, op, pos, "bottom", "k2", b"c"))).collect()
    lists = inc.state(log())
    assert inc.check_entry_keys(lists, lists).count() == 2
    with pytest.raises(Conflict):
        inc.check_entry_keys(lists, lists.withColumn("id", F.lit(7).cast("bigint")))


def test_a_binding_ends_with_its_key(spark):
    from tessaline.streaming import feed

    log = spark.createDataFrame([("t", "a", 1, "S", b"x"), ("t", "a", 2, "D", None), ("t", "a", 3, "S", b"y"), ("t", "a", 4, "D", None), ("u", "a", 5, "S", b"z")], "table string, key string, seq bigint, op string, payload binary")
    bound = spark.createDataFrame([("c1", "t", "a", None), ("c2", "t", "a", 3), ("c3", None, "a", None)], "conn string, table string, key string, since bigint")
    got = sorted((r["conn"], r["seq"]) for r in feed.fan_out(feed.events(log), bound).collect())
    assert got == [("c1", 1), ("c1", 2), ("c2", 3), ("c2", 4), ("c3", 1), ("c3", 2)]
    assert feed.ended(feed.events(log), bound).count() == 3


def test_one_writer_commits_a_version(spark, tmp_path):
    from tessaline.sources.store import LogStore

    store = LogStore(spark, f"file://{tmp_path}/log")
    store._commit("a", 0)
    with pytest.raises(Conflict):
        store._commit("b", 0)
    assert store._versions() == ["a"]


def test_json_pointers_in_loops_stay(spark):
    from tessaline.operators import refs

    objects = spark.createDataFrame([("t", "a", '{"$ptr_b":["b","t"],"n":1}'), ("t", "b", '{"$ptr_a":["a","t"]}'), ("t", "c", "{}"), ("t", "d", None)], "table string, key string, json string")
    got = {r["key"]: r["json"] for r in refs.resolve_json(objects, 1).collect()}
    assert got == {"a": '{"b":{"$ptr_a":["a","t"]},"n":1}', "b": '{"a":{"$ptr_b":["b","t"],"n":1}}', "c": "{}", "d": "{}"}
