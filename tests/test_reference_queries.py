"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import duckdb
import pytest

from tessaline.plans import reference
from tessaline.session import TABLES


def plain(x):
    if x is None or x != x:
        return None
    return x.item() if hasattr(x, "item") else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(reference.queries()))
def test_query_equals_sql(spark, sf, duck, name):
    got = reference.queries()[name](spark, sf).toPandas()
    want = duck.execute(reference.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_point_read_is_pushed_to_the_scan(spark, sf):
    plan = reference.kv_point_read(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,7)" in plan


def test_last_n_limits_groups_before_the_window(spark, sf):
    assert "WindowGroupLimit" in reference.inc_last_n(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_chunks_hold_every_document(spark, tmp_path):
    texts = {1: "plain", 2: "é" * 900 + "日本", 3: "", 4: None, 5: "x" * 999 + "ü" + "y" * 1000}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = reference.queries()["value_chunks"](spark, str(tmp_path)).orderBy("doc_id", "chunk_no").collect()
    assert {r["doc_id"] for r in rows} == set(texts) and all(len(r["chunk"] or "") <= 2000 for r in rows)
    for i, t in texts.items():
        assert bytes.fromhex("".join(r["chunk"] or "" for r in rows if r["doc_id"] == i)) == (t or "").encode()


def test_columns_and_kinds_match(spark, sf, duck):
    """Kinds too, as equal values of unlike kinds hash apart."""
    for name in ("health", "declared_tables", "subscription_stats", "feed_notified", "network_stats", "store_compacted", "snapshot_replay"):
        got = {f.name: f.dataType.simpleString() for f in reference.queries()[name](spark, sf).schema}
        want = dict(duck.execute(f"SELECT column_name, column_type FROM (DESCRIBE {reference.oracle_sql()[name]})").fetchall())
        kinds = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
        assert {k: kinds[v] for k, v in got.items()} == want, name
