"""Every registered query with SQL against DuckDB, on the smallest tables; and rules of the source tree."""

import os
import re

import duckdb
import pytest

from strokeloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(tuple(round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert normal(tuple(r) for r in df.select(*columns).collect()) == normal(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["compile_order", "frame_alpha"])
def test_users_of_more_than_255_events(spark, tmp_path, name):
    rows = [(u * 1000 + k, u, k // 2, None if k % 7 == 0 else k * 1.5 % 60) for u, n in ((1, 700), (2, 256), (3, 40)) for k in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(f"SELECT * FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert normal(tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()) == normal(want)


def test_corpus_discovery_reads_all_parts(spark, tmp_path, monkeypatch):
    spark.range(1, 100).selectExpr("id AS p_partkey", "CAST(id % 7 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    given = []
    pairs = catalog.rasters.complete_pairs
    monkeypatch.setattr(catalog.rasters, "complete_pairs", lambda keys: given.append(keys.count()) or pairs(keys))
    assert catalog.queries()["corpus_discovery"](spark, str(tmp_path)).count() == 7 and given == [99]


def sources(*parts):
    for folder, _, names in os.walk(os.path.join(ROOT, "strokeloom", *parts)):
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    yield os.path.join(folder, name), f.read()


def test_plans_and_operators_know_no_time():
    for path, text in [*sources("operators"), *sources("sources")]:
        assert "strokeloom.timing" not in text, path
    with open(os.path.join(ROOT, "strokeloom", "plans", "detect.py"), encoding="utf-8") as f:
        assert not re.search(r"strokeloom\.timing|millis|duration", f.read())


def test_nothing_else_imports_the_subpackage():
    for path, text in sources():
        if f"{os.sep}llm{os.sep}" not in path:
            assert "strokeloom.llm" not in text, path
