"""The registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from strokeloom.llm import queries

DATA = "/root/testdata/sf0.001"


def normal(rows):
    return sorted((tuple(round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert normal(tuple(r) for r in df.select(*columns).collect()) == normal(want)


def test_one_query_for_each_operator():
    assert [int(n.split("_")[0][2:]) for n in queries.queries()] == sorted(range(1, 11))
