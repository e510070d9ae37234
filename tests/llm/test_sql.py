"""Queries against their SQL, on whole tables."""

import duckdb
import pytest

from foliant.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", oracle_sql())
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(cur.fetchall()) == sorted(tuple(r[n] for n in names) for r in df.collect())
