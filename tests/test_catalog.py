"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from textloom import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages labels nation customer orders events benchmark conversations".split()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    cur = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    df = catalog.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(names)
    norm = lambda rows: sorted(tuple(repr(round(x, 5) + 0.0 if isinstance(x, float) else str(x)) for x in r) for r in rows)
    assert norm(tuple(r[c] for c in names) for r in df.collect()) == norm(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DIR).count() >= 0
