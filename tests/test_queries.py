"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from tracewright import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: repr(round(v, 6)) if isinstance(v, float) else repr(v)
    return [columns[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    if name not in registry.ORACLE_SQL:
        assert got[1]
        return
    q = duck.execute(registry.ORACLE_SQL[name])
    assert got == normal(q.fetchall(), [c[0] for c in q.description])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
