"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from sieveline.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    rows = sorted((tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=str)
    if name not in catalogue.SQL:
        assert rows
        return
    want = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)


def test_entry_works_without_the_training_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(__spark_entry__)
    assert set(alone.queries()) == set(catalogue.QUERIES) and set(alone.oracle_sql()) == set(catalogue.SQL)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
