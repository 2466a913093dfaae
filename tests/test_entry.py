"""The driver's contract, and queries against their SQL at the smallest scale."""

import importlib

import pytest

import __spark_entry__ as entry
from quern.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "nation customer documents embeddings pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def value(x):
    if x is None or x != x:
        return "-"
    return f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    cursor = duck.execute(registry.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    want = sorted(tuple(value(x) for _, x in sorted(zip(names, r, strict=True))) for r in cursor.fetchall())
    assert sorted(tuple(value(r[c]) for c in sorted(found.columns)) for r in found.collect()) == want


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["query_id", "prompt", "response", "provider"]
    assert out.count() == 40


def test_without_the_training_data_subpackage(monkeypatch):
    import sys

    for name in [n for n in sys.modules if n.startswith("quern.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quern.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    again = importlib.reload(entry)
    assert set(again.queries()) == set(registry.QUERIES)
    monkeypatch.undo()
    importlib.reload(entry)
