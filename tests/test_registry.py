"""Every registered query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from ferrule.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return norm(v.item()) if hasattr(v, "item") else v


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, tiny, name):
    df = QUERIES[name](spark, tiny)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in ORACLE_SQL:
        r = duck.sql(ORACLE_SQL[name])
        assert sorted(r.columns) == cols
        assert got == sorted((tuple(norm(row[r.columns.index(c)]) for c in cols) for row in r.fetchall()), key=repr)


def test_without_training_operators(monkeypatch):
    import builtins
    import sys

    real = builtins.__import__

    def refuse(name, *a, **k):
        if name == "corpus_pipeline" or name.startswith("ferrule.llm"):
            raise ImportError(name)
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("ferrule.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", refuse)
    import __spark_entry__

    assert set(__spark_entry__.queries()) == set(QUERIES) and set(__spark_entry__.oracle_sql()) == set(ORACLE_SQL)
