"""Every query against its oracle, on the smallest tables."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {n: q for n, q in entry.queries().items() if n in entry.oracle_sql()}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, np.bool_)):
        return v if v is None else bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return "%.9g" % v
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else "%.9g" % v if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_oracle(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    rel = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(repr(tuple(plain(r[columns.index(c)]) for c in order)) for r in rel.fetchall())
    got = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "user_id" in df.columns


def test_no_row_at_a_time_python(spark, data):
    """Engine queries stay on the JVM, but for exact top-k and tables made from trained models."""
    for name, q in entry.queries().items():
        if name.startswith(("op", "pipeline", "stream", "als", "topk")):
            continue
        plan = q(spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
