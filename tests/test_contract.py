"""The driver's contract: every query runs and equals its SQL on the smallest tables, where they are there."""

import glob
import os

import pytest

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def differing(spark, queries, sql) -> list[str]:
    """The queries whose rows differ from those of their SQL on the smallest tables; those without SQL only run."""
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    bad = []
    for name, run in queries.items():
        df = run(spark, DATA)
        cols = sorted(df.columns)
        rows = [tuple(norm(x) for x in r) for r in df.select(*cols).collect()]
        if name in sql:
            got = con.execute(sql[name])
            names = [d[0] for d in got.description]
            want = [tuple(norm(r[names.index(c)]) for c in cols) for r in got.fetchall()]
            if sorted(names) != cols or sorted(map(repr, rows)) != sorted(map(repr, want)):
                bad.append(name)
    return bad


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_queries_equal_sql(spark):
    import __spark_entry__ as e
    from lattica import queries

    assert not differing(spark, queries.QUERIES, queries.SQL)
    assert e.entry(spark).columns == ["dataset", "method_count"]
