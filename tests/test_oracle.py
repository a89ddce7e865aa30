"""Every query that SQL can express, against DuckDB over the smallest tables."""

import os

import pytest

from strata.plans import catalogue, catalogue_sql, domain, domain_sql, store

DATA = os.environ.get("STRATA_TEST_DATA", "/root/testdata/sf0.001")
QUERIES = {**catalogue.QUERIES, **store.QUERIES, **domain.QUERIES}
SQL = {**catalogue_sql.SQL, **store.SQL, **domain_sql.SQL}
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{f}") else "")
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return c


def normal(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = normal(tuple(r) for r in df.select(*cols).collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    want = normal(duck.sql(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall())
    assert got == want


def test_every_query_is_checked_or_known_not_to_be():
    assert set(QUERIES) - set(SQL) == {"state_sum_blake2", "verify_elements"}


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from strata.operators import changes, merge

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    a, b, c = (catalogue.state(spark, DATA, x) for x in "ABC")
    text = plan(merge.conflicts(a, b, c, [5]))
    assert text.count("EqualTo(o_orderkey,5)") == 3  # through the three-way alignment
    assert text.count("Exchange hashpartitioning") == 1
    assert plan(changes.diff(c, a, [5])).count("EqualTo(o_orderkey,5)") == 2
    log = plan(catalogue.replay_latest(spark, DATA).where(F.col("elt_id") == 7))
    assert "EqualTo(user_id,7)" in log
