"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tessera.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == _sorted(names, result.fetchall())


def test_queries_without_sql(spark):
    rows = {n: QUERIES[n](spark, DATA).collect() for n in ("snippet_topk", "results_json")}
    assert all("**" in r["snippet"] for r in rows["snippet_topk"])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_words_of_a_document_go_through_python_together(spark):
    """Python stands below the table of single words, so that it gets a list a document and not every word by itself."""
    plan = QUERIES["stem_vocabulary"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("ArrowEvalPython")


def test_bounds_are_joined_with_terms_and_not_with_postings(spark):
    plan = QUERIES["upper_bounds_dominate"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
