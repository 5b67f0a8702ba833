"""The registered queries: against their SQL, and the pipeline's ``run`` against its stages one by one."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from tessera.llm.oracles import ORACLES
from tessera.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def shown(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, DATA)
    assert shown(tuple(r) for r in df.collect()) == shown(con.execute(f"select {', '.join(df.columns)} from ({ORACLES[name]})").fetchall())


def test_run(spark, docs, empty, tmp_path):
    for name, table in (("some", docs), ("none", empty)):
        at = f"file://{tmp_path}/{name}"
        table.write.parquet(f"{at}/documents.parquet")
        now = spark.read.parquet(f"{at}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, at).write.parquet(f"{at}/{k}")
            now = spark.read.parquet(f"{at}/{k}")
        rows = lambda df: sorted(map(repr, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
        assert rows(corpus_pipeline.run(spark, at)) == rows(now)
    assert now.count() == 0
