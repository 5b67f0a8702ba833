"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; one line of JSON.

``index_build`` is the making and saving of the index; the queries after it read the saved one.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from tessera import catalog

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ("bm25_should_topk", "bm25_single_term", "bm25_must_intersection", "bm25_must_not", "bm25_phrase_idf", "phrase_two_terms", "batch_topk", "collection_stats", "block_metadata", "snippet_topk")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spent = {}

    def timed(name, run):
        nonlocal spent
        began = time.time()
        run()
        spent[name] = round(time.time() - began, 3)

    timed("index_build", lambda: catalog.index_of(spark, SF))
    timed("index_build_raw", lambda: catalog.index_of(spark, SF, True))
    for name in NAMES:
        timed(name, lambda name=name: catalog.QUERIES[name](spark, SF).write.mode("overwrite").format("noop").save())
    n = catalog.index_of(spark, SF).collection()[0]
    first = dict(spent)
    for name in NAMES:  # once more, when code is compiled
        timed(name, lambda name=name: catalog.QUERIES[name](spark, SF).write.mode("overwrite").format("noop").save())
    again, spent = {k: spent[k] for k in NAMES}, first
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").count()
    out = {"metric": "total_seconds", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent, "sf": SF, "docs_per_second_indexed": round(n / spent["index_build"], 1), "again": again, "batched_queries_per_second": round(asked / again["batch_topk"], 1)}
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
