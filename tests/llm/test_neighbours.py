"""Nearest neighbours against brute force: recall through the query itself, odd rows, and how much is looked at."""

import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neighbours, queries


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16)).astype(np.float32) * rng.uniform(0.5, 2, (900, 1)).astype(np.float32)
    x[7] = x[8]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (None, rows[0][1], 0), (1004, [1.0], 0), rows[5], rows[20]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, h int")
    got = defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=5, block=300).orderBy("query_id", "rank", "vec_id").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ids = [*range(900), 5, 20]  # repeated rows are candidates too
    s = x.astype(float) @ x.astype(float)[ids].T
    hits = 0
    for q in range(0, 900, 20):
        order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-s[q, i], ids[i]))[:5]
        if q == 20:  # two rows of this id: each is the other's neighbour
            assert len(got[q]) == 10 and sum(i == 20 for i, _ in got[q]) == 2
            continue
        hits += len([i for i in order if ids[i] in {i for i, _ in got[q]}])
        assert len(got[q]) == 5 and all(abs(v - s[q, i]) < 1e-9 for i, v in got[q])
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
    assert hits >= 0.95 * 44 * 5
    few = neighbours.search(df.where("vec_id < 4"), F.col("vec_id") == 0, k=20).collect()
    assert len(few) == 3
    assert neighbours.search(df.where("false"), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    at = f"/root/testdata/{sf}"
    if not os.path.isdir(at):
        pytest.skip("no test data")
    table = spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x, ids = np.stack(table["embedding"]).astype(float), table["vec_id"].to_numpy()
    got = queries.op2_neighbours(spark, at).toPandas()
    assert list(got.columns) == ["query_id", "rank", "vec_id", "score"]
    found = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        own = got[got["query_id"] == ids[q]].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21))
        assert np.allclose(own["score"], s[[np.flatnonzero(ids == v)[0] for v in own["vec_id"]]], atol=1e-12)
        found += (own["score"] >= np.sort(s)[-20] - 1e-12).sum()
    assert found >= 0.95 * 20 * (ids % 20 == 0).sum()


def test_windows_stay_narrow_where_neighbours_are_near():
    """Clusters far apart: a small part of the arrays is looked at, and nothing is missed."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(200, 64))
    x = centres[rng.integers(0, 200, 8000)] + rng.normal(size=(8000, 64)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = np.arange(len(x))
    out = neighbours.Block(rows, rows, x, 1.0).search(rows[:40], rows[:40], x[:40], 20)
    s = x[:40] @ x.T
    s[rows[:40], rows[:40]] = -1
    kth = np.sort(s, axis=1)[:, -20]
    assert (out["score"].reshape(40, 20) >= kth[:, None] - 1e-12).mean() > 0.95
    assert out["counted"].mean() < 0.2 * 8000 * 65 and out["verified"].mean() < 0.05 * 8000
