"""Nearest neighbours by collision counting over single-projection sorted arrays.

Largest inner product becomes least distance by one more coordinate that gives all vectors the same
norm. A block of vectors keeps, for each of a full set of orthogonal directions, its projections in
sorted order. A query's window on each array is centred on the query's own projection and widened in
steps (virtual rehashing: no table is built again, only the new ends are read). The first is somewhat
narrower than the nearest of a few vectors of the block call for; where it takes in more than half of the
arrays, what lies outside is counted instead. A vector collides once for each window it lies in; those that collide in ``THRESHOLD`` of the directions are verified by their
exact inner products.

Widening stops when the k-th found is so near that any nearer vector would have collided often enough
already, but for a chance of about ``MISS``: a vector at distance d from the query lies in a window of
half-width w with probability 2 Phi(w / d) - 1, and its number of collisions is nearly normal. How far
that is depends on the data alone: a few windows where neighbours are much nearer than the rest, most of
the arrays where all vectors are nearly as far.

Every vector is indexed; nothing is fitted but the largest norm. Each block goes to one task once, which
reads the queries from the shared folder in batches; a query's best of each block are then merged.

Nulls and edges: vectors that are null, zero or hold null or non-finite components, and rows without an
id, take no part; nor do vectors of another length than the commonest (ties: the shortest). Rows that
repeat an id are vectors of their own, each another's candidate; if they are queries, each has its own
``k`` rows under that id. Ties go to the smaller id. A query with fewer candidates than ``k`` returns
them all; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import cut, release, shared_path

BLOCK = 16384
#: Vectors of a block that are verified for every query, to know how wide its windows have to be at most.
PILOT = 512
#: The share, of the width that the nearest of these suggest, at which they begin.
START = 0.9
#: Queries that a task holds at a time.
QUERIES = 1024
#: Half-widths, in units of the largest norm: the first where nothing is known, the growth, and one that takes in everything.
FIRST, WIDEN, FAR = 0.1, 1.06, 64.0
THRESHOLD = 0.86
MISS = 0.1
OUT = "query_row long, query_id long, vec_row long, vec_id long, score double, verified long, counted long"


def directions(d: int, seed: int = 5) -> np.ndarray:
    """d orthonormal columns, scaled so that a distance is the deviation of its projections."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0] * np.sqrt(d)


def sure_ratio(m: int, threshold: float = THRESHOLD, miss: float = MISS) -> float:
    """The least w / d at which a vector at distance d collides in ``threshold`` of m orthogonal directions
    but for a chance of ``miss``. Its projections' squares have a fixed sum, which lessens the variance."""
    z, t = -_normal_quantile(miss), 0.0
    while t < 8:
        t += 0.005
        p, density = math.erf(t / math.sqrt(2)), math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        spread = math.sqrt(max(p * (1 - p) - 2 * (t * density) ** 2, 0) / m)
        if p - z * spread >= threshold:
            return t
    return t


def _normal_quantile(p: float) -> float:
    lo, hi = -9.0, 9.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (1 + math.erf(mid / math.sqrt(2))) / 2 < p else (lo, mid)
    return lo


class Block:
    """``vectors`` with sorted projections; ``norm``: the largest of all blocks."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, norm: float):
        self.rows, self.ids, self.vectors, self.norm = rows, ids, vectors, norm
        rest = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(axis=1), 0))
        self.axes = directions(vectors.shape[1] + 1)
        at = (np.column_stack([vectors, rest]) @ self.axes / norm).T
        self.order = np.argsort(at, axis=1, kind="stable")
        # all arrays one after another, each moved beyond the one before
        self.shift = FAR * 4 * np.arange(len(at))
        self.flat = (np.take_along_axis(at, self.order, axis=1) + self.shift[:, None]).ravel()

    def window(self, at: np.ndarray, w: float) -> tuple[list[int], list[int]]:
        """The first and the last places (exclusive) of a window in each array."""
        begin = len(self.ids) * np.arange(len(at))
        lo, hi = np.searchsorted(self.flat, at + self.shift - w), np.searchsorted(self.flat, at + self.shift + w, "right")
        return np.clip(lo - begin, 0, len(self.ids)).tolist(), np.clip(hi - begin, 0, len(self.ids)).tolist()

    def search(self, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> dict[str, np.ndarray]:
        n, m = len(self.ids), len(self.order)
        size = np.linalg.norm(queries, axis=1)
        at = np.column_stack([queries / size[:, None], np.zeros(len(queries))]) @ self.axes
        least, ratio = math.ceil(THRESHOLD * m), sure_ratio(m)
        pilot = queries @ self.vectors[: min(PILOT, max(2 * k, n // 32))].T
        out: list[list[np.ndarray]] = [[] for _ in range(7)]
        for i, query in enumerate(queries):
            score, seen = np.full(n, -np.inf), np.zeros(n, bool)
            score[: pilot.shape[1]], seen[: pilot.shape[1]] = pilot[i], True
            own = np.flatnonzero(self.rows == rows[i])
            score[own], seen[own] = -np.inf, True

            def enough(found: np.ndarray, size: float = size[i]) -> float:
                """The half-width at which the k nearest of these can't be bettered, but for a chance of MISS."""
                if np.count_nonzero(found > -np.inf) < k:
                    return np.inf
                kth = float(np.partition(found, len(found) - k)[len(found) - k])
                return ratio * math.sqrt(max(2 - 2 * kth / (size * self.norm), 0))

            end, few = enough(score[: pilot.shape[1]]), np.sort(score[: pilot.shape[1]])[::-1]
            # as rare among these as the k-th is among all
            near = few[min(len(few), max(1, round(k * len(few) / n))) - 1]
            w = max(START * ratio * math.sqrt(max(2 - 2 * near / (size[i] * self.norm), 0)), FIRST) if near > -np.inf else FIRST
            hits, counted, inner_lo, inner_hi = None, 0, None, None
            while True:
                lo, hi = self.window(at[i], w)
                if hits is None and 2 * (sum(hi) - sum(lo)) > n * m:  # the fewer: what lies outside
                    new = np.concatenate([x for j in range(m) for x in (self.order[j, : lo[j]], self.order[j, hi[j] :])])
                    hits = m - np.bincount(new, minlength=n)
                elif hits is None:
                    new = np.concatenate([self.order[j, lo[j] : hi[j]] for j in range(m)])
                    hits = np.bincount(new, minlength=n)
                else:
                    new = np.concatenate([self.order[j, a:b] for j in range(m) for a, b in ((lo[j], inner_lo[j]), (inner_hi[j], hi[j]))])
                    hits += np.bincount(new, minlength=n)
                inner_lo, inner_hi = lo, hi
                counted += len(new)
                close = np.flatnonzero((hits >= least) & ~seen)
                if w >= FAR:  # nothing is left out
                    close = np.flatnonzero(~seen)
                if len(close):
                    seen[close] = True
                    score[close] = (self.vectors[close] * query).sum(axis=1)
                    end = enough(score)
                if w >= min(end, FAR):
                    break
                w = min(w * WIDEN, FAR) if end == np.inf or w * WIDEN < end else end
            close = np.flatnonzero(score > -np.inf)
            verified = len(close)
            if verified > k:
                close = close[score[close] >= np.partition(score[close], verified - k)[verified - k]]
            best = close[np.lexsort([self.ids[close], -score[close]])[:k]]
            one = np.ones(len(best), np.int64)
            for column, x in zip(out, (rows[i] * one, ids[i] * one, self.rows[best], self.ids[best], score[best], verified * one, counted * one)):
                column.append(x)
        return {name: np.concatenate(x) for name, x in zip(("query_row", "query_id", "vec_row", "vec_id", "score", "verified", "counted"), out)}


def _matrix(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = t["vector"]
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    flat = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return t["row"].to_numpy(), t["vec_id"].to_numpy(), flat.reshape(t.num_rows, -1)


def _meet(asked: str, norm: float, k: int) -> Callable[[pa.Table], pa.Table]:
    """A block against all queries of the folder ``asked``, batch by batch."""

    def run(base: pa.Table) -> pa.Table:
        block, found = Block(*_matrix(base), norm), []
        for batch in _batches(asked):
            found.append(pa.table(block.search(*_matrix(batch), k)))
        del block
        release()
        return pa.concat_tables(found) if found else pa.table({c.split()[0]: pa.array([], pa.float64() if "double" in c else pa.int64()) for c in OUT.split(", ")})

    return run


def _batches(folder: str) -> Iterator[pa.RecordBatch]:
    for batch in ds.dataset(folder, format="parquet").to_batches(columns=["row", "vec_id", "vector"], batch_size=QUERIES):
        if batch.num_rows:
            yield batch


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)


def candidates(vectors: DataFrame, asked: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """A query's ``k`` best of each block, with the vectors ``verified`` and the array entries ``counted`` there."""
    spark = vectors.sparkSession
    rows = cut(usable(vectors, key, vector).withColumn("row", F.monotonically_increasing_id()))
    shape = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d, n = (shape["d"], shape["n"]) if shape else (1, 0)
    rows = rows.where(F.size("vector") == d)
    squares = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x)
    norm = rows.agg(F.max(F.sqrt(squares)).alias("norm")).first()["norm"]
    folder = f"{shared_path(spark, 'queries')}/q"
    rows.where(asked).write.parquet(f"file://{folder}")
    blocks = max(1, -(-n // block))
    based = rows.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return based.groupBy("b").applyInArrow(lambda t: _meet(folder, norm or 1.0, k)(t), OUT)


def search(vectors: DataFrame, asked: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` found nearest of every row for which ``asked``, an
    expression over vec_id, holds."""
    met = candidates(vectors, asked, k, key, vector, block)
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
