"""Toxicity by subword-bag embeddings.

A word's character n-grams (with its edges) have vectors; a window of words is the average of its
n-grams' vectors, put through a linear softmax. Vectors and softmax are trained together in numpy on a
bounded sample of labelled documents. A label belongs to a document and not to its windows, so in each
epoch a toxic document stands for its worst window, and a clean one for its worst and some at random:
the score of a document is that of its worst window. A misspelling shares most n-grams with the word.

Only the text is scored. Learning sees at most ``SAMPLE`` documents of each label, those with the
smallest digests of their ids, and of these as many as ``SAMPLE_BYTES`` hold; of rows that repeat a labelled
id, the least text. Nulls and edges: a null or empty text has the score of no evidence, the
softmax's bias alone. A null label is none; a document labelled more than once is toxic if any label is.
Repeated rows are scored each on its own. With no labels of either kind, every score is that of a
model that has learnt nothing (0.5 or less). An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import releasing
from tessera.llm.textbytes import _IS_SPACE, spaced

BUCKETS = 1 << 18
DIM = 16
ORDERS = (3, 4, 5)
#: Window and padding were chosen on a fifth of the learning rows of check_s, left out of learning for that.
WINDOW = 2
#: Zero vectors that take part in every average, so that a window of a few letters says little.
PAD = 16
SAMPLE = 3000
SAMPLE_BYTES = 64 << 20
EPOCHS = 14


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and word of every n-gram, and each text's first word (one more than texts)."""
    data, at = spaced(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]  # text starts, in characters
    space = _IS_SPACE[np.minimum(chars, 255)] & (chars < 128)
    chars = np.where(space, np.uint32(32), chars)
    begins = ~space & np.concatenate([[True], space[:-1]])
    word = np.cumsum(begins, dtype=np.int32) - 1
    gaps = np.concatenate([[0], np.cumsum(space, dtype=np.int32)])
    first = np.searchsorted(np.nonzero(begins)[0], heads)
    buckets, owners = [], []
    h = chars.astype(np.uint64)
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint64(0x100000001B3) + chars[n - 1 :]
        if n in ORDERS and len(h):
            inner = np.nonzero(gaps[n - 1 : n - 1 + len(h)] == gaps[1 : 1 + len(h)])[0]  # no space within
            x = h[inner] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            buckets.append(((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
            owners.append(word[inner + 1])
    none = np.zeros(0, np.int32)
    return np.concatenate(buckets or [none]), np.concatenate(owners or [none]), first


def window_sums(sums: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words' sums and numbers of n-grams, those of the window that starts at each word; windows end
    with their text."""
    n = int(first[-1])
    size = np.diff(first)
    end = np.minimum(np.arange(n) + WINDOW, np.repeat(first[1:], size))
    out = []
    for x in (sums, counts):
        run = np.concatenate([[0], np.cumsum(x)])
        out.append(run[end] - run[:n])
    return out[0], out[1] + PAD


class Scorer:
    """``weight``: what each bucket adds to the log odds of an average; ``bias``.

    The softmax of an average is linear before its last step, so it is the average of these.
    """

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def odds(self, column: pa.Array) -> np.ndarray:
        """Log odds of each text's worst window."""
        out = np.full(len(column), self.bias)
        buckets, owners, first = ngrams(column)
        if n := int(first[-1]):
            total, count = window_sums(np.bincount(owners, self.weight[buckets], n), np.bincount(owners, minlength=n), first)
            some = np.nonzero(np.diff(first))[0]
            out[some] += np.maximum.reduceat(total / count, first[some])
        return out


class Model(Scorer):
    def __init__(self, vectors: np.ndarray, softmax: np.ndarray, bias: np.ndarray):
        self.vectors, self.softmax = vectors, softmax
        super().__init__((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def train(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    if len(texts) == 0 or toxic.all() or not toxic.any():
        return Model(vectors * 0, softmax, bias)
    # n-grams by word, and words by document
    by_word, pointer, first, seen = [], [np.zeros(1, np.int64)], [0], np.zeros((2, BUCKETS), np.float32)
    for lo in range(0, len(texts), 200):
        buckets, owners, heads = ngrams(pa.array(texts[lo : lo + 200], pa.large_string()))
        order = np.argsort(owners, kind="stable")
        by_word.append(buckets[order])
        ends = np.cumsum(np.bincount(owners, minlength=int(heads[-1])))
        pointer.append(pointer[-1][-1] + ends)
        for k, (a, b) in enumerate(zip(heads, heads[1:])):
            span = by_word[-1][(ends[a - 1] if a else 0) : (ends[b - 1] if b else 0)]
            seen[int(toxic[lo + k]), np.unique(span)] += 1
        first += list(first[-1] + heads[1:])
    flat, ptr, first = np.concatenate(by_word), np.concatenate(pointer), np.array(first)
    del by_word
    counts = np.diff(ptr)

    def word_sums(weight: np.ndarray) -> np.ndarray:
        """In pieces: the sample's n-grams are many."""
        out = np.zeros(len(counts))
        for lo in range(0, len(counts), 1 << 18):
            n = counts[lo : lo + (1 << 18)]
            out[lo : lo + len(n)] = np.bincount(np.repeat(np.arange(len(n)), n), weight[flat[ptr[lo] : ptr[lo + len(n)]]], len(n))
        return out

    docs = np.nonzero(np.diff(first))[0]
    kind = toxic[docs]
    # windows are first chosen by how much more often toxic documents hold an n-gram
    rate = (seen + 0.5) / (np.array([[(~toxic).sum()], [toxic.sum()]]) + 1)
    weight = np.log(rate[1] / rate[0])
    step = {"v": np.full(BUCKETS, 1e-6, np.float32), "s": np.full_like(softmax, 1e-6), "b": np.full_like(bias, 1e-6)}
    for epoch in range(epochs):
        total, count = window_sums(word_sums(weight), counts, first)
        odds = total / count
        worst = np.maximum.reduceat(odds, first[docs])
        size = np.diff(first)[docs]
        at_worst = np.nonzero(odds == np.repeat(worst, size))[0]
        at_worst = at_worst[np.unique(np.repeat(np.arange(len(docs)), size)[at_worst], return_index=True)[1]]
        chance = first[docs][~kind] + (rng.random((2, (~kind).sum())) * size[~kind]).astype(np.int64)
        starts = np.concatenate([at_worst, *chance])
        label = np.concatenate([kind, np.zeros(chance.size, bool)])
        limit = np.concatenate([first[1:][docs], *[first[1:][docs][~kind]] * 2])
        lo, hi = ptr[starts], ptr[np.minimum(starts + WINDOW, limit)]
        pace = 0.3 * (1 - epoch / (epochs + 1))
        for part in np.array_split(rng.permutation(len(starts)), max(1, len(starts) // 128)):
            part = part[hi[part] > lo[part]]
            n = hi[part] - lo[part]
            if not len(part):
                continue
            heads = np.cumsum(n) - n
            ids = flat[np.repeat(lo[part] - heads, n) + np.arange(n.sum())]
            weigh = (n + PAD)[:, None]
            mean = np.add.reduceat(vectors[ids], heads) / weigh
            z = mean @ softmax + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), label[part].astype(int)] -= 1
            g_soft, g_bias = mean.T @ p / len(part), p.mean(axis=0)
            g_mean = (p @ softmax.T) / weigh
            unique, back = np.unique(ids, return_inverse=True)
            g = np.zeros((len(unique), DIM), np.float32)
            np.add.at(g, back, np.repeat(g_mean, n, axis=0).astype(np.float32))
            step["v"][unique] += (g * g).mean(axis=1)
            vectors[unique] -= pace * g / np.sqrt(step["v"][unique])[:, None]
            step["s"] += g_soft**2
            softmax -= (pace * g_soft / np.sqrt(step["s"])).astype(np.float32)
            step["b"] += g_bias**2
            bias -= (pace * g_bias / np.sqrt(step["b"])).astype(np.float32)
        weight = vectors @ (softmax[:, 1] - softmax[:, 0])
    return Model(vectors, softmax, bias)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Scorer:
    """Trains on at most ``sample`` labelled documents of each kind, and ``most_bytes`` of text, among those that
    ``learn`` holds for: whole documents in the order of their digests, as long as they fit."""
    marks = labels.select(F.col(key).alias("_key"), F.col(label).alias("_toxic")).where(learn & F.col("_toxic").isNotNull())
    marks = marks.groupBy("_key").agg(F.max("_toxic").alias("_toxic"))
    marks = marks.withColumn("_digest", F.md5(F.col("_key").cast("string")))
    # ids first, so that no text is sorted; few and of a known number
    chosen = [marks.where(F.col("_toxic") == k).orderBy("_digest", "_key").limit(sample) for k in (0, 1)]
    few = chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(few), F.col("_id") == F.col("_key"))
    sampled = rows.groupBy("_key", "_digest", "_toxic").agg(F.min("_text").alias("_text"))
    # the documents are read where they lie; the few of the sample then go to one task, and only weights to the driver
    before = W.orderBy("_digest", "_key").rowsBetween(W.unboundedPreceding, 0)
    held = sampled.withColumn("_bytes", F.sum(F.octet_length("_text")).over(before)).where(F.col("_bytes") <= most_bytes)
    learnt = held.select("_digest", "_toxic", "_text").mapInArrow(releasing(_learn), "weight binary, bias double").first()
    if learnt is None:
        return Scorer(np.zeros(BUCKETS, np.float32), 0.0)
    return Scorer(np.frombuffer(learnt["weight"], np.float32), learnt["bias"])


def _learn(batches):
    rows = sorted((d, t, int(y)) for b in batches for d, y, t in zip(*(c.to_pylist() for c in b.columns)))
    if rows:
        model = train([t for _, t, _ in rows], np.array([y for *_, y in rows]) > 0)
        weight = pa.array([model.weight.astype(np.float32).tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([weight, pa.array([model.bias])], ["weight", "bias"])


def score(docs: DataFrame, model: Scorer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key (as doc_id) and score, for whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias))  # 1 MB

    def run(batches):
        own = Scorer(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                odds = own.odds(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-odds)))], ["doc_id", "score"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
