"""Passages that documents share, by sparse suffix arrays.

Every run of ``LENGTH`` words has one minimiser, the k-word gram with the least hash in it, chosen by
content alone; only suffixes that begin at minimisers are retained, and of those only the ones whose
gram occurs more than once. Suffixes of a gram are sorted by the words that follow and neighbours
compared; matches are then extended to the left. A run of words counts when the same run stands in
another document; overlapping runs make up a span.

A suffix carries the words that a run around its gram can reach, as 32-bit hashes, so no text is read
again or sent anywhere. Occurrences of a gram are sorted as a stream in bounded buffers; those of a gram
with more than ``HOT`` occurrences are instead counted run by run, which combines before any shuffle.
Tables of bits of a fixed size say which grams repeat and which are hot; a gram taken for either by
mistake costs time and changes nothing.

Nulls and edges: null, empty and shorter texts have no spans. Rows that repeat an id are one document,
so are not each other's match; rows without an id are a document for each text. An empty table gives no
rows. Other columns are not looked at. Words are told apart by hashes: 32 bits each, 50 in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import textbytes
from tessera.llm.shared import cut

LENGTH = 50
GRAM = 8
REACH = LENGTH - GRAM  # words before the gram that a run can hold
HOT = 50_000
FILTER_BITS = 26
BUFFER = 1 << 16
SUFFIX = "gram long, doc long, doc_id long, at long, least int, most int, around binary"
_P = np.uint64(0x9E3779B97F4A7C15)


def minimisers(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all runs of ``LENGTH`` words: gram hash, place (in ``h``), text, and the least and the most words
    before the gram in a run that it is the minimiser of."""
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(np.uint64), none, none, none, none
    gram = np.zeros(n - GRAM + 1, np.uint64)
    for j in range(GRAM):
        gram = gram * _P + h[j : n - GRAM + 1 + j]
    gram = textbytes.mix(gram)
    # upper 40 bits rank grams; the place breaks ties, leftmost first
    key = (gram & ~np.uint64(0xFFFFFF)) | (np.arange(len(gram)).astype(np.uint64) & np.uint64(0xFFFFFF))
    least, width = key, 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin = np.arange(n - LENGTH + 1)
    inside = text[begin] == text[begin + LENGTH - 1]
    begin, least = begin[inside], least[inside]
    at = begin + (((least & np.uint64(0xFFFFFF)).astype(np.int64) - begin) & 0xFFFFFF)
    if not len(at):
        return none.astype(np.uint64), none, none, none, none
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (text[begin[1:]] != text[begin[:-1]])])
    head = np.nonzero(new)[0]
    tail = np.append(head[1:], len(at)) - 1
    place = at[head]
    return gram[place], place, text[place], place - begin[tail], place - begin[head]


def _read(batches, column: int) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            data, at = textbytes.spaced(part.column(column))
            starts, ends, first = textbytes.words(data, at)
            yield part, textbytes.hashes(data, starts, ends), first


def _grams(batches):
    """Grams and how often they are minimisers."""
    for _, h, first in _read(batches, 0):
        gram, count = np.unique(minimisers(h, first)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(count)], ["gram", "n"])


def _held(bits: np.ndarray, gram: np.ndarray) -> np.ndarray:
    place = (gram & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return (bits[place >> 5] >> (place & 31).astype(np.uint32)) & 1 != 0


def _suffixes(repeated: np.ndarray):
    def run(batches):
        for part, h, first in _read(batches, 2):
            gram, at, text, least, most = minimisers(h, first)
            keep = _held(repeated, gram)
            gram, at, text, least, most = (x[keep] for x in (gram, at, text, least, most))
            short = np.concatenate([np.zeros(REACH, np.uint32), (h >> np.uint64(32)).astype(np.uint32), np.zeros(LENGTH, np.uint32)])
            for lo in range(0, len(at), 4096):
                s = slice(lo, lo + 4096)
                around = short[at[s, None] + np.arange(REACH + LENGTH)]
                raw = pa.array([r.tobytes() for r in around], pa.binary())
                rows = pa.array(text[s])
                cols = [pa.array(gram[s].view(np.int64)), part.column(1).take(rows), part.column(0).take(rows), pa.array(at[s] - first[text[s]]), pa.array(least[s].astype(np.int32)), pa.array(most[s].astype(np.int32)), raw]
                yield pa.RecordBatch.from_arrays(cols, ["gram", "doc", "doc_id", "at", "least", "most", "around"])

    return run


def shared_offsets(gram: np.ndarray, doc: np.ndarray, least: np.ndarray, most: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most words before the gram, of the runs that another document holds too; -1 if
    there are none. Rows of a gram must be together."""
    n = len(gram)
    right = np.ascontiguousarray(around[:, REACH:].astype(">u4")).view(f"S{4 * LENGTH}").ravel()
    order = np.lexsort([right, gram])
    g, d, a, lo, hi = gram[order], doc[order], around[order], least[order], most[order]
    same = a[1:, REACH:] == a[:-1, REACH:]
    common = np.where(same.all(axis=1), LENGTH, same.argmin(axis=1))
    common[g[1:] != g[:-1]] = -1
    low, high = np.full(n, -1), np.full(n, -1)
    left = np.zeros(n, np.uint64)
    for o in range(REACH + 1):
        if o:
            left = textbytes.mix(left * _P + a[:, REACH - o].astype(np.uint64) + np.uint64(1))
        rows = np.nonzero((lo <= o) & (o <= hi))[0]
        if len(rows) < 2:
            continue
        suffix = np.concatenate([[0], np.cumsum(common < LENGTH - o)])[rows]
        key = textbytes.mix(left[rows] ^ textbytes.mix(suffix.astype(np.uint64) + np.uint64(77)))
        by = np.argsort(key, kind="stable")
        first = np.nonzero(np.concatenate([[True], np.diff(key[by]) != 0]))[0]
        docs = d[rows][by]
        many = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
        hit = rows[by][np.repeat(many, np.diff(np.append(first, len(rows))))]
        low[hit] = np.where(low[hit] < 0, o, low[hit])
        high[hit] = o
    out = np.empty((2, n), np.int64)
    out[:, order] = low, high
    return out[0], out[1]


def _compare(batches):
    """Spans around each suffix, from batches sorted by gram."""

    def emit(t: pa.Table) -> pa.RecordBatch:
        around = np.frombuffer(b"".join(t["around"].to_pylist()), np.uint32).reshape(-1, REACH + LENGTH)
        low, high = shared_offsets(t["gram"].to_numpy(), t["doc"].to_numpy(), t["least"].to_numpy(), t["most"].to_numpy(), around)
        hit = np.nonzero(low >= 0)[0]
        at = t["at"].to_numpy()[hit]
        ids = t["doc_id"].combine_chunks().take(pa.array(hit))
        docs = t["doc"].combine_chunks().take(pa.array(hit))
        return pa.RecordBatch.from_arrays([docs, ids, pa.array(at - high[hit]), pa.array(at - low[hit] + LENGTH)], ["doc", "doc_id", "begin", "stop"])

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows >= BUFFER:
            last = np.nonzero(np.diff(held["gram"].to_numpy()))[0]
            if len(last):  # a gram has at most HOT rows here
                yield emit(held.slice(0, int(last[-1]) + 1))
                held = held.slice(int(last[-1]) + 1)
    if held is not None and held.num_rows:
        yield emit(held)


def _runs(hot: np.ndarray):
    """Every run of each suffix of a hot gram: (run hash, doc, doc_id, begin)."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(_held(hot, batch.column(0).to_numpy().view(np.uint64))))
            around = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint32).reshape(-1, REACH + LENGTH)
            at, least, most = (batch.column(k).to_numpy() for k in (3, 4, 5))
            for o in range(REACH + 1):
                rows = np.nonzero((least <= o) & (o <= most))[0]
                key = np.zeros(len(rows), np.uint64)
                for j in range(REACH - o, REACH - o + LENGTH):
                    key = textbytes.mix(key * _P + around[rows, j].astype(np.uint64) + np.uint64(1))
                pick = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(1).take(pick), batch.column(2).take(pick), pa.array(at[rows] - o)], ["run", "doc", "doc_id", "begin"])

    return run


def _cold(hot: np.ndarray):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~_held(hot, batch.column(0).to_numpy().view(np.uint64))))

    return run


def _bits(grams: DataFrame) -> np.ndarray:
    place = F.col("gram").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = grams.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("bits"))
    got = words.toArrow()  # at most 2^21 rows
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[got["w"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return out


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words; a row a maximal span, by document."""
    sc = docs.sparkSession.sparkContext
    ident, body = F.col(key).cast("long"), F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(ident.alias("doc_id"), F.when(ident.isNull(), F.xxhash64(body)).otherwise(F.xxhash64(ident)).alias("doc"), body.alias("text"))
    counted = rows.select("text").mapInArrow(_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = cut(counted.where(F.col("n") > 1))
    repeated, much = _bits(counted), _bits(counted.where(F.col("n") > hot))
    suffixes = rows.mapInArrow(_from(sc.broadcast(repeated), _suffixes), SUFFIX)
    if much.any():
        suffixes = cut(suffixes)
    many = sc.broadcast(much)
    quiet = suffixes.mapInArrow(_from(many, _cold), SUFFIX) if much.any() else suffixes
    found = quiet.repartition("gram").sortWithinPartitions("gram").mapInArrow(_compare, "doc long, doc_id long, begin long, stop long")
    if much.any():
        runs = suffixes.mapInArrow(_from(many, _runs), "run long, doc long, doc_id long, begin long")
        common = runs.groupBy("run").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where(F.col("a") != F.col("b")).select("run")
        more = runs.join(common, "run").select("doc", "doc_id", "begin", (F.col("begin") + LENGTH).alias("stop"))
        found = found.unionByName(more)
    order = W.partitionBy("doc", "doc_id").orderBy("begin", "stop")
    reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = found.distinct().withColumn("new", F.when(F.col("begin") <= reach, 0).otherwise(1))
    marked = marked.withColumn("span", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = marked.groupBy("doc", "doc_id", "span").agg(F.min("begin").alias("start_word"), F.max("stop").alias("end_word"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def _from(shared, make):
    """``make`` of a broadcast table, made where it runs."""

    def run(batches):
        yield from make(shared.value)(batches)

    return run
