"""The inverted index as DataFrames.

``documents`` (doc_id, uri, title, text, length), ``postings`` (term, doc_id, positions, tf, length), and
what follows from the postings: ``terms``, ``blocks``, ``stats``. A document's postings are made where its
text is read, so building needs no shuffle of tokens. Nothing is numbered by one global window: a term's
postings are numbered within ranges of document ids and the ranges added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import codec
from tessera.functions.analysis import Analyzer, remembered, split
from tessera.functions.ranking import Bm25
from tessera.sources.files import cut

BLOCK_SIZE = 128
#: Document ids a range holds when a term's postings are numbered.
RANGE = 1 << 16

POSTINGS = "term string, doc_id long, positions array<int>, tf int, length int"
#: Postings with ``size``, the bytes of their positions, and documents, whose term is null, in one table.
ANALYSED = f"{POSTINGS}, size int, uri string, title string, text string"
NAMES = ["term", "doc_id", "positions", "tf", "length", "size", "uri", "title", "text"]


def _postings(analyzer: Analyzer, documents: bool = False):
    """Postings of batches of (doc_id, text): words are coded once a slice, and only distinct ones analysed. With
    ``documents``, of (doc_id, text, uri, title), the rows of ANALYSED."""

    def run(batches):
        term = remembered(analyzer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [split(text) if text else [] for text in part.column(1).to_pylist()]
                posts, length = coded(part.column(0), list(chain.from_iterable(found)), np.array([len(w) for w in found], np.int64), term)
                if not documents:
                    yield pa.RecordBatch.from_arrays(posts[:5], NAMES[:5])
                    continue
                none = [pa.nulls(len(posts[0]), pa.string())] * 3
                yield pa.RecordBatch.from_arrays([*posts, *none], NAMES)
                none = [pa.nulls(part.num_rows, a.type) for a in posts]
                yield pa.RecordBatch.from_arrays(
                    [none[0], part.column(0), none[2], none[3], pa.array(length.astype(np.int32)), none[5], part.column(2), part.column(3), part.column(1)], NAMES
                )

    def coded(ids: pa.Array, words: list[str], sizes: np.ndarray, term) -> tuple[list[pa.Array], np.ndarray]:
        words = pa.array(words, pa.string()).dictionary_encode()
        codes: dict[str, int] = {}
        code_of = np.array([-1 if (t := term(w)) is None else codes.setdefault(t, len(codes)) for w in words.dictionary.to_pylist()], np.int64)
        code = code_of[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        position = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = np.flatnonzero(code >= 0)
        length = np.bincount(doc[kept], minlength=len(sizes))
        key = doc[kept] * len(codes) + code[kept]
        order = np.argsort(key, kind="stable")
        key, kept = key[order], kept[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        ends = np.append(first, len(key))
        at = kept[first]
        gap = np.diff(position[kept], prepend=0)
        gap[first] = position[at]
        size = np.diff(np.append(0, np.cumsum(codec.varint_lengths(gap)))[ends])
        cols = [
            pa.array(list(codes), pa.string()).take(pa.array(code[at])), ids.take(pa.array(doc[at])),
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(position[kept].astype(np.int32))),
            pa.array(np.diff(ends).astype(np.int32)), pa.array(length[doc[at]].astype(np.int32)), pa.array(size.astype(np.int32)),
        ]
        return cols, length

    return run


@dataclass(frozen=True)
class Index:
    """``documents`` and ``postings``; ``on_disk``: where a loaded index lies, which makes it read-only."""

    documents: DataFrame
    postings: DataFrame
    analyzer: Analyzer = field(default_factory=Analyzer)
    on_disk: str | None = None
    saved_terms: DataFrame | None = None
    saved_blocks: DataFrame | None = None
    totals: tuple[int, int] | None = None
    #: (vocabulary, postings, bytes of the postings), where they are known
    sizes: tuple[int, int, int] | None = None
    #: ANALYSED, where the index is not saved yet: what saving it reads, so that texts are analysed once
    analysed: DataFrame | None = None
    #: a saved index's postings as ``placed`` made them
    saved_places: DataFrame | None = None

    # -- scans -----------------------------------------------------------------
    def term(self, *terms: str) -> DataFrame:
        """Postings of the given terms; a saved index prunes by its sorted files."""
        return self.postings.where(F.col("term").isin(*terms))

    def document(self, doc_id: int) -> DataFrame:
        return self.documents.where(F.col("doc_id") == doc_id)

    def vocabulary(self) -> DataFrame:
        return self.terms().select("term")

    # -- statistics ------------------------------------------------------------
    def terms(self) -> DataFrame:
        """(term, df, max_tf, min_len)"""
        if self.saved_terms is not None:
            return self.saved_terms
        return self.postings.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("length").alias("min_len"))

    def blocks(self) -> DataFrame:
        """(term, block_no, last_doc, count, max_tf, min_len) of each 128 postings."""
        return self.block_table().select("term", "block_no", "last_doc", "count", "max_tf", "min_len")

    def block_table(self) -> DataFrame:
        """``blocks`` with ``first_doc`` and ``bytes``, what the block's postings would take."""
        if self.saved_blocks is not None:
            return self.saved_blocks
        slim = self.postings.select("term", "doc_id", "tf", "length", codec.positions_length(F.col("positions")).alias("size"))
        return blocked(placed(slim))

    def gaps(self) -> DataFrame:
        """(term, doc_id, block_no, gap): from the posting before in its block; a block's first stands as it is."""
        places = self.saved_places if self.saved_places is not None else placed(self.postings.select("term", "doc_id"))
        return places.select("term", "doc_id", block_no().alias("block_no"), gap().alias("gap"))

    def postings_bytes(self) -> DataFrame:
        """One row: bytes that the postings would take as gaps and variable-length integers."""
        return self.block_table().agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("postings_bytes"))

    def corpus(self) -> DataFrame:
        """One row: n_docs, total_length. Documents without tokens count."""
        if self.totals is not None:
            n, total = self.totals
            return self.documents.sparkSession.range(1).select(F.lit(n).cast("long").alias("n_docs"), F.lit(total).cast("long").alias("total_length"))
        return self.documents.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_length"))

    def collection(self) -> tuple[int, int]:
        if self.totals is not None:
            return self.totals
        row = self.corpus().first()
        return row["n_docs"], row["total_length"]

    def stats(self) -> DataFrame:
        """One row: documents, vocabulary, postings, avg_doc_len, postings_bytes."""
        if self.totals is not None and self.sizes is not None:
            (n, total), (vocabulary, postings, size) = self.totals, self.sizes
            row = (n, vocabulary, postings, total / n if n else 0.0, size)
            return self.documents.sparkSession.createDataFrame([row], "documents long, vocabulary long, postings long, avg_doc_len double, postings_bytes long")
        average = F.when(F.col("n_docs") > 0, F.col("total_length") / F.col("n_docs")).otherwise(0.0)
        docs = self.corpus().select(F.col("n_docs").alias("documents"), average.alias("avg_doc_len"))
        counts = self.terms().agg(F.count("*").alias("vocabulary"), F.coalesce(F.sum("df"), F.lit(0)).cast("long").alias("postings"))
        # three tables of one row
        return docs.crossJoin(counts).crossJoin(self.postings_bytes()).select("documents", "vocabulary", "postings", "avg_doc_len", "postings_bytes")

    def bounds(self, bm25: Bm25, blocks: bool = False) -> DataFrame:
        """Terms (or blocks) with ``upper_bound``, which no posting's score exceeds."""
        n, total = self.collection()
        table = self.block_table().join(self.terms().select("term", "df"), "term") if blocks else self.terms()
        average = F.lit(total / n if n else 0.0)
        return table.withColumn("upper_bound", bm25.score_expr(F.col("max_tf"), F.col("min_len"), average, bm25.idf_expr(F.col("df"), F.lit(float(n)))))

    # -- lifecycle ---------------------------------------------------------------
    def merge(self, other: Index) -> Index:
        """The other's documents follow this index's, their ids moved up by its size."""
        shift = F.col("doc_id") + F.lit(self.next_id())
        docs = other.documents.withColumn("doc_id", shift)
        posts = other.postings.withColumn("doc_id", shift)
        both = None
        if self.analysed is not None and other.analysed is not None:
            both = self.analysed.unionByName(other.analysed.withColumn("doc_id", shift))
        return Index(self.documents.unionByName(docs), self.postings.unionByName(posts), self.analyzer, analysed=both)

    def next_id(self) -> int:
        last = self.documents.agg(F.max("doc_id").alias("m")).first()["m"]
        return 0 if last is None else last + 1

    @contextmanager
    def edit(self) -> Iterator[Edit]:
        """A session that adds documents; ``session.index`` is the new index. A loaded index is read-only."""
        if self.on_disk:
            raise PermissionError(f"{self.on_disk}: a loaded index is read-only")
        yield Edit(self)

    def cached(self) -> Index:
        return replace(self, documents=self.documents.persist(), postings=self.postings.persist(), analysed=None)

    def read_once(self, terms: list[str], positions: bool) -> Index:
        """An index with the postings of ``terms`` alone and its totals, for which the texts are analysed once, now. It is
        the same index where that was done before."""
        if self.analysed is None or self.totals is not None:
            return self
        wanted = self.analysed.where(F.col("term").isin(*terms) | F.col("term").isNull())
        found = cut(wanted.select("term", "doc_id", *(["positions"] if positions else []), "tf", "length"))
        row = found.where(F.col("term").isNull()).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first()
        return replace(self, postings=found.where(F.col("term").isNotNull()), totals=(row["n"], row["total"]), analysed=None)


def placed(postings: DataFrame, spread=lambda df: df) -> DataFrame:
    """Postings with ``nth``, their place in the term's list by document, from 0, and ``step``, how far they are from the
    posting before; at a block's first posting it is 0. Postings are counted by term and range of ids first. What stands before a
    range goes as a row of its own to the range's head, so that the postings are shuffled and sorted once: by ``spread``, if
    that keeps a term's range together, in the order of ``term``, ``_range`` and ``doc_id``."""
    ranged = postings.withColumn("_range", F.floor(F.col("doc_id") / RANGE))
    counts = ranged.groupBy("term", "_range").agg(F.count("*").alias("_n"), F.max("doc_id").alias("_last"))
    before = W.partitionBy("term").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    heads = counts.select("term", "_range", F.sum("_n").over(before).alias("_before"), F.max("_last").over(before).alias("_prior")).where(F.col("_before") > 0)
    both = spread(ranged.unionByName(heads, allowMissingColumns=True))
    within = W.partitionBy("term", "_range").orderBy("doc_id")  # nulls, which heads have, come first
    upto = within.rowsBetween(W.unboundedPreceding, W.currentRow)
    nth = F.coalesce(F.max("_before").over(upto), F.lit(0)) + F.count("doc_id").over(upto) - 1
    prior = F.coalesce(F.lag("doc_id").over(within), F.max("_prior").over(upto))
    out = both.withColumn("nth", nth).withColumn("_prior", prior).where(F.col("doc_id").isNotNull())
    step = F.when(F.col("nth") % BLOCK_SIZE == 0, 0).otherwise(F.col("doc_id") - F.col("_prior"))
    return out.withColumn("step", step).drop("_range", "_before", "_prior")


def block_no() -> Column:
    return F.floor(F.col("nth") / BLOCK_SIZE)


def gap() -> Column:
    """The gap of a placed posting: a block's first stands as it is."""
    return F.when(F.col("nth") % BLOCK_SIZE == 0, F.col("doc_id")).otherwise(F.col("step"))


def blocked(places: DataFrame) -> DataFrame:
    """The block table of placed postings with ``size``."""
    held = F.sum((codec.varint_length(gap()) + codec.varint_length(F.col("tf")) + F.col("size")).cast("long"))
    return places.groupBy("term", block_no().alias("block_no")).agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("count"), F.max("tf").alias("max_tf"), F.min("length").alias("min_len"), held.alias("bytes")
    )


class Edit:
    def __init__(self, index: Index):
        self.index = index

    def add(self, docs: DataFrame) -> None:
        """Documents (uri, title, text), in the order of their ids if they have any."""
        self.index = self.index.merge(build(docs if "doc_id" in docs.columns else with_ids(docs, ["uri"]), self.index.analyzer))


def with_ids(docs: DataFrame, order: list) -> DataFrame:
    """``doc_id`` from 0 in the given order, by range partitions and their offsets."""
    spark = docs.sparkSession
    ranged = docs.repartitionByRange(max(1, spark.sparkContext.defaultParallelism), *order).sortWithinPartitions(*order)
    marked = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    marked = cut(marked)
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    offsets = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = marked.join(offsets, "_part")
    return placed.withColumn("doc_id", F.col("_row") - F.col("_first") + F.col("_before")).drop("_part", "_row", "_first", "_before")


def build(docs: DataFrame, analyzer: Analyzer | None = None) -> Index:
    """Documents (doc_id, text, and uri and title if there are any) to an index. A null text is empty."""
    analyzer = analyzer or Analyzer()
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("uri", "title")],
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    postings = source.select("doc_id", "text").mapInArrow(_postings(analyzer), POSTINGS)
    analysed = source.select("doc_id", "text", "uri", "title").mapInArrow(_postings(analyzer, True), ANALYSED)
    return Index(with_lengths(source, postings), postings, analyzer, analysed=analysed)


def with_lengths(source: DataFrame, postings: DataFrame) -> DataFrame:
    """``source`` with each document's number of tokens, which all its postings hold."""
    lengths = postings.groupBy("doc_id").agg(F.first("length").alias("length"))
    return source.join(lengths, "doc_id", "left").withColumn("length", F.coalesce("length", F.lit(0)))
