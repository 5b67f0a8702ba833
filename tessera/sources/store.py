"""A saved index: sorted Parquet tables and a ``meta.json`` that is written last.

A directory without ``meta.json`` is no index, so a write that breaks off leaves none.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import codec
from tessera.functions.analysis import Analyzer
from tessera.operators.index import Index, blocked, placed
from tessera.sources.files import Files

FORMAT = 3
POSTED = ("term", "doc_id", "positions", "tf", "length")
TABLES = ("postings", "documents", "terms", "blocks")


class StoreError(OSError):
    """``kind``: missing, decode, version or incomplete."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def save(index: Index, path: str) -> Index:
    """Writes the index and returns it as loaded. Postings are sorted by term and document, so that a
    term's row groups, and a document's pages in them, can be skipped."""
    if index.on_disk:
        raise PermissionError(f"{index.on_disk}: already a saved index")
    spark = index.documents.sparkSession
    files = Files(spark, path)
    if files.exists(path):
        files.delete(path)
    # texts are analysed once: all else reads what that wrote
    rows(index).write.option("compression", "zstd").parquet(f"{path}/analysed")
    analysed = spark.read.parquet(f"{path}/analysed")
    analysed.where(F.col("term").isNull()).select("doc_id", "uri", "title", "text", "length").write.option("compression", "zstd").parquet(f"{path}/documents")
    found = analysed.where(F.col("term").isNotNull()).select("term", "doc_id", "positions", "length", "size")
    order = ("term", "_range", "doc_id")
    places = placed(found, lambda df: df.repartitionByRange("term", "_range").sortWithinPartitions(*order)).withColumn("tf", F.size("positions"))
    places.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(f"{path}/postings")
    docs, posts = spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/postings")
    written = Index(docs, posts.select(*POSTED), index.analyzer)
    blocked(posts).repartitionByRange("term", "block_no").sortWithinPartitions("term", "block_no").write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    terms = blocks.groupBy("term").agg(F.sum("count").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    files.delete(f"{path}/analysed")
    n, total = written.collection()
    sizes = blocks.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    vocabulary = spark.read.parquet(f"{path}/terms").count()
    meta = {"format": FORMAT, "n_docs": n, "total_length": total, "vocabulary": vocabulary, "postings": sizes["n"], "postings_bytes": sizes["b"], "analyzer": json.loads(index.analyzer.to_json())}
    files.write(f"{path}/meta.json", json.dumps(meta))
    return load(spark, path)


def rows(index: Index) -> DataFrame:
    """ANALYSED of an index that is not saved, from its tables if they were not made from texts here."""
    if index.analysed is not None:
        return index.analysed
    posts = index.postings.select(*POSTED, codec.positions_length(F.col("positions")).cast("int").alias("size"))
    return posts.unionByName(index.documents.select("doc_id", "uri", "title", "text", F.col("length").cast("int").alias("length")), allowMissingColumns=True)


def load(spark: SparkSession, path: str) -> Index:
    """Opens lazily; says what is wrong with a directory that is no index of this format."""
    files = Files(spark, path)
    if not files.exists(path):
        raise StoreError("missing", f"{path}: no such index")
    if not files.exists(f"{path}/meta.json"):
        raise StoreError("incomplete", f"{path}: no meta.json; not an index, or its writing broke off")
    try:
        meta = json.loads(files.read(f"{path}/meta.json"))
        found = meta["format"]
    except (ValueError, KeyError, TypeError) as e:
        raise StoreError("decode", f"{path}/meta.json: {e}") from e
    if found != FORMAT:
        raise StoreError("version", f"{path}: format {found}, expected {FORMAT}")
    for t in TABLES:
        if not files.exists(f"{path}/{t}/_SUCCESS"):
            raise StoreError("incomplete", f"{path}: table {t} is missing")
    posts, docs, terms, blocks = (spark.read.parquet(f"{path}/{t}") for t in TABLES)
    sizes = tuple(meta[k] for k in ("vocabulary", "postings", "postings_bytes"))
    return Index(
        docs, posts.select(*POSTED), Analyzer.from_json(json.dumps(meta["analyzer"])), path, terms, blocks, (meta["n_docs"], meta["total_length"]), sizes, saved_places=posts.drop("positions")
    )
