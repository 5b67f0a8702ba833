"""The queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, neardup, neighbours, ngram, packing, passages, quality, secrets, toxicity, wavelet
from tessera.llm.shared import table
from tessera.llm.vocabularies import vocabulary


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.ledger(table(spark, sf_dir, "documents"))
    return rated.select(
        "doc_id", *quality.MEASURES, "failed_bits",
        (~quality.passes(quality.BASE)).alias("base_failed"), quality.passes(quality.FULL).alias("kept"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the mix itself: the texts as they are due, in order of training position, and the words in them."""
    mixed = mixing.taken_words(mixing.draws(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
    return mixed.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken", "n_passes", F.round("position", 9).alias("position"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read(*wavelet.encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), words=vocabulary("byte_bpe_50k.json"))


def _fold(name: str, n: int):
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % n


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, learn=_fold("doc_id", 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), asked=F.col("vec_id") % 20 == 0)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = ngram.score(docs, ngram.fit(docs, learn=_fold("doc_id", 10) != 0))
    return scored.withColumn("held_out", _fold("doc_id", 10) == 0)


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.spans(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_neighbours, op3_packing, op4_neardup, op5_mixing, op6_toxicity, op7_language, op8_tokens, op9_passages, op10_secrets)}
