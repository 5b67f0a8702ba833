"""Documents from a directory tree."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.index import with_ids
from tessera.sources.files import Files

EXTENSIONS = ("txt", "md", "markdown", "rst", "text")


def clean_extensions(extensions: Iterable[str]) -> list[str]:
    return [e.lstrip(".").lower() for e in extensions]


def accepts(relative: Column, extensions: Iterable[str] = EXTENSIONS) -> Column:
    """By extension, in any case; nothing below the root may be hidden. A file without one never matches."""
    hidden = F.exists(F.split(relative, "/"), lambda p: p.startswith("."))
    return ~hidden & F.lower(F.regexp_extract(relative, r"[^/]\.([^./]+)$", 1)).isin(*clean_extensions(extensions))


def title_of(path: Column, text: Column) -> Column:
    """The first line with something left after its leading #s, at most 80 characters; else the file's
    stem; else ``untitled``."""
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: trim(F.regexp_replace(trim(x), r"^#+", "")))
    line = F.get(F.filter(lines, lambda x: x != ""), F.lit(0))
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.substring(line, 1, 80), F.when(stem != "", stem), F.lit("untitled"))


def read_tree(spark: SparkSession, root: str, extensions: Iterable[str] = EXTENSIONS) -> DataFrame:
    """(doc_id, uri, title, text) of the files below ``root``, in the order of their path's parts. A file
    that is not UTF-8 fails the read, and nothing is then indexed."""
    base = str(Files(spark, root).fs.makeQualified(Files(spark, root).path(root)))
    prefix = urlparse(base).path.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), r"^[a-z0-9]+:/+", "/")
    # Spark plans no split for a file of no bytes
    empty = spark.createDataFrame([(p,) for p in Files(spark, root).empty(root)], "uri string")
    rows = raw.select(path.alias("uri"), "content").unionByName(empty.withColumn("content", F.lit(b""))).withColumn("relative", F.substr("uri", F.lit(len(unquote(prefix)) + 1)))
    rows = rows.where(accepts(F.col("relative"), extensions))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.col("uri"), F.lit(": not UTF-8"))))
    docs = rows.select("uri", F.split("relative", "/").alias("parts"), text.alias("text"))
    docs = docs.withColumn("title", title_of(F.col("uri"), F.col("text")))
    return with_ids(docs, ["parts"]).select("doc_id", "uri", "title", "text")
