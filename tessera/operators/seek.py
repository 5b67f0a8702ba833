"""Moves along posting lists, for whole tables of them at a time.

A move (term, target) leads to the term's first posting whose document is not below ``target``. Moves and the postings of
their terms are merged by id within ranges of ids, each range backwards once; a table with a row a term and range tells
what follows beyond it. So the work is that of one sort of both tables, however long a list. The step from a document is
the move to the next id; a term's opening is the move to 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.index import BLOCK_SIZE, RANGE, Index


def seek(index: Index, moves: DataFrame) -> DataFrame:
    """(term, target, block_no, doc_id, tf, remaining): where each move ends, and how many postings there are from
    there on, that one included. Moves beyond a term's last posting, and null ones, have no row."""
    moves = moves.select("term", F.col("target").cast("long").alias("target")).where(F.col("target").isNotNull()).distinct()
    posts = index.postings.select("term", "doc_id", "tf").join(moves.select("term").distinct(), "term", "left_semi")
    here = F.struct("doc_id", "tf")
    both = posts.select("term", F.col("doc_id").alias("_at"), F.lit(None).cast("long").alias("target"), here.alias("_post"))
    both = both.unionByName(moves.select("term", F.col("target").alias("_at"), "target", F.lit(None).cast(both.schema["_post"].dataType).alias("_post")))
    both = both.withColumn("_range", F.floor(F.col("_at") / RANGE))
    # a row a term and range: its postings, and what all later ranges hold
    ranges = both.groupBy("term", "_range").agg(F.count("_post").alias("_n"), F.min("_post").alias("_first"))
    later = W.partitionBy("term").orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    after = ranges.select(
        "term", "_range", F.sum("_n").over(W.partitionBy("term")).alias("_df"),
        F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later"), F.last("_first", ignorenulls=True).over(later).alias("_next"),
    )
    # backwards by id, a posting before the moves to it
    back = W.partitionBy("term", "_range").orderBy(F.desc("_at"), F.col("_post").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = both.withColumn("_here", F.last("_post", ignorenulls=True).over(back)).withColumn("_left", F.count("_post").over(back))
    ends = merged.where(F.col("target").isNotNull()).join(after, ["term", "_range"])
    ends = ends.withColumn("p", F.coalesce("_here", "_next")).withColumn("remaining", F.col("_left") + F.col("_later")).where(F.col("p").isNotNull())
    return ends.select("term", "target", F.floor((F.col("_df") - F.col("remaining")) / BLOCK_SIZE).alias("block_no"), "p.doc_id", "p.tf", "remaining")


def step(index: Index, places: DataFrame) -> DataFrame:
    """The same for the next posting after each place (term, doc_id)."""
    return seek(index, places.select("term", (F.col("doc_id") + 1).alias("target")))
