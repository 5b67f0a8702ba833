"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight that varies over training time t in [0, 1] as a piecewise-linear schedule.
Its integral is the source's cumulative demand for tokens; inverting that at a document's cumulative
size gives the training position at which the document is due. Documents range-sorted by position are
the mix. Main path: built-in column functions only.

A source's documents are ordered by a digest of their id and summed in two steps (totals of
(source, bucket), then inside a bucket), so a source that holds a third of all rows is spread over all
its buckets. Tables of one row a source, or a (source, bucket), are the only ones ever windowed whole.

Nulls and edges: a null source is a source of its own, last in order; a null text has size 0. A
source of total size 0 has target 0. Documents of size 0 are taken 0 times. Repeated rows count each
on its own; ties of the digest are ordered by id, size and a hash of the text. An empty table
gives an empty mix. Only key, text and source are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import SPACE, WORD

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEATS = 2
#: A bucket is the first hexadecimal digits of the digest: 4096 of them a source.
BUCKET_DIGITS = 3
#: (time, factor) knots, by the source's place modulo their number: heavier first, even, heavier last.
SCHEDULES = (((0.0, 1.25), (1.0, 0.75)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``source``, ``place`` (from 0), ``source_size``, ``target``; one row a source.

    Targets share ``share`` times all sizes by weight, none above ``repeats`` times its source's size:
    target = min(weight * level, cap), where the level that uses up the total is found in one pass
    over the sources in the order in which they fill up.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    by = by.withColumn("place", F.row_number().over(order) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    every = W.partitionBy(F.lit(0))
    by = by.withColumns({"total": F.sum("source_size").over(every) * F.lit(share), "all_weight": F.sum("weight").over(every)})
    before = W.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, -1)
    by = by.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    by = by.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    by = by.withColumn("level", F.max(fits).over(every))
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap"))
    return by.select("source", "place", "source_size", target.alias("target"))


def due(share: Column, place: Column, schedules: tuple = SCHEDULES) -> Column:
    """Time in [0, 1] at which a source's cumulative demand reaches ``share`` of its target."""
    options = []
    for knots in schedules:
        area = [0.0]
        for (t0, f0), (t1, f1) in zip(knots, knots[1:]):
            area.append(area[-1] + (t1 - t0) * (f0 + f1) / 2)
        value = F.lit(float(knots[-1][0]))
        for i in reversed(range(len(knots) - 1)):
            (t0, f0), (t1, f1) = knots[i], knots[i + 1]
            rest = F.greatest(share * F.lit(area[-1]) - F.lit(area[i]), F.lit(0.0))
            slope = (f1 - f0) / (t1 - t0)
            # f0 x + slope x^2 / 2 = rest, in a form that also holds for a slope of 0
            x = 2 * rest / (F.lit(f0) + F.sqrt(F.greatest(F.lit(f0 * f0) + 2 * slope * rest, F.lit(1e-300))))
            value = F.when(share * F.lit(area[-1]) <= F.lit(area[i + 1]), F.lit(t0) + x).otherwise(value)
        options.append(value)
    out = options[0]
    for i, value in enumerate(options[1:], 1):
        out = F.when(place % len(options) == i, value).otherwise(out)
    return F.least(out, F.lit(1.0))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, schedules: tuple = SCHEDULES, whole: bool = False) -> DataFrame:
    """One row a document: key, source, size, source_size, target, ``taken`` (words, over all passes)
    and ``passes``: an array of (pass, taken, position) with the training position of each; ``whole``
    adds the row itself as ``_row`` and the words of its source before it as ``_begins``.

    Passes over a source follow one another: document k of a source is due again one source size
    later. What exceeds the target is not taken; the document across it is taken in part.
    """
    ident = F.col(key).cast("string")
    sized = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.md5(F.coalesce(ident, F.lit(""))).alias("_digest"), F.xxhash64(text).alias("_tie"), *([F.struct(*docs.columns).alias("_row")] if whole else []))
    # windows and join share these columns, and so one shuffle of the rows
    sized = sized.withColumns({"_s": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull(), "_bucket": F.substring("_digest", 1, BUCKET_DIGITS)})
    place = ["_s", "_null", "_bucket"]
    buckets = sized.groupBy("source", *place).agg(F.sum("size").alias("size"))
    targets = source_targets(buckets, weights, share, repeats)
    before = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.select("source", *place, F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")).alias("_before"))
    targets = targets.select(F.col("source").alias("_ts"), "place", "source_size", "target")
    offsets = offsets.join(targets, F.col("source").eqNullSafe(F.col("_ts"))).drop("_ts", "source")
    inside = W.partitionBy(*place).orderBy("_digest", "_key", "size", "_tie").rowsBetween(W.unboundedPreceding, -1)
    df = sized.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    df = df.join(offsets, place)
    goal, start = F.floor(F.col("target") + F.lit(1e-6)).cast("long"), F.col("_before") + F.col("_inside")
    runs = []
    for n in range(repeats):
        at = start + n * F.col("source_size")
        part = F.greatest(F.least(goal - at, F.col("size")), F.lit(0).cast("long"))
        runs.append(F.struct(F.lit(n).alias("pass"), part.alias("taken"), due(at / F.col("target"), F.col("place"), schedules).alias("position")))
    df = df.withColumn("passes", F.filter(F.array(*runs), lambda r: r["taken"] > 0))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda acc, r: acc + r["taken"])
    return df.select(F.col("_key").alias(key), "source", "size", "source_size", "target", taken.alias("taken"), "passes", *(["_row", start.alias("_begins")] if whole else []))


def draws(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """A row each time that a document is due, range-sorted by training position: what ``plan`` says of it, its
    row as ``_row``, ``_at`` (the position), ``_body`` (the text, cut where it is taken in part) and ``_part``
    (whether it is). Documents that are never due come last, once, without ``_at`` and ``_body``.
    """
    planned = plan(docs, key, text, source, whole=True, **options)
    due_ = planned.select(F.col(key).alias("_id"), F.col("source").alias("_source"), "size", "source_size", "target", "_begins", "_row", F.explode_outer("passes").alias("_p"))
    body = F.col("_row").getField(text)
    pieces = F.regexp_extract_all(body, F.lit(rf"[{SPACE}]*{WORD}[{SPACE}]*"), 0)
    part = F.col("_p.taken") < F.col("size")
    cut = F.when(part, F.array_join(F.slice(pieces, 1, F.col("_p.taken").cast("int")), "")).otherwise(body)
    placed = due_.select("_id", "_source", "size", "source_size", "target", "_begins", "_row", part.alias("_part"), F.when(F.col("_p").isNotNull(), cut).alias("_body"), F.col("_p.position").alias("_at"))
    order = [F.col("_at").asc_nulls_last(), F.col("_id")]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order)


def taken_words(drawn: DataFrame) -> DataFrame:
    """A row a document, counted from the texts of ``draws`` themselves: ``_id``, size, source_size, target, taken,
    n_passes and ``position`` (of its first pass)."""
    # words of its source before it tell a document that is due from all others
    every = drawn.groupBy("_id", "_source", "_begins", "size", "source_size", "target").agg(
        F.coalesce(F.sum(word_count(F.col("_body"))), F.lit(0)).cast("long").alias("taken"), F.count("_at").cast("int").alias("n_passes"), F.array_min(F.collect_list("_at")).alias("position"), F.count("*").alias("_n"))
    # rows of size 0 may be repeated
    rows = every.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("n_passes") > 0, 1).otherwise(F.col("_n").cast("int")))))
    return rows.select("_id", "size", "source_size", "target", "taken", "n_passes", "position")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as taken, their texts cut where taken in part, range-sorted
    by training position. A column ``n_chars``, if there is one, follows the text.

    Rows of size 0 carry no words and are not part of a mix.
    """
    placed = draws(docs, key, text, source, **options).where(F.col("_at").isNotNull())
    own = {c: F.col("_row").getField(c) for c in docs.columns} | {text: F.col("_body")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("_part"), F.length("_body").cast("long")).otherwise(own["n_chars"])
    return placed.select(*[c.alias(name) for name, c in own.items()])
