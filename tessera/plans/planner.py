"""Queries to DataFrames.

One scan of the postings serves all clauses of all queries. Term clauses read frequencies; phrase
clauses align positions inside arrays. Scores, required and excluded clauses are then decided in one
aggregation by document, and texts are fetched for the best hits alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.analysis import analyze_udf
from tessera.functions.ranking import Bm25
from tessera.functions.snippet import Highlighter, snippet_udf
from tessera.operators.index import Index
from tessera.plans.query import Occur, Query, parse

CLAUSE = "query_id long, clause_id int, occur string, slots int, term string, offset int"
#: Terms that a scan is filtered by as literals; beyond, the join with the clauses alone decides.
LITERALS = 1000
#: Ranges of document ids that blocks' bounds are added up in.
RANGES = 1 << 16
#: Matches of a batch of queries that a task adds up.
PART = 1 << 20
#: A score is rounded before it is ordered by, so that the order of a sum cannot break ties.
DIGITS = 6


def clause_table(index: Index, queries: dict[int, Query]) -> DataFrame:
    rows = [(q, c, clause.occur.value, len(clause.terms), term, offset) for q, query in queries.items() for c, clause in enumerate(query.clauses) for term, offset in clause.terms]
    return index.documents.sparkSession.createDataFrame(rows, CLAUSE)


def _aligned(parts: Column) -> Column:
    """Starts at which every slot of a phrase stands at its offset."""
    first = F.element_at(parts, 1)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    # offsets are relative to the first kept word, whose own is 0
    return F.size(F.filter(first["positions"], lambda s: F.forall(rest, lambda r: F.array_contains(r["positions"], s + r["offset"]))))


def matches(index: Index, queries: dict[int, Query]) -> DataFrame:
    """(query_id, clause_id, occur, doc_id, tf, length) of every clause."""
    clauses = clause_table(index, queries)
    terms = sorted({t for q in queries.values() for c in q.clauses for t, _ in c.terms})
    posts = index.term(*terms) if len(terms) <= LITERALS else index.postings
    phrases = any(q.has_phrase for q in queries.values())
    posts = posts.select("term", "doc_id", "tf", "length", *(["positions"] if phrases else []))
    hits = posts.join(clauses, "term")
    single = hits.where(F.col("slots") == 1).select("query_id", "clause_id", "occur", "doc_id", "tf", "length")
    if not phrases:
        return single
    slot = F.struct("offset", "positions")
    gathered = hits.where(F.col("slots") > 1).groupBy("query_id", "clause_id", "occur", "slots", "doc_id").agg(F.sort_array(F.collect_list(slot)).alias("parts"), F.first("length").alias("length"))
    whole = gathered.where(F.size("parts") == F.col("slots")).withColumn("tf", _aligned(F.col("parts")))
    return single.unionByName(whole.where(F.col("tf") > 0).select("query_id", "clause_id", "occur", "doc_id", "tf", "length"))


def phrase_by_join(index: Index, terms: tuple[tuple[str, int], ...]) -> DataFrame:
    """(doc_id, tf) of a phrase by equi-joins of exploded positions: the plain form of ``_aligned``."""
    out = None
    for term, offset in terms:
        at = index.term(term).select("doc_id", F.explode("positions").alias("p")).select("doc_id", (F.col("p") - offset).alias("start"))
        out = at if out is None else out.join(at, ["doc_id", "start"])
    return out.groupBy("doc_id").agg(F.count("*").alias("tf"))


def scored(index: Index, queries: dict[int, Query], bm25: Bm25) -> DataFrame:
    """(query_id, doc_id, score) of all documents that match."""
    asked = sorted({t for q in queries.values() for c in q.clauses for t, _ in c.terms})
    if len(asked) <= LITERALS:
        index = index.read_once(asked, any(q.has_phrase for q in queries.values()))
    n, total = index.collection()
    found = matches(index, queries)
    if index.saved_terms is not None and not any(q.has_phrase for q in queries.values()):
        terms = sorted({t for q in queries.values() for c in q.clauses for t, _ in c.terms})
        saved = index.terms().where(F.col("term").isin(*terms)) if len(terms) <= LITERALS else index.terms()
        dfs = saved.select("term", "df").join(clause_table(index, queries), "term").select("query_id", "clause_id", "df")
    else:
        dfs = found.groupBy("query_id", "clause_id").agg(F.count("*").alias("df"))
    average = F.lit(total / n if n else 0.0)
    value = bm25.score_expr(F.col("tf"), F.col("length"), average, bm25.idf_expr(F.col("df"), F.lit(float(n))))
    wanted = F.col("occur") != Occur.MUST_NOT.value
    rated = found.join(dfs, ["query_id", "clause_id"]).withColumn("value", F.when(wanted, value))
    count = lambda kind: F.count(F.when(F.col("occur") == kind.value, 1))
    by_doc = rated.groupBy("query_id", "doc_id").agg(F.sum("value").alias("score"), count(Occur.MUST).alias("musts"), count(Occur.MUST_NOT).alias("nots"))
    needed = {q: sum(c.occur is Occur.MUST for c in query.clauses) for q, query in queries.items()}
    if len(needed) == 1 or len(set(needed.values())) == 1:
        required = F.lit(next(iter(needed.values()), 0))
    else:
        table = index.documents.sparkSession.createDataFrame(list(needed.items()), "query_id long, required int")
        by_doc, required = by_doc.join(table, "query_id"), F.col("required")
    kept = by_doc.where((F.col("nots") == 0) & (F.col("musts") == required) & F.col("score").isNotNull())
    return kept.select("query_id", "doc_id", F.round("score", DIGITS).alias("score"))


def top_k(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), F.asc("doc_id")).limit(max(0, k))


@dataclass(frozen=True)
class Searcher:
    index: Index
    bm25: Bm25 = Bm25()
    pruning: bool = True

    def _query(self, query: Query | str) -> Query:
        return parse(query, self.index.analyzer) if isinstance(query, str) else query

    def strategy(self, query: Query | str) -> str:
        return "wand" if self.pruning and self._query(query).is_prunable else "exhaustive"

    def search(self, query: Query | str, k: int = 10) -> DataFrame:
        """(doc_id, score), best first; ties by id."""
        query = self._query(query)
        if self.pruning and query.is_prunable and k > 0 and self.index.on_disk:
            return self.pruned(query, k)
        return top_k(scored(self.index, {0: query}, self.bm25).select("doc_id", "score"), k)

    def exhaustive(self, query: Query | str, k: int = 10) -> DataFrame:
        return top_k(scored(self.index, {0: self._query(query)}, self.bm25).select("doc_id", "score"), k)

    def pruned(self, query: Query | str, k: int = 10) -> DataFrame:
        """The same hits by upper bounds. The k-th best score of one clause alone is a score that k documents
        reach; documents in which all clauses' bounds add up to less cannot be among the best. Such are those
        that hold only clauses with the lowest bounds, and those in ranges of ids in which the bounds of all
        clauses' blocks add up to less: of these, no posting is read.
        """
        return self._pruned(query, k)[0]

    def _pruned(self, query: Query | str, k: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None, int]:
        """The hits; the documents scored (None: all) and the blocks with ``kept``, of the plan that gives them;
        candidates."""
        query = self._query(query)
        terms = [c.terms[0][0] for c in query.clauses]
        rows = {r["term"]: r for r in self.index.bounds(self.bm25).where(F.col("term").isin(*terms)).collect()}  # a row a term
        present = sorted((t for t in terms if t in rows), key=lambda t: rows[t]["upper_bound"])
        candidates = sum(rows[t]["df"] for t in present)
        if not present or k <= 0:
            return self.exhaustive(query, k), None, None, candidates
        n, total = self.index.collection()
        average = F.lit(total / n if n else 0.0)

        def value(term: str) -> Column:
            return self.bm25.score_expr(F.col("tf"), F.col("length"), average, F.lit(self.bm25.idf(rows[term]["df"], n)))

        best = present[-1]
        seed = self.index.term(best).select(value(best).alias("s")).orderBy(F.desc("s")).limit(k).agg(F.min("s").alias("least"), F.count("*").alias("n")).first()
        threshold = (seed["least"] if seed["n"] == k else 0.0) - 10.0**-DIGITS
        bound, low, reach = {t: rows[t]["upper_bound"] for t in present}, [], 0.0
        for t in present:
            if reach + bound[t] >= threshold:
                break
            reach += bound[t]
            low.append(t)
        high = present[len(low) :]
        if not high:
            return self.exhaustive(query, k), None, None, candidates
        times = {t: present.count(t) for t in present}
        width = max(1, -(-self.index.next_id() // RANGES))
        ranges, blocks = self._ranges(times, threshold, width)
        posts = self.index.term(*set(present)).select("term", "doc_id", "tf", "length")
        span = ranges.agg(F.min("range").alias("lo"), F.max("range").alias("hi")).first()
        if span["lo"] is not None:
            posts = posts.where((F.col("doc_id") >= span["lo"] * width) & (F.col("doc_id") < (span["hi"] + 1) * width))
        # at most RANGES rows of a long
        posts = posts.withColumn("range", F.floor(F.col("doc_id") / width)).join(F.broadcast(ranges), "range", "left_semi").drop("range")
        docs = posts.where(F.col("term").isin(*set(high))).select("doc_id").distinct()
        kept = posts.join(docs, "doc_id", "left_semi") if low else posts
        total_value = None
        for t in times:
            part = F.when(F.col("term") == t, value(t) * times[t])
            total_value = part if total_value is None else total_value.when(F.col("term") == t, value(t) * times[t])
        hits = kept.groupBy("doc_id").agg(F.round(F.sum(total_value), DIGITS).alias("score"))
        return top_k(hits, k), hits, blocks, candidates

    def _ranges(self, times: dict[str, int], threshold: float, width: int) -> tuple[DataFrame, DataFrame]:
        """The ranges of ``width`` ids in which the block bounds of the terms add up to the threshold, and the
        terms' blocks with ``kept``: whether they reach into one of these."""
        terms = list(times)
        blocks = self.index.bounds(self.bm25, blocks=True).where(F.col("term").isin(*terms)).select("term", "block_no", "first_doc", "last_doc", "upper_bound")
        lo, hi = F.floor(F.col("first_doc") / width), F.floor(F.col("last_doc") / width)
        spread = blocks.withColumn("range", F.explode(F.sequence(lo, hi)))  # at most RANGES rows a term, and one a block
        weight = F.coalesce(*[F.when(F.col("term") == t, F.lit(n)) for t, n in times.items()])
        best = spread.groupBy("range", "term").agg(F.max("upper_bound").alias("b"))
        ranges = best.groupBy("range").agg(F.sum(F.col("b") * weight).alias("reach")).where(F.col("reach") >= threshold).select("range")
        kept = spread.join(F.broadcast(ranges.withColumn("in", F.lit(True))), "range", "left").groupBy("term", "block_no").agg(F.max(F.coalesce("in", F.lit(False))).alias("kept"))
        return ranges, kept

    def counters(self, query: Query | str, k: int = 10) -> DataFrame:
        """One row of what pruning spares for the best ``k``: candidates (postings of all clauses), scored and pruned
        (documents), blocks and blocks_skipped. Without pruning, everything is scored."""
        query = self._query(query)
        every = scored(self.index, {0: query}, self.bm25).agg(F.count("*").alias("n")).first()["n"]
        hits = blocks = None
        candidates = matches(self.index, {0: query}).where(F.col("occur") != Occur.MUST_NOT.value).count() if self.strategy(query) != "wand" else None
        if self.strategy(query) == "wand" and self.index.on_disk:
            _, hits, blocks, candidates = self._pruned(query, k)
        done = hits.count() if hits is not None else every
        counted = blocks.agg(F.count("*").alias("n"), F.count(F.when(~F.col("kept"), 1)).alias("skipped")).first() if blocks is not None else {"n": 0, "skipped": 0}
        row = (self.strategy(query), candidates if candidates is not None else every, done, every - done, counted["n"], counted["skipped"])
        return self.index.documents.sparkSession.createDataFrame([row], "strategy string, candidates long, scored long, pruned long, blocks long, blocks_skipped long")

    def batch_terms(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, rank, doc_id, score) of queries (query_id, text), each of all its text's words as optional
        terms. Queries are a table like any other: nothing of them comes to the driver."""
        n, total = self.index.collection()
        words = queries.select("query_id", F.explode(analyze_udf(self.index.analyzer)(F.coalesce("text", F.lit("")))).alias("t"))
        wanted = words.groupBy("query_id", F.col("t.term").alias("term")).agg(F.count("*").alias("times"))
        wanted = wanted.join(self.index.terms().select("term", "df"), "term")
        rows = wanted.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]
        found = self.index.postings.select("term", "doc_id", "tf", "length").join(wanted, "term")
        average = F.lit(total / n if n else 0.0)
        value = self.bm25.score_expr(F.col("tf"), F.col("length"), average, self.bm25.idf_expr(F.col("df"), F.lit(float(n)))) * F.col("times")
        # postings lie by term, so adding up before the shuffle would gain nothing and hold a frequent term's documents at once
        parts = max(self.index.documents.sparkSession.sparkContext.defaultParallelism, -(-rows // PART))
        spread = found.select("query_id", "doc_id", value.alias("value")).repartition(parts, "query_id", "doc_id")
        hits = spread.groupBy("query_id", "doc_id").agg(F.round(F.sum("value"), DIGITS).alias("score"))
        order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

    def batch(self, queries: dict[int, str], k: int = 10) -> DataFrame:
        """(query_id, rank, doc_id, score) of many queries in one plan; those without a term have no rows."""
        from tessera.plans.query import QueryError

        parsed = {}
        for q, text in queries.items():
            try:
                parsed[q] = parse(text, self.index.analyzer)
            except QueryError:
                continue
        hits = scored(self.index, parsed, self.bm25)
        order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

    def stats(self, query: Query | str) -> DataFrame:
        """One row: strategy, candidates, scored. Pruned plans count postings, the others documents
        before exclusion; which postings a plan skips is the engine's own affair."""
        query = self._query(query)
        strategy = self.strategy(query)
        found = matches(self.index, {0: query}).where(F.col("occur") != Occur.MUST_NOT.value)
        musts = sum(c.occur is Occur.MUST for c in query.clauses)
        hits = scored(self.index, {0: query}, self.bm25).agg(F.count("*").alias("scored"))
        if strategy == "wand":
            candidates = found.agg(F.count("*").alias("candidates"))
        else:
            by_doc = found.groupBy("doc_id").agg(F.count(F.when(F.col("occur") == Occur.MUST.value, 1)).alias("m"))
            candidates = by_doc.where(F.col("m") == musts).agg(F.count("*").alias("candidates"))
        # tables of one row
        return candidates.crossJoin(hits).select(F.lit(strategy).alias("strategy"), "candidates", "scored")

    def results(self, query: Query | str, k: int = 10, highlighter: Highlighter | None = None) -> DataFrame:
        """(doc_id, uri, title, score, snippet, matched): texts are read for the hits alone."""
        query = self._query(query)
        hits = self.search(query, k)
        shown = hits.join(self.index.documents.select("doc_id", "uri", "title", "text"), "doc_id")
        excerpt = snippet_udf(highlighter or Highlighter(), self.index.analyzer, set(query.positive_terms()))
        shown = shown.withColumn("s", excerpt("text"))
        out = shown.select("doc_id", "uri", "title", "score", F.col("s.text").alias("snippet"), F.col("s.matched").alias("matched"))
        return out.orderBy(F.desc("score"), F.asc("doc_id"))
