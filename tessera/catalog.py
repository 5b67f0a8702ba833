"""Queries over the test tables, one for each operator, and their SQL."""

from __future__ import annotations

import json
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import oracle as O
from tessera import render
from tessera.engine import Engine
from tessera.functions import analysis
from tessera.functions.analysis import Analyzer
from tessera.functions.ranking import Bm25
from tessera.operators.index import Index, build
from tessera.operators.seek import seek
from tessera.plans.planner import Searcher, phrase_by_join
from tessera.sources import crawl, store
from tessera.sources.files import Files, shared_folder
from tessera.streaming.service import SearchService

FLAGSHIP = "attion anea eriner"
MUST, MUST_SHOULD, MUST_NOT, DUPLICATE = "+anea +eriner", "+anea eriner attion", "anea -eriner", "anea anea"
PHRASE, PHRASE_NOT, GAP = '"to thanedble"', 'anea -"anea eriner"', '"under the Apache"'
RAW = Analyzer.raw()
_indexes: dict[tuple[str, str, bool], Index] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return t.select("doc_id", F.col("source").alias("uri"), crawl.title_of(F.col("source"), F.coalesce("text", F.lit(""))).alias("title"), "text")


def index_of(spark: SparkSession, sf_dir: str, plain: bool = False) -> Index:
    """The saved index of the documents, made once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, plain)
    if key not in _indexes:
        docs, cores = documents(spark, sf_dir), spark.sparkContext.defaultParallelism
        if docs.rdd.getNumPartitions() < cores:
            docs = docs.repartition(cores, "doc_id")
        _indexes[key] = store.save(build(docs, RAW if plain else Analyzer()), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    return _indexes[key]


def _search(query: str, k: int = 10, plain: bool = False, bm25: Bm25 = Bm25()):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Searcher(index_of(spark, sf_dir, plain), bm25).search(query, k)

    return run


def tokenize_raw(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = docs.select("doc_id", F.posexplode(analysis.normalize_udf()(analysis.words(F.col("text")))).alias("pos", "term"))
    return tokens.select("doc_id", F.col("pos").cast("long").alias("pos"), "term")


def normalize_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    distinct = docs.select(F.explode(analysis.words(F.col("text"))).alias("word")).distinct()
    return distinct.select("word", analysis.normalize_word_udf()("word").alias("normal"))


def stem_vocabulary(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # lists go through Python whole: over normalize_words, Spark drops the inner distinct and sends every word by itself
    normal = analysis.normalize_udf()(F.array_distinct(analysis.words(F.col("text"))))
    words = docs.select(F.explode(normal).alias("normal")).distinct()
    return words.select("normal", analysis.stem_all(F.array("normal"))[0].alias("stem"))


def stopword_filter_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = docs.select("doc_id", analysis.words(F.col("text")).alias("raw"))
    both = raw.withColumn("normal", analysis.normalize_udf()("raw"))
    kept = F.size(analysis.keep_words(F.col("normal"), Analyzer()))
    return both.select("doc_id", F.size("raw").cast("long").alias("n_words"), kept.cast("long").alias("n_kept"))


def postings_build(spark, sf_dir):
    return index_of(spark, sf_dir).postings.select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions"))


def term_doc_freq(spark, sf_dir):
    return index_of(spark, sf_dir).terms().select("term", "df")


def doc_lengths(spark, sf_dir):
    return index_of(spark, sf_dir).documents.select("doc_id", F.col("length").cast("long").alias("length"))


def collection_stats(spark, sf_dir):
    return index_of(spark, sf_dir).stats().withColumn("avg_doc_len", F.round("avg_doc_len", 6))


def _wide(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def term_bounds(spark, sf_dir):
    return _wide(index_of(spark, sf_dir).terms())


def block_metadata(spark, sf_dir):
    return _wide(index_of(spark, sf_dir).blocks())


def posting_gaps(spark, sf_dir):
    return index_of(spark, sf_dir).gaps().select("term", "doc_id", F.col("block_no").cast("long").alias("block_no"), F.col("gap").cast("long").alias("gap"))


def postings_bytes(spark, sf_dir):
    return index_of(spark, sf_dir).postings_bytes()


def upper_bounds_dominate(spark, sf_dir):
    """Each term's best score and its bound; the first never exceeds the second."""
    index, bm25 = index_of(spark, sf_dir), Bm25()
    n, total = index.collection()
    # a posting's score is its term's idf times this; the best of a term is found before anything is joined
    weight = bm25.score_expr(F.col("tf"), F.col("length"), F.lit(total / n if n else 0.0), F.lit(1.0))
    weights = index.postings.groupBy("term").agg(F.max(weight).alias("weight"))
    rated = weights.join(index.bounds(bm25).select("term", "df", F.col("upper_bound").alias("bound")), "term")
    best = rated.withColumn("best", bm25.idf_expr(F.col("df"), F.lit(float(n))) * F.col("weight"))
    return best.select("term", F.round("best", 6).alias("best"), F.round("bound", 6).alias("bound"), (F.col("best") <= F.col("bound") + 1e-12).alias("dominated"))


def title_from_first_line(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "title")


def _phrase(spark, sf_dir, query, plain):
    from tessera.plans.planner import matches
    from tessera.plans.query import parse

    index = index_of(spark, sf_dir, plain)
    return matches(index, {0: parse(query, index.analyzer)}).select("doc_id", F.col("tf").cast("long").alias("tf"))


def phrase_two_terms(spark, sf_dir):
    return _phrase(spark, sf_dir, PHRASE, True)


def phrase_two_terms_by_join(spark, sf_dir):
    return phrase_by_join(index_of(spark, sf_dir, True), (("to", 0), ("thanedble", 1)))


def phrase_with_stopword_gap(spark, sf_dir):
    return _phrase(spark, sf_dir, GAP, False)


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame, int]:
    docs = documents(spark, sf_dir)
    last = docs.agg(F.max("doc_id").alias("m")).first()["m"]
    cut = (last + 1) // 2 if last is not None else 0
    return docs.where(F.col("doc_id") < cut), docs.where(F.col("doc_id") >= cut).withColumn("doc_id", F.col("doc_id") - cut), cut


def shard_merge(spark, sf_dir):
    first, second, _ = _halves(spark, sf_dir)
    merged = build(first).merge(build(second))
    return merged.documents.select("doc_id", F.col("length").cast("long").alias("length"))


def append_and_reseal(spark, sf_dir):
    first, second, _ = _halves(spark, sf_dir)
    with build(first).edit() as session:
        session.add(second)
    return Searcher(session.index, pruning=False).search(FLAGSHIP)


def batch_topk(spark, sf_dir):
    """The benchmark's items as queries, all their words as optional terms."""
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    hits = Searcher(index_of(spark, sf_dir)).batch_terms(asked, 5)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def seek_postings(spark, sf_dir):
    """From every document id, where the three terms' lists go on."""
    index = index_of(spark, sf_dir)
    terms = F.explode(F.array(*[F.lit(index.analyzer.term(w)) for w in FLAGSHIP.split()]))
    moves = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("target"), terms.alias("term"))
    return _wide(seek(index, moves))


def search_stats_row(spark, sf_dir):
    return Searcher(index_of(spark, sf_dir)).stats(FLAGSHIP)


def search_stats_required(spark, sf_dir):
    return Searcher(index_of(spark, sf_dir)).stats(MUST)


def snippet_topk(spark, sf_dir):
    return Searcher(index_of(spark, sf_dir)).results(FLAGSHIP, 10)


def pruned_equals_exhaustive(spark, sf_dir):
    """The hits of both plans side by side."""
    s = Searcher(index_of(spark, sf_dir))
    a = s.pruned(FLAGSHIP, 10).withColumnRenamed("score", "pruned")
    b = s.exhaustive(FLAGSHIP, 10).withColumnRenamed("score", "exhaustive")
    return a.join(b, "doc_id", "full").select("doc_id", "pruned", "exhaustive")


def results_json(spark, sf_dir):
    s = Searcher(index_of(spark, sf_dir))
    rows = s.results(FLAGSHIP, 10).collect()
    body = json.loads(render.results_json(FLAGSHIP, rows, s.stats(FLAGSHIP).first()))
    return spark.createDataFrame([(body["query"], body["count"], json.dumps(body["results"]))], "query string, count long, results string")


TREE = {"rust.md": "# Rust\n\nRust has no collector.", "nested/go.txt": "Go has goroutines and a collector.", "photo.png": "x", ".git/HEAD.txt": "ref", "a/b.md": "first", "a-b.md": "second", "void.txt": ""}


def _tree(spark: SparkSession) -> str:
    """A small tree, written to the shared folder."""
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    files = Files(spark, root)
    for name, text in TREE.items():
        files.write(f"{root}/{name}", text)
    return root


def crawl_directory(spark, sf_dir):
    root = _tree(spark)
    return crawl.read_tree(spark, root).select("doc_id", F.replace("uri", F.lit(urlparse(root).path + "/"), F.lit("")).alias("uri"), "title")


def generation_swap(spark, sf_dir):
    """Hits of the generation that was served first, after another was published."""
    root = _tree(spark)
    service = SearchService(spark, f"{shared_folder(spark)}/service-{uuid.uuid4().hex}")
    service.reindex(root)
    held = service.snapshot()
    engine = Engine(spark)
    engine.add_document("other", "Other", "A collector of stamps")
    service.publish(engine)
    new, number = service.search("collector")
    return held.engine.search("collector").select(F.lit(held.number).alias("generation"), "title", "score").unionByName(new.select(F.lit(number).alias("generation"), "title", "score"))


def pages_search(spark, sf_dir):
    """The second corpus: page addresses as uris, raw HTML as text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("url").alias("uri"), F.col("html").alias("text"))
    return Searcher(build(pages), pruning=False).search("anea eriner attion")


QUERIES = {
    "bm25_should_topk": _search(FLAGSHIP), "bm25_single_term": _search("anea"), "bm25_must_intersection": _search(MUST), "bm25_must_plus_should": _search(MUST_SHOULD),
    "bm25_must_not": _search(MUST_NOT), "bm25_duplicate_clause": _search(DUPLICATE), "bm25_tuned_k1_b": _search(FLAGSHIP, bm25=Bm25(2.0, 0.3)), "bm25_phrase_idf": _search('"anea eriner" attion', plain=True),
    "phrase_excluded": _search(PHRASE_NOT),
} | {
    f.__name__: f
    for f in (
        tokenize_raw, normalize_words, stem_vocabulary, stopword_filter_counts, postings_build, term_doc_freq, doc_lengths, collection_stats, term_bounds, block_metadata, posting_gaps,
        postings_bytes, upper_bounds_dominate, title_from_first_line, phrase_two_terms, phrase_two_terms_by_join, phrase_with_stopword_gap, shard_merge, append_and_reseal, batch_topk, seek_postings,
        search_stats_row, search_stats_required, snippet_topk, pruned_equals_exhaustive, results_json, crawl_directory, generation_swap, pages_search,
    )
}


def _term(word: str) -> list[tuple[str, int]]:
    return [(Analyzer().term(word), 0)]


_THREE = [("", _term(w)) for w in FLAGSHIP.split()]
_PHRASE_SQL = f"WITH {O.tokens(True)}, {O.clause(0, [('to', 0), ('thanedble', 1)])} SELECT doc_id, tf FROM c0"
_LINES = "list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(regexp_replace(trim(x, chr(32) || chr(9)), '^#+', ''), chr(32) || chr(9))), lambda x: x <> '')"


def _oracles() -> dict[str, str]:
    index, post = O.index(), "WITH " + O.index()
    terms, num = f"{post}, {O.TERMS}", f"{post}, {O.NUMBERED}"
    gaps = f"{num}, {O.GAPS}"
    positions = f"pos AS (SELECT term, doc_id, sum({O.vlen('g')}) AS bytes FROM (SELECT term, doc_id, pos - coalesce(lag(pos) OVER (PARTITION BY term, doc_id ORDER BY pos), 0) AS g FROM tok) GROUP BY 1, 2)"
    total = f"(SELECT coalesce(sum({O.vlen('gap')} + {O.vlen('tf')} + bytes), 0)::BIGINT FROM gap JOIN pos USING (term, doc_id))"
    value = O.bm25("tf", "length", "df")
    batch_terms = f"""
      qw AS (SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (SELECT item_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS ws FROM benchmark)),
      qn AS (SELECT item_id, pos, lower(strip_accents(w)) AS n FROM qw),
      qk AS (SELECT * FROM qn WHERE length(n) >= 2 AND n NOT IN ({", ".join(f"'{w}'" for w in sorted(analysis.STOPWORDS))})),
      q1 AS (SELECT item_id, pos, {O._strip("n")} AS s FROM qk), q2 AS (SELECT item_id, pos, {O._strip("s")} AS term FROM q1)"""
    tree = {p: t for p, t in TREE.items() if p.endswith((".md", ".txt")) and not p.startswith(".")}
    tree_sql = ", ".join(f"('{p}', '{t}')" for p, t in tree.items())
    files = f"f(uri, text) AS (VALUES {tree_sql}), l AS (SELECT uri, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(trim(x), '^#+', ''))), lambda x: x <> '') AS lines FROM f)"
    other = "(SELECT 'other' AS uri, 'A collector of stamps' AS text)"
    return {
        "crawl_directory": f"WITH {files} SELECT row_number() OVER (ORDER BY string_split(uri, '/')) - 1 AS doc_id, uri, coalesce(left(lines[1], 80), regexp_replace(regexp_extract(uri, '[^/]*$'), '\\.[^.]*$', '')) AS title FROM l",
        "generation_swap": f"WITH {files} SELECT 1 AS generation, coalesce(left(lines[1], 80), uri) AS title, score FROM ({O.top([('', _term('collector'))], source=f'(SELECT uri, text FROM (VALUES {tree_sql}) AS v(uri, text))', key='uri')}) h JOIN l ON l.uri = h.doc_id UNION ALL SELECT 2, 'Other', score FROM ({O.top([('', _term('collector'))], source=other, key='uri')})",
        "pruned_equals_exhaustive": f"SELECT doc_id, score AS pruned, score AS exhaustive FROM ({O.top(_THREE)})",
        "bm25_should_topk": O.top(_THREE), "bm25_single_term": O.top([("", _term("anea"))]),
        "bm25_must_intersection": O.top([("+", _term("anea")), ("+", _term("eriner"))]),
        "bm25_must_plus_should": O.top([("+", _term("anea")), ("", _term("eriner")), ("", _term("attion"))]),
        "bm25_must_not": O.top([("", _term("anea")), ("-", _term("eriner"))]),
        "bm25_duplicate_clause": O.top([("", _term("anea")), ("", _term("anea"))]),
        "bm25_tuned_k1_b": O.top(_THREE, k1=2.0, b=0.3),
        "bm25_phrase_idf": O.top([("", [("anea", 0), ("eriner", 1)]), ("", [("attion", 0)])], plain=True),
        "phrase_excluded": O.top([("", _term("anea")), ("-", [(_term("anea")[0][0], 0), (_term("eriner")[0][0], 1)])]),
        "tokenize_raw": f"WITH {O.tokens(True)} SELECT doc_id, pos, term FROM tok",
        "normalize_words": f"WITH {O.words()} SELECT DISTINCT w AS word, n AS normal FROM norm",
        "stem_vocabulary": f"WITH {O.words()}, v AS (SELECT DISTINCT n FROM norm), o AS (SELECT n, {O._strip('n')} AS s FROM v) SELECT n AS normal, {O._strip('s')} AS stem FROM o",
        "stopword_filter_counts": f"WITH {O.tokens()}, k AS (SELECT doc_id, count(*) AS c FROM kept GROUP BY 1) SELECT ws.doc_id, len(ws.ws)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_kept FROM ws LEFT JOIN k USING (doc_id)",
        "postings_build": f"WITH {O.tokens()} SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM tok GROUP BY 1, 2",
        "term_doc_freq": f"{terms} SELECT term, df FROM terms",
        "doc_lengths": f"WITH {index} SELECT doc_id, length FROM len",
        "collection_stats": f"{gaps}, {O.TERMS}, {positions} SELECT n AS documents, (SELECT count(*) FROM terms) AS vocabulary, (SELECT count(*) FROM post) AS postings, round(total::DOUBLE / n, 6) AS avg_doc_len, {total} AS postings_bytes FROM coll",
        "term_bounds": f"{terms} SELECT term, df, max_tf, min_len FROM terms",
        "block_metadata": f"{num} SELECT term, block_no, max(doc_id) AS last_doc, count(*) AS count, max(tf) AS max_tf, min(length) AS min_len FROM num GROUP BY 1, 2",
        "posting_gaps": f"{gaps} SELECT term, doc_id, block_no, gap FROM gap",
        "postings_bytes": f"{gaps}, {positions} SELECT {total} AS postings_bytes",
        "upper_bounds_dominate": f"{terms} SELECT term, round(max({value}), 6) AS best, round(any_value({O.bm25('max_tf', 'min_len', 'df')}), 6) AS bound, true AS dominated FROM post JOIN terms USING (term), coll GROUP BY 1",
        "title_from_first_line": f"SELECT doc_id, coalesce(left(({_LINES})[1], 80), source) AS title FROM documents",
        "phrase_two_terms": _PHRASE_SQL, "phrase_two_terms_by_join": _PHRASE_SQL,
        "phrase_with_stopword_gap": f"WITH {O.tokens()}, {O.clause(0, [(_term('under')[0][0], 0), (_term('Apache')[0][0], 2)])} SELECT doc_id, tf FROM c0",
        "shard_merge": f"WITH {index} SELECT doc_id, length FROM len",
        "append_and_reseal": O.top(_THREE),
        "batch_topk": f"WITH {index}, {O.TERMS}, {batch_terms}, s AS (SELECT item_id AS query_id, doc_id, round(sum({value}), 6) AS score FROM q2 JOIN post USING (term) JOIN terms USING (term), coll GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 5",
        "seek_postings": f"{num}, m AS (SELECT DISTINCT doc_id AS target, unnest([{', '.join(repr(_term(w)[0][0]) for w in FLAGSHIP.split())}]) AS term FROM documents) SELECT term, target, min_by(block_no, num.doc_id) AS block_no, min(num.doc_id) AS doc_id, min_by(tf, num.doc_id) AS tf, count(*) AS remaining FROM m JOIN num USING (term) WHERE num.doc_id >= target GROUP BY 1, 2",
        "search_stats_row": f"WITH {O.scores(_THREE)} SELECT 'wand' AS strategy, (SELECT count(*) FROM c0) + (SELECT count(*) FROM c1) + (SELECT count(*) FROM c2) AS candidates, (SELECT count(*) FROM hits) AS scored",
        "search_stats_required": f"WITH {O.scores([('+', _term('anea')), ('+', _term('eriner'))])} SELECT 'exhaustive' AS strategy, (SELECT count(*) FROM hits) AS candidates, (SELECT count(*) FROM hits) AS scored",
        "pages_search": O.top(_THREE, source="(SELECT page_id, html AS text FROM pages)", key="page_id"),
    }


ORACLES = _oracles()
