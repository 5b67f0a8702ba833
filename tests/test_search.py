import random
from collections import Counter

import pytest

from tessera.functions.analysis import Analyzer
from tessera.functions.ranking import Bm25
from tessera.operators.index import build
from tessera.operators.seek import seek, step
from tessera.plans.planner import Searcher, phrase_by_join
from tessera.plans.query import Occur, QueryError, parse
from tessera.sources import store

RAW = Analyzer.raw()


def test_grammar():
    kinds = lambda q, a=RAW: [(c.occur, c.terms) for c in parse(q, a).clauses]
    assert kinds("+red -blue green") == [(Occur.MUST, (("red", 0),)), (Occur.MUST_NOT, (("blue", 0),)), (Occur.SHOULD, (("green", 0),))]
    assert kinds('"a big fish"') == [(Occur.SHOULD, (("a", 0), ("big", 1), ("fish", 2)))]
    assert kinds('"song of sirens"', Analyzer()) == [(Occur.SHOULD, (("song", 0), ("sirem", 2)))]  # the rule ns>m also takes English words
    assert kinds('"red"') == [(Occur.SHOULD, (("red", 0),))]
    assert kinds("red-blue --x +-y + z") == [(Occur.SHOULD, (("red", 0),)), (Occur.MUST_NOT, (("x", 0),)), (Occur.MUST, (("y", 0),)), (Occur.SHOULD, (("z", 0),))]
    assert kinds('foo"bar baz"') == [(Occur.SHOULD, (("foo", 0),)), (Occur.SHOULD, (("baz", 0),))]
    assert kinds('"a b"c') == [(Occur.SHOULD, (("a", 0), ("b", 1))), (Occur.SHOULD, (("c", 0),))]
    assert kinds("+the red", Analyzer()) == [(Occur.SHOULD, (("red", 0),))]
    assert parse('+red "big fish" -blue', RAW).positive_terms() == ["red", "big", "fish"]


@pytest.mark.parametrize("text, analyzer", [('"open', RAW), ("the of", Analyzer()), ("-a -b", RAW), ("-java the", Analyzer()), ("", RAW)])
def test_bad_queries(text, analyzer):
    with pytest.raises(QueryError):
        parse(text, analyzer)


WORDS = ["ant", "bee", "cat", "dog", "elk", "fox"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = {i: " ".join(rng.choices(WORDS, [9, 5, 4, 3, 2, 1], k=rng.randint(1, 14))) for i in range(300)}
    return out | {300: "", 301: None, 302: out[0], 303: out[0]}


@pytest.fixture(scope="module")
def index(spark, texts):
    return build(spark.createDataFrame([(i, f"u{i}", f"T{i}", t, 7) for i, t in texts.items()], "doc_id long, uri string, title string, text string, length int"), RAW).cached()


@pytest.fixture(scope="module")
def saved(index, tmp_path_factory):
    return store.save(index, "file://" + str(tmp_path_factory.mktemp("index") / "i"))


def brute(texts, query, k, bm25=Bm25()):
    words = {i: (t or "").split() for i, t in texts.items()}
    n, average = len(words), sum(map(len, words.values())) / len(words)
    score, musts, nots = Counter(), [], set()
    for c in parse(query, RAW).clauses:
        tf = {i: sum(all(p + o < len(w) and w[p + o] == t for t, o in c.terms) for p in range(len(w))) for i, w in words.items()}
        hit = {i for i, x in tf.items() if x}
        if c.occur is Occur.MUST_NOT:
            nots |= hit
            continue
        if c.occur is Occur.MUST:
            musts.append(hit)
        for i in hit:
            score[i] += bm25.score(tf[i], len(words[i]), average, bm25.idf(len(hit), n))
    rows = [(i, round(s, 6)) for i, s in score.items() if i not in nots and all(i in m for m in musts)]
    return sorted(rows, key=lambda r: (-r[1], r[0]))[:k]


QUERIES = ["ant", "elk fox", "+elk +fox", "cat -ant", '"bee cat"', "+dog elk", '-"ant ant" bee', "fox fox", '"cat dog elk" fox', "+zebra ant", "zebra"]


def rows(df):
    return [(r["doc_id"], r["score"]) for r in df.collect()]


@pytest.mark.parametrize("query", QUERIES)
def test_search_is_brute_force(index, texts, query):
    got = rows(Searcher(index).search(query, 12))
    want = brute(texts, query, 12)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got, want))


@pytest.mark.parametrize("query", ["ant", "elk fox", "fox fox ant", "ant bee cat dog elk fox", "zebra fox"])
@pytest.mark.parametrize("k", [1, 7])
def test_pruned_is_exhaustive(saved, query, k):
    s = Searcher(saved)
    assert s.strategy(query) == "wand"
    assert rows(s.pruned(query, k)) == rows(s.exhaustive(query, k)) == rows(s.search(query, k))


def test_tuned_parameters(saved, texts):
    for bm25 in (Bm25(2.0, 0.3), Bm25(0.0, 0.0)):
        assert [i for i, _ in rows(Searcher(saved, bm25).search("elk fox", 9))] == [i for i, _ in brute(texts, "elk fox", 9, bm25)]


def test_limit_zero(index):
    assert rows(Searcher(index).search("ant", 0)) == []


def test_phrase_by_join_agrees(index):
    from tessera.plans.planner import matches

    a = {(r["doc_id"], r["tf"]) for r in matches(index, {0: parse('"bee cat"', RAW)}).collect()}
    assert a == {(r["doc_id"], r["tf"]) for r in phrase_by_join(index, (("bee", 0), ("cat", 1))).collect()}


def test_batch(index, texts):
    got = {}
    for r in Searcher(index).batch({1: "elk fox", 2: "+elk +fox", 3: "", 4: '"bee cat"'}, 4).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == {q: [i for i, _ in brute(texts, t, 4)] for q, t in ((1, "elk fox"), (2, "+elk +fox"), (4, '"bee cat"'))}


def test_statistics(index, saved, texts):
    lengths = [len((t or "").split()) for t in texts.values()]
    assert index.collection() == saved.collection() == (len(lengths), sum(lengths))
    a, b = index.stats().first(), saved.stats().first()
    assert a == b and a["vocabulary"] == len(WORDS)
    blocks = sorted((r["term"], r["block_no"], r["count"], r["last_doc"]) for r in saved.blocks().collect())
    docs = sorted(i for i, t in texts.items() if "ant" in (t or "").split())
    assert [(n, last) for t, _, n, last in blocks if t == "ant"] == [(len(docs[i : i + 128]), docs[i : i + 128][-1]) for i in range(0, len(docs), 128)]


def test_explain_counts(index, texts):
    s = Searcher(index).stats("+elk +fox").first()
    n = len(brute(texts, "+elk +fox", 10**6))
    assert (s["strategy"], s["candidates"], s["scored"]) == ("exhaustive", n, n)


def test_merge_and_edit(spark, index, texts):
    cut = 150
    part = lambda lo, hi: spark.createDataFrame([(i - lo, f"u{i}", f"T{i}", texts[i]) for i in range(lo, hi)], "doc_id long, uri string, title string, text string")
    with build(part(0, cut), RAW).edit() as session:
        session.add(part(cut, len(texts)))
    assert rows(Searcher(session.index).search("elk fox")) == rows(Searcher(index).search("elk fox"))


def test_saved_index_is_read_only(saved):
    with pytest.raises(PermissionError), saved.edit():
        pass
    with pytest.raises(PermissionError):
        store.save(saved, "file:///nowhere")


def test_empty_index(spark):
    empty = build(spark.createDataFrame([], "doc_id long, text string"), RAW)
    assert rows(Searcher(empty).search("ant")) == []
    assert empty.stats().first()["avg_doc_len"] == 0.0


def test_whole_blocks_are_skipped(spark, tmp_path):
    """Documents of the first tenth hold the terms six times: the blocks of the others can't reach the best."""
    texts = []
    for i in range(3000):
        many = 6 if i < 300 else 1
        texts.append((i, " ".join(f"term{t}" for t in range(4) if i % 2**t == 0 for _ in range(many)) + " " + " ".join(f"filler{j}" for j in range(i % 40))))
    s = Searcher(store.save(build(spark.createDataFrame(texts, "doc_id long, text string"), RAW), f"file://{tmp_path}/i"))
    for query, k in (("term0 term1", 5), ("term0 term1 term2", 3), ("term0 term0 term3", 10), ("term2", 4)):
        assert [tuple(r) for r in s.pruned(query, k).collect()] == [tuple(r) for r in s.exhaustive(query, k).collect()]
    got = s.counters("term0 term1", 5).first()
    assert got["candidates"] == 4500 and got["blocks"] == 24 + 12
    assert got["blocks_skipped"] > 18 and got["scored"] + got["pruned"] == 3000 and got["pruned"] > 2000
    plain = s.counters("+term0 +term1", 5).first()
    assert (plain["strategy"], plain["scored"], plain["pruned"], plain["blocks_skipped"]) == ("exhaustive", 1500, 0, 0)


def test_batch_of_a_table(spark, saved, texts):
    """Each query's words, repeated ones too, as optional terms."""
    asked = {1: "ant bee ant", 2: "cat", 3: "", 4: "zebra"}
    s = Searcher(saved)
    got = s.batch_terms(spark.createDataFrame([*asked.items(), (5, None)], "query_id long, text string"), 3).collect()
    for q, text in asked.items():
        want = [(r["doc_id"], r["score"]) for r in s.exhaustive(text, 3).collect()] if text and text != "zebra" else []
        assert [(r["doc_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_saved_statistics(saved):
    assert saved.sizes is not None
    fresh = build(saved.documents.select("doc_id", "text"), saved.analyzer)
    assert tuple(saved.stats().first()) == tuple(fresh.stats().first())


def test_moves_along_postings(spark, saved):
    """Every move ends where a walk along the list would, from any id on; those past the end have no row."""
    lists = {}
    for r in saved.postings.collect():
        lists.setdefault(r["term"], []).append((r["doc_id"], r["tf"]))
    moves = [(t, d) for t in (*lists, "nothing") for d in (-1, 0, 1, 7, 128, 129, 10**6)] + [(None, 1), ("ant", None)]
    got = {(r["term"], r["target"]): (r["doc_id"], r["tf"], r["remaining"]) for r in seek(saved, spark.createDataFrame(moves, "term string, target long")).collect()}
    want = {}
    for t, posts in lists.items():
        for d in (-1, 0, 1, 7, 128, 129, 10**6):
            if ahead := sorted(p for p in posts if p[0] >= d):
                want[t, d] = (*ahead[0], len(ahead))
    assert got == want
    first = sorted(lists["ant"])
    after = step(saved, spark.createDataFrame([("ant", first[0][0]), ("ant", first[-1][0])], "term string, doc_id long")).collect()
    assert [r["doc_id"] for r in after] == [first[1][0]]


def test_moves_are_merged_and_not_paired(spark, saved, monkeypatch):
    """Moves are not joined with what lies behind their targets, and many ranges of ids, empty ones too, give what a walk gives."""
    monkeypatch.setattr("tessera.operators.seek.RANGE", 8, raising=False)
    ids = sorted(r["doc_id"] for r in saved.term("fox").collect())
    targets = [*range(-20, 320), 10**6]
    moved = seek(saved, spark.createDataFrame([("fox", t) for t in targets], "term string, target long"))
    plan = moved._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and ">=" in line]
    got = {r["target"]: (r["doc_id"], r["remaining"], r["block_no"]) for r in moved.collect()}
    assert got == {t: (min(a), len(a), (len(ids) - len(a)) // 128) for t in targets if (a := [i for i in ids if i >= t])}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_postings_are_numbered_in_one_sort(spark, texts, monkeypatch, tmp_path):
    """Over many ranges of ids and several blocks, saved or not, numbers and gaps are those of a walk; nothing is joined for them."""
    monkeypatch.setattr("tessera.operators.index.RANGE", 8)
    rows = [(i, f"u{i}", t) for i, t in texts.items()]
    cut = 150
    halves = [build(spark.createDataFrame(part, "doc_id long, uri string, text string"), RAW) for part in (rows[:cut], [(i - cut, u, t) for i, u, t in rows[cut:]])]
    fresh = halves[0].merge(halves[1])
    assert "Join" not in _plan(fresh.block_table()) and "collect_list" not in _plan(fresh.block_table())
    kept = store.save(fresh, f"file://{tmp_path}/i")
    lists = {}
    for i, t in texts.items():
        for w in set((t or "").split()):
            lists.setdefault(w, []).append(i)
    want = sorted((w, d, n // 128, d if n % 128 == 0 else d - ids[n - 1]) for w, ids in lists.items() for n, d in enumerate(ids))
    assert sorted(map(tuple, fresh.gaps().collect())) == sorted(map(tuple, kept.gaps().collect())) == want
    assert sorted(map(tuple, fresh.block_table().collect())) == sorted(map(tuple, kept.block_table().collect()))
    assert fresh.stats().first() == kept.stats().first()
    assert sorted(r["doc_id"] for r in kept.documents.collect()) == sorted(texts)


def test_gaps_of_a_saved_index_are_read(saved):
    plan = _plan(saved.gaps())
    assert "Window" not in plan and "Join" not in plan


def test_a_batch_is_added_up_in_parts_of_a_size(spark, saved, monkeypatch):
    monkeypatch.setattr("tessera.plans.planner.PART", 10, raising=False)
    asked = spark.createDataFrame([(1, "ant fox"), (2, "bee")], "query_id long, text string")
    matches = sum(saved.term(t).count() for t in ("ant", "fox", "bee"))
    hits = Searcher(saved).batch_terms(asked, 400)
    assert f"RepartitionByExpression [query_id" in _plan(hits) and f", {-(-matches // 10)}" in _plan(hits)  # noqa: F541
    assert {(r["doc_id"], r["score"]) for r in hits.collect() if r["query_id"] == 1} == set(map(tuple, Searcher(saved).exhaustive("ant fox", 400).collect()))


def test_texts_of_an_unsaved_index_are_analysed_once(spark, texts):
    fresh = build(spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string"), RAW)
    hits = Searcher(fresh, pruning=False).search("elk fox")
    assert "MapInArrow" not in _plan(hits)
    assert [tuple(r) for r in hits.collect()] == brute(texts, "elk fox", 10)
