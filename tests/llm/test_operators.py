"""Each operator against a plain restatement of what it is to return, on small tables with every odd case."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, neardup, ngram, packing, passages, quality, secrets, toxicity, wavelet
from tessera.llm.eliasfano import EliasFano
from tessera.llm.graph import components
from tessera.llm.tokens import ChunkTokenizer
from tessera.llm.vocabularies import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def same(df, other):
    """As multisets of rows."""
    return sorted(map(repr, df.collect())) == sorted(map(repr, other.collect()))


def words(text):
    return WORD.findall(text or "")


# -- 1 ---------------------------------------------------------------------------
def measured(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    seen = defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs, clashing, rows, empty):
    got = Counter((r["doc_id"], *(r[m] for m in quality.MEASURES)) for r in quality.ledger(docs).collect())
    assert got == Counter((i, *measured(t)) for i, t, _ in rows)
    assert same(quality.ledger(docs), quality.ledger(clashing))
    assert quality.ledger(empty).count() == 0


def test_quality_policies(docs, clashing):
    rated = quality.ledger(docs)
    kept = rated.where(quality.passes(quality.FULL)).count()
    out = quality.accepted(clashing)
    assert out.columns == clashing.columns and out.count() == kept
    table = {r["rule"]: r for r in quality.ablation(rated, quality.FULL).collect()}
    n = rated.count()
    for i, rule in enumerate(quality.RULES):
        bit = 1 << i
        bits = [r["failed_bits"] for r in rated.collect()]
        assert table[rule.name]["n_failed"] == sum(b & bit != 0 for b in bits)
        assert table[rule.name]["n_failed_alone"] == sum(b == bit for b in bits)
        assert table[rule.name]["n_kept_without"] == sum(b & ~bit == 0 for b in bits) <= n


# -- 3, 8 ------------------------------------------------------------------------
@pytest.mark.parametrize("name, lead", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_encode_like_whole_texts(texts, name, lead):
    tok = ChunkTokenizer(vocabulary(name), lead)
    odd = ["", " ", "a ", "  a b", "a  b", "a \n b", "a\n\n b", "x \t y  z", "a \x85 b \x1c c", "don't we'll I'm", "12 34  5", "é ́a Σ ΑΣ b", "<|endoftext|> a <|endoftext|>b", "İ. İ", "ÀÉ,b", "a.\nB.\n\nC", "q" * 200]
    for t in [*odd, *texts]:
        assert list(np.frombuffer(tok.encode([t])[0], tok.width)) == tok.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def encoded(text, name, end):
    from tokenizers import Tokenizer

    encoded.cache = getattr(encoded, "cache", {})
    tok = encoded.cache.setdefault(name, Tokenizer.from_file(vocabulary(name)))
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(docs, clashing, rows, empty):
    got = packing.pack(docs, vocabulary("byte_bpe_50k.json"), shard_items=20).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = encoded(t, "byte_bpe_50k.json", 2)
        for k, (a, n) in enumerate(packing.cut_pieces(len(ids))):
            want[i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 1024) + 2
    assert packing.pack(clashing, vocabulary("byte_bpe_50k.json")).count() == len(got)
    assert packing.pack(empty, vocabulary("byte_bpe_50k.json")).count() == 0


def test_sum_of_squares_wastes_little():
    sizes = np.random.default_rng(2).integers(1, 1024, 5000)
    bins, offsets = packing.sum_of_squares(sizes)
    fill = np.bincount(bins, sizes)
    assert fill.max() <= 1024 and len(fill) < 1.03 * sizes.sum() / 1024
    assert sorted(zip(bins, offsets)) == sorted(set(zip(bins, offsets)))


def test_tokens_round_trip(docs, clashing, rows, empty):
    path = vocabulary("word_bpe_49k.json")
    got = [(r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.read(*wavelet.encode(docs, path, shard_bytes=9000)).collect()]
    at, want = 0, []
    for i, t in sorted(((i, t) for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encoded(t, "word_bpe_49k.json", 1)
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got) == want
    assert wavelet.read(*wavelet.encode(clashing, path)).count() == len(want)
    assert wavelet.read(*wavelet.encode(empty, path)).count() == 0


@pytest.mark.parametrize("n, top", [(0, 5), (1, 1), (511, 4), (512, 2), (3000, 300), (20000, 49408), (900, 1 << 18)])
def test_wavelet_matrix(tmp_path, n, top):
    rng = np.random.default_rng(n)
    x = rng.integers(0, top, n).astype(np.uint16 if top <= 1 << 16 else np.uint32)
    path = str(tmp_path / "x")
    wavelet.write(path, x, np.array([4]), np.array([True]), np.array([0, n]))
    m = wavelet.WaveletMatrix(path)
    assert (m.decode() == x).all()
    if n:
        at = rng.integers(0, n, 40)
        assert (m.access(at) == x[at]).all()
    for v in x[:4].tolist():
        lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
        assert m.count(v, lo, hi) == (x[lo:hi] == v).sum()
        assert (m.locate(v, lo, hi) == lo + np.nonzero(x[lo:hi] == v)[0]).all()
    assert m.count(1 << 20) == 0


# -- 4 ---------------------------------------------------------------------------
def shingled(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, clashing, rows, empty):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingled(t) for _, t, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or both and both >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        groups[find(i)].append(d)
    want = Counter((d, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g)
    got = neardup.classes(docs)
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got.collect()) == want
    out = neardup.deduplicate(clashing)
    assert out.columns == clashing.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(min((x for x in g if x is not None), default=None) for g in groups.values())
    assert neardup.classes(empty).count() == 0


def test_spanning_forest_and_runs():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 60, 90), rng.integers(0, 60, 90)
    tree = neardup._forest_edges(a, b, rng.integers(0, 9, 90), 60)

    def parts(edges):
        root = list(range(60))
        for x, y in edges:
            x, y = root[x], root[y]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    assert parts(zip(a[tree], b[tree])) == parts(zip(a, b))
    assert len(tree) == 60 - len(set(parts(zip(a, b))))
    s = np.repeat(rng.integers(0, 1 << 60, (3, 2)).astype(np.uint64), 3000, axis=0)  # a node beyond a block
    x, y = neardup.near_pairs(s, np.array([0]))
    assert len(set(parts_of(x, y, 9000))) == 3


def parts_of(x, y, n):
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = new[new]
        if (new == root).all():
            return root.tolist()
        root = new


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 200), (102, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 5 ---------------------------------------------------------------------------
def test_mixing(docs, clashing, rows, empty):
    got = mixing.plan(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: weight[s] * level for s in free}
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert all(0 <= p["position"] <= 1 for p in r["passes"])
        taken[r["source"]] += r["taken"]
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, _ in rows)
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert same(mixing.plan(docs), mixing.plan(docs))
    out = mixing.mix(clashing)
    assert out.columns == clashing.columns
    assert sum(len(words(r["text"])) for r in out.collect()) == sum(taken.values())
    assert mixing.plan(empty).count() == 0 == mixing.mix(empty).count()


def test_schedules_integrate_and_invert(spark):
    knots = ((0.0, 0.5), (0.25, 2.0), (1.0, 1.0))
    df = spark.range(101).select((F.col("id") / 100.0).alias("u"), F.lit(0).alias("p"))
    times = [r[0] for r in df.select(mixing.due(F.col("u"), F.col("p"), (knots,))).collect()]
    t = np.linspace(0, 1, 200001)
    area = np.cumsum(np.interp(t, *zip(*knots)))
    for u, got in zip(np.arange(101) / 100, times):
        assert abs(np.interp(got, t, area / area[-1]) - u) < 1e-4


# -- 6 ---------------------------------------------------------------------------
def test_toxicity(spark, docs, clashing, empty):
    import random

    rng = random.Random(5)
    vocabulary_ = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        w = rng.choices(vocabulary_, k=rng.randint(5, 60))
        bad = i % 5 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["wretchhead", "scumbaggo", "idiotface"]) if i % 2 else rng.choice(["wretchhaed", "scumbagggo", "xidiotface"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    few = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, labels[0], (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(few, marks, learn=F.col("doc_id") % 4 != 0, sample=300)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(few, model).collect()}
    held = [i for i in range(900) if i % 4 == 0]
    assert sum((got[i] >= 0.5) == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    scored = toxicity.score(docs, model)
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert same(scored, toxicity.score(clashing, model))
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(few, marks.where("false"), learn=F.lit(True))
    assert {r["score"] for r in toxicity.score(few, none).collect()} == {0.5}


def test_ngrams_are_characters():
    b, owner, first = toxicity.ngrams(pa.array(["Äbc", None, "", "x  Äbc"]))
    assert first.tolist() == [0, 1, 1, 1, 3]
    assert sorted(b[owner == 0]) == sorted(b[owner == 2])  # " äb äbc bc_ ..." alike wherever the word stands


# -- 7 ---------------------------------------------------------------------------
@pytest.mark.parametrize("n, top", [(1, 1), (1, 10**12), (5, 3), (1000, 100), (1000, 10**9), (20000, 10**7)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    x = np.sort(rng.integers(0, top, n))
    e = EliasFano.of(x)
    assert (e.access(np.arange(n)).astype(np.int64) == x).all()
    asked = np.concatenate([rng.integers(0, top + 2, 300), x[:300], [0, top, 2 * top + 5]])
    assert (e.find(asked) == np.searchsorted(x, asked)).all()


@pytest.mark.parametrize("held", [4_000_000, 500])
def test_language_model(docs, clashing, rows, empty, held, monkeypatch):
    monkeypatch.setattr(ngram, "HELD", held)
    monkeypatch.setattr(ngram, "SHARD", held)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    learn = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    texts = [(i, [*words((t or "").translate(low)), None]) for i, t, _ in rows]
    training = [t for i, t in texts if i is None or i % 3]
    count = Counter(w for t in training for w in t)
    pairs = Counter(p for t in training for p in zip([None, *t], t))
    triples = Counter((h, *p) for t in training for h, p in zip([None, *t], zip(t, t[1:])))
    n, v, mu, nu = sum(count.values()), len(count), ngram.MU, ngram.NU
    ones, twos = (sum(c == k for c in count.values()) for k in (1, 2))
    d = min(0.95, max(0.1, ones / (ones + 2 * twos)))
    alone = lambda w: (count[w] - d) / n if count[w] else d * v / n
    assert math.isclose(sum(map(alone, count)) + d * v / n, 1)
    want = defaultdict(list)
    for i, t in texts:
        two = [(pairs[h, w] + mu * alone(w)) / (count[h] + mu) if count[h] else alone(w) for h, w in zip([None, *t], t)]
        before = [0, *(pairs[p] for p in zip([None, *t], t))]
        log = sum(math.log10((triples[g] + nu * p) / (c + nu) if c else p) for g, p, c in zip(zip([None, None, *t], [None, *t], t), two, before))
        want[i].append((len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), log))
    model = ngram.fit(docs, learn)
    got = defaultdict(list)
    for r in ngram.score(docs, model).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    assert got.keys() == want.keys()
    for i in want:
        for a, b in zip(sorted(got[i]), sorted(want[i])):
            assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 and abs(a[4] - b[4]) < 0.02 * b[0], i
    assert same(ngram.score(docs, model), ngram.score(clashing, model))
    assert ngram.score(empty, model).count() == 0
    nothing = ngram.score(docs, ngram.fit(empty, F.lit(True)))
    assert {r["n_known"] for r in nothing.collect()} == {0}


# -- 9 ---------------------------------------------------------------------------
@pytest.mark.parametrize("hot", [passages.HOT, 3])
def test_passages(docs, clashing, rows, empty, hot):
    seen, want = defaultdict(set), set()
    for k, (i, t, _) in enumerate(rows):
        w = words(t)
        for a in range(len(w) - 49):
            seen[tuple(w[a : a + 50])].add(i if i is not None else ("row", t))
    for i, t, _ in rows:
        w, span = words(t), None
        for a in [a for a in range(len(w) - 49) if len(seen[tuple(w[a : a + 50])]) > 1]:
            if span and a <= span[1]:
                span[1] = a + 50
            else:
                want |= {(i, *span)} if span else set()
                span = [a, a + 50]
        want |= {(i, *span)} if span else set()
    assert len(want) > 5
    got = passages.spans(docs, hot=hot)
    assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(want)
    assert same(got, passages.spans(clashing, hot=hot))
    assert passages.spans(empty).count() == 0


# -- 10 --------------------------------------------------------------------------
def plain_secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    for k, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out)


CASES = ["password=token:abcdefg", "PASSWD = 'hunter22'", "api_key:\"x.y/z+1=\"", "apikey=abcde", "ſecret=abcdefgh toKen=abcdefgh", "AKIAAKIA" + "Z" * 16, "AKIA" + "z" * 30, "f" * 23 + "g" + "a" * 24, "é" * 5 + " secret:  abc_def-1", "token = = abcdefgh"]


def test_secrets(spark, docs, clashing, rows, empty):
    for t in [*CASES, *(t for _, t, _ in rows)]:
        base, every = secrets.find(t)
        assert base == plain_secrets(t) and set(base) <= set(every)
    want = Counter()
    for i, t, _ in rows:
        base = plain_secrets(t)
        want[i, *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(secrets.render(base).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:5] for r in secrets.scan(docs).collect()) == want
    assert same(secrets.scan(docs), secrets.scan(clashing))
    out = secrets.redact(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    assert not any(plain_secrets(r["text"]) for r in out.collect())
    assert secrets.redact(empty).count() == 0


def test_guess_cost():
    cost = secrets.guess_cost
    assert cost("password123") < 4 and cost("qwertyuiop") < 4 and cost("aaaaaaaaaaaa") < 4 and cost("2024-01-31") < 7
    assert cost("zK8Qp2Lm9RtY") > 15 and cost("x" + "9#kL2$mQ8!v") > 15
    found = lambda t: [t[a:b] for a, k, b in secrets.find(t)[1] if k == 3]
    assert found("the pwd: zK8Qp2Lm9RtY!, then") == ["zK8Qp2Lm9RtY!"]
    assert found("passphrase is correct Bearer: password123 and auth=qwertyuiop") == []
    assert found("my password is Wednesday") == []
