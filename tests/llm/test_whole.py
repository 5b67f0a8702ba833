"""Cases in which an operator once did less than its whole job."""

import gc
import pickle
import random
import re
import tracemalloc
import weakref
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import mixing, neardup, ngram, queries, secrets, textbytes, toxicity, wavelet
from tessera.llm.eliasfano import EliasFano
from tessera.llm.tokens import ChunkTokenizer
from tessera.llm.vocabularies import vocabulary


def shingled(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    a, b = shingled(a), shingled(b)
    return len(a & b) / len(a | b)


# -- 4, 7, 9 ---------------------------------------------------------------------
def test_words_hash_alike_in_parts_and_whole():
    """Of any length and wherever they stand; a word of megabytes takes memory for a part of it."""
    long = "xyz" * 50_000
    data, at = textbytes.spaced(pa.array([f"a {long} é", None, "", f"{long}\n{long}q a"]))
    h = textbytes.hashes(data, *textbytes.words(data, at)[:2])
    assert h[0] == h[5] and h[1] == h[3] and len({*h.tolist()}) == 4

    def plain(word):
        body = word.encode()
        return sum((b + 1) * pow(textbytes._P & textbytes.MASK, i, 1 << 64) for i, b in enumerate(body)) + len(body) & textbytes.MASK

    assert h.tolist() == textbytes.mix(np.array([plain(w) for w in ["a", long, "é", long, long + "q", "a"]], np.uint64)).tolist()
    assert len(textbytes._POWERS) <= 1 << 14


# -- 4 ---------------------------------------------------------------------------
def test_broken_trees_are_tried_again(spark):
    """SimHashes of 0 to 1 and 1 to 2 nearly agree, below 0.8; 0 and 2 are copies and farther apart."""
    base = [f"b{i}" for i in range(404)]

    def changed(*places):
        return " ".join(f"v2004x{(i - 10) // 21}" if (i - 10) % 21 == 0 and (i - 10) // 21 in places else w for i, w in enumerate(base))

    texts = [changed(0, 4, 5, 8, 9, 11, 14, 15, 17), changed(), changed(0, 1, 2, 4, 5, 9, 13, 15, 16)]
    assert jaccard(texts[0], texts[2]) >= 0.8 > max(jaccard(texts[0], texts[1]), jaccard(texts[1], texts[2]))
    got = neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {(r["doc_id"], r["class_id"]) for r in got.collect()} == {(0, 0), (1, 1), (2, 0)}


def test_nodes_beyond_a_block_are_compared_whole():
    """Every near pair of a family at full depth, in one node, is tried or stands between texts of one label."""
    rng = np.random.default_rng(4)
    n, depth, prefix, tries = 2500, 13, 9, 1
    perm = neardup.orders(tries)[0]
    bits = (rng.random((n, neardup.BITS)) < 0.1).astype(np.uint8)
    bits[:, perm[:depth]] = 0
    s = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    far = np.bitwise_count(s[:, None, :] ^ s[None, :, :]).sum(axis=2)
    want = {(i, j) for i, j in zip(*np.nonzero(far <= 15)) if i < j}  # far closer than pairs at 0.8 on average
    digest = pa.array([i.to_bytes(16, "big") for i in range(n)])
    sketches = pa.RecordBatch.from_arrays([digest, pa.array(s[:, 0].view(np.int64)), pa.array(s[:, 1].view(np.int64))], ["digest", "s0", "s1"])

    def planted(batch):
        return [pa.Table.from_batches(neardup._plant(tries, prefix)([batch])).sort_by([("node", "ascending"), ("key", "ascending")]).combine_chunks().to_batches()[0]]

    def places(out):
        return [tuple(sorted(int.from_bytes(x, "big") for x in p)) for t in out for p in zip(t["a"].to_pylist(), t["b"].to_pylist())]

    def tried(**how):
        first = places(neardup._climb(prefix, depth, **how)(planted(sketches)))
        parted = {i for i, j in first if i == j}
        rest = sketches.append_column("label", digest).filter(pa.array([i in parted for i in range(n)]))
        return {p for p in first if p[0] != p[1]} | set(places(neardup._across(prefix, depth)(planted(rest)))) if parted else set(first)

    assert want - tried() == set()
    sketches, want, n, digest = sketches.slice(0, 1500), {p for p in want if p[1] < 1500}, 1500, digest.slice(0, 1500)
    assert want - tried(buffer=600) == set()


def test_a_set_is_sent_once_to_a_group_of_candidates(spark, monkeypatch):
    """And no link is lost, whether a group is verified in one place or pair by pair."""
    rng = random.Random(8)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(9000)}" for _ in range(120)]
        for k in range(12):
            w = list(base)
            for j in rng.sample(range(120), k % 6):
                w[j] = f"x{rng.randrange(9000)}"
            texts.append(" ".join(w))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    body = neardup._rows(rows, "doc_id", "text").select("digest", "text")
    of = {bytes(r["digest"]): r["text"] for r in body.collect()}
    names = sorted(of)
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if shingled(of[a]) & shingled(of[b])], "a binary, b binary")
    want = {(a, b) for a, b in ((bytes(r[0]), bytes(r[1])) for r in pairs.collect()) if jaccard(of[a], of[b]) >= 0.8}
    sent = []
    run = neardup._verify
    monkeypatch.setattr(neardup, "_verify", lambda similarity: sent.append(1) or run(similarity))
    for together in (1024, 2):
        monkeypatch.setattr(neardup, "TOGETHER", together)
        assert {(bytes(r[0]), bytes(r[1])) for r in neardup.verified_pairs(body, pairs, 0.8).collect()} == want and want
        assert len(sent) == (together == 2)


def test_deduplicate_keeps_a_row_of_each_class(spark):
    """Unrelated texts under null ids and under one id, and copies of such a text under other ids."""
    texts = [" ".join(f"t{k}w{i}" for i in range(30)) for k in range(8)]
    rows = [(None, t) for t in texts[:4]] + [(7, texts[4]), (7, texts[5]), (7, texts[5]), (3, texts[5]), (9, texts[6]), (None, texts[6]), (None, texts[6]), (None, texts[7]), (None, texts[7])]
    out = neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, t) for t in texts[:4]] + [(7, texts[4]), (3, texts[5]), (9, texts[6]), (None, texts[7])]
    assert sorted(map(repr, (tuple(r) for r in out))) == sorted(map(repr, want))


# -- 8 ---------------------------------------------------------------------------
def test_token_files_take_the_entropy_and_answer_from_the_file(tmp_path):
    """Of ids as skewed as words: smaller than their entropy in 16-bit ids, and than those; counts by rank are those of the ids."""
    rng = np.random.default_rng(8)
    ids = np.minimum(rng.zipf(1.3, 200_000), 40_000).astype(np.uint16)
    path = str(tmp_path / "x")
    wavelet.write(path, ids, np.array([1, 2]), np.array([True, True]), np.array([0, 150_000, 200_000]))
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    entropy = -(share * np.log2(share)).sum() / 8 * len(ids)
    size = (tmp_path / "x").stat().st_size
    assert size < 1.12 * entropy + 9 * len(share) + 4096 and size < 0.8 * 2 * len(ids)
    m = wavelet.WaveletMatrix(path)
    for token in [*np.unique(ids)[:30].tolist(), int(ids.max())]:
        assert m.count(token, 1000, 150_000) == (ids[1000:150_000] == token).sum()
        assert (m.locate(token) == np.flatnonzero(ids == token)).all()
    assert (m.access(np.arange(0, 200_000, 37)) == ids[::37]).all() and (m.decode() == ids).all()


# -- 10 --------------------------------------------------------------------------
def guessed(text):
    return [text[a:b] for a, k, b in secrets.find(text)[1] if k == 3]


def test_values_are_taken_and_priced_whole():
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(600))
    assert guessed(f"Authorization: Bearer {long} end") == [long]
    late = "z" * 300 + long[:40]
    assert guessed(f"auth: {late} end") == [late]
    for same in ("z" * 20000, "xy" * 10000, "qwe" * 200):  # cheap however long, and not slow
        assert secrets.guess_cost(same) < 8 and guessed("auth: " + same) == []


def test_credential_names_are_parts_of_names():
    for text, value in (
        ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG+bPxRfiCY", "wJalrXUtnFEMI/K7MDENG+bPxRfiCY"), ("DB_PASSWORD='x#9$Qz!27&k'", "x#9$Qz!27&k"), ("db-pwd: zK8Qp2Lm9RtY", "zK8Qp2Lm9RtY"),
        ("dbPwd: zK8Qp2Lm9RtY", "zK8Qp2Lm9RtY"), ("auth: zK8éQp2Lm9RtYxx", "zK8éQp2Lm9RtYxx"),
    ):
        assert guessed(text) == [value]
    assert guessed("compwd: zK8Qp2Lm9RtY") == []


def test_values_that_a_pattern_cuts_are_masked_whole():
    for text, masked in (
        ("password=Summer2024!x#9Qz end", "[assign] end"), ("api_key: abcdef!9$kQz7 end", "[assign] end"), ("pwd=zzQ!" + "0af" * 9 + "!zQ9 end", "pwd=[guess] end"),
    ):
        assert secrets.mask(text, secrets.find(text)[1]) == masked
    assert guessed("password=abcdefQ9x7Zk4") == []  # the pattern has all of it


# -- 6, 7 ------------------------------------------------------------------------
def _written(spark, tmp_path, texts, labels=()):
    at = f"{tmp_path}/sf"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"file://{at}/labels.parquet")
    return f"file://{at}"


def test_held_out_labels_teach_nothing(spark, tmp_path):
    """A word that only held-out documents are toxic for isn't learnt; scores follow the folds of the contract."""
    rng = random.Random(6)
    out = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(400)]
    texts, labels = [], []
    for i in range(400):
        w = [f"plain{rng.randrange(50)}" for _ in range(20)]
        if bad := i % 4 == 0:
            w[3] = "heldoutword" if out[i] and i % 8 == 0 else "learntword"
        texts.append(" ".join(w))
        labels.append((i, None, int(bad)))
    got = {r["doc_id"]: r for r in queries.op6_toxicity(spark, _written(spark, tmp_path, texts, labels)).collect()}
    assert [got[i]["held_out"] for i in range(400)] == out
    assert all(got[i]["predicted"] == (got[i]["score"] >= 0.5) == ("learntword" in texts[i]) for i in range(400))


def test_toxicity_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, ("bad " if i % 2 else "fine ") * 200) for i in range(40)] + [(1, "bad " * 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    learn = F.lit(True)
    assert toxicity.fit(docs, labels, learn, most_bytes=10).weight.any() == False  # noqa: E712
    assert toxicity.fit(docs, labels, learn, most_bytes=20_000).weight.any()


def test_held_out_texts_are_not_counted(spark, tmp_path):
    texts = [f"only{i} common words here" for i in range(60)] + [None, ""]
    out = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    got = {r["doc_id"]: r for r in queries.op7_language(spark, _written(spark, tmp_path, texts)).collect()}
    assert [got[i]["held_out"] for i in range(len(texts))] == out and any(out)
    tokens = [[*(t or "").split(), None] for t in texts]
    assert {r["train_tokens"] for r in got.values()} == {sum(len(t) for t, o in zip(tokens, out) if not o)}
    for i, t in enumerate(tokens):
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(t), len(t) - (out[i] and i < 60))


# -- 3, 8 ------------------------------------------------------------------------
def test_chunks_that_come_again_are_not_learnt_again():
    """As many as a file of documents holds; new ones in between."""
    tok = ChunkTokenizer(vocabulary("byte_bpe_50k.json"), True)
    texts = [" ".join(f"{'abcdefgh'[i % 8]}{'ijklmnop'[i // 8 % 8]}.{'qrstuvwx'[i // 64 % 8]},{'yzabcdef'[i // 512 % 8]};{'ghijklmn'[i // 4096 % 8]}!{'opqrstuv'[i // 32768 % 8]}" for i in range(a, a + 1000)) for a in range(0, 250_000, 1000)]
    first, learnt = tok.encode(texts), []
    learn = tok.learn
    tok.learn = lambda c: learnt.append(c) or learn(c)
    assert tok.encode(texts) == first and len(learnt) < 1000


def test_a_word_is_learnt_once_whatever_signs_follow():
    words = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "klmnprst"]
    ends = ["", ",", ".", "!", "?", ";", ":", ")", "...", "###", "$$$", "***", '."', "),", "?!", "--"]
    texts = [" ".join(w + e for w in words for e in ends[i::4]) for i in range(4)]
    for name, lead in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        tok, learnt = ChunkTokenizer(vocabulary(name), lead), []
        learn = tok.learn
        tok.learn = lambda c, learn=learn, learnt=learnt: learnt.append(c) or learn(c)
        got = tok.encode(texts)
        assert [list(np.frombuffer(x, tok.width)) for x in got] == [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(learnt) <= len(words) + len(ends) + 4  # before: one for each of the 16 * 240 chunks


def test_any_characters_encode_like_the_library(monkeypatch):
    """Beside one another in one group, in parts, and when they come again."""
    signs = [*"aAzZéÉÀÿß×÷ñ'.,#_-<|09 \n\t\r", " ", " ", "\n", "\x00", "\x1c", "\x7f", "\x85", "\xa0", "\xad", "ª", "µ", "ſ", "İ", "ı", "K", "Å", "ẞ", "Σ", "\u0301", "\u212a", "\u212b", "\u1680", "\u2003", "\u2014", "\u2028", "\u3000", "\u180e", "\ufeff", "あ", "д", "😀"]
    signs += ["'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "word", " Word,", ".\nThe", "\n\n", "  "]
    rng = random.Random(7)
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 14))) for _ in range(6000)] + ["", None, " ", "\n"]
    for group in (4 << 20, 40, 3):
        monkeypatch.setattr("tessera.llm.tokens.GROUP", group)
        for name, lead in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
            tok = ChunkTokenizer(vocabulary(name), lead)
            want = [tok.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
            for _ in range(2):
                assert [list(np.frombuffer(x, tok.width)) for x in tok.encode(texts)] == want


def test_a_task_writes_several_shards(spark):
    rows = spark.createDataFrame([(i, f"some words {i} " * 40) for i in range(400)], "doc_id long, text string")
    folder, shards = wavelet.encode(rows, vocabulary("word_bpe_49k.json"), shard_bytes=4000)
    made = shards.collect()
    assert len(made) >= 40 and len({r["part"] for r in made}) <= len(made) / 2
    got = sorted(wavelet.read(folder, shards).collect())
    assert [r["doc_id"] for r in got] == list(range(400)) and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


# -- 5 ---------------------------------------------------------------------------
def test_the_mixing_query_counts_the_mix_itself(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    sf = f"file://{tmp_path}"
    got = [tuple(r) for r in queries.op5_mixing(spark, sf).collect()]
    planned = [(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"], len(r["passes"]), round(r["passes"][0]["position"], 9) if r["passes"] else None) for r in mixing.plan(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, planned)) and len(got) == docs.count()
    mixed = [r["text"] for r in mixing.mix(docs).collect()]
    assert sum(r[4] for r in got) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in mixed) and sum(r[5] for r in got) == len(mixed)
    at = [r["_at"] for r in mixing.draws(docs).collect() if r["_at"] is not None]
    assert at == sorted(at)
    # a mix that loses its texts shows in the query's rows
    whole = mixing.draws
    monkeypatch.setattr(mixing, "draws", lambda *a, **k: whole(*a, **k).withColumn("_body", F.lit("")))
    assert {r["taken"] for r in queries.op5_mixing(spark, sf).collect()} == {0}


# -- 7 ---------------------------------------------------------------------------
def test_a_search_costs_nothing_for_what_it_does_not_look_at():
    x = np.arange(0, 3 << 21, 3)
    e = EliasFano.of(x)
    asked = np.array([0, 7, 3000, 3 << 20])
    tracemalloc.start()
    try:
        assert (e.find(asked) == np.searchsorted(x, asked)).all() and (e.find_equal(asked) == [0, -1, 1000, 1 << 20]).all()
        assert tracemalloc.get_traced_memory()[1] < 50_000
    finally:
        tracemalloc.stop()


def test_shards_are_let_go_with_their_model(spark):
    docs = spark.createDataFrame([(i, f"a few words {i} of text") for i in range(40)], "doc_id long, text string")
    model = ngram.fit(docs, F.lit(True))
    copy = pickle.loads(pickle.dumps(model))
    for m in (copy, model):
        assert m.score(*ngram.token_hashes(pa.array(["a few words", None])))[1].tolist() == [4, 1]
    assert len(pickle.dumps(model)) < 10_000
    gone = weakref.ref(copy), weakref.ref(copy.vocabulary)
    m = None
    del copy
    gc.collect()
    assert [r() for r in gone] == [None, None]
