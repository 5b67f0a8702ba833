import math
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import analysis, codec
from tessera.functions.analysis import Analyzer, normalize, stem
from tessera.functions.ranking import Bm25
from tessera.functions.snippet import Highlighter, ceil_boundary, collapse, floor_boundary


def test_accents_and_case_fold():
    assert [normalize(w) for w in ("Ação", "CORAÇÕES", "naïve", "ΟΔΟΣ")] == ["acao", "coracoes", "naive", "οδοσ"]


def test_suffixes_are_stripped_twice_and_short_words_kept():
    assert [stem(w) for w in ("coracoes", "animais", "carros", "mente", "mais", "as")] == ["coracao", "animal", "carro", "mente", "mais", "as"]
    assert [stem(w) for w in ("positions", "running", "queries", "carelessness")] == ["positiom", "runn", "query", "careles"]


def test_positions_count_dropped_words_and_offsets_are_bytes():
    tokens = Analyzer().analyze("the song of a siren")
    assert [(t.term, t.position) for t in tokens] == [("song", 1), ("siren", 4)]
    text = "É, açaí e mel"
    for t in Analyzer.raw().analyze(text):
        assert normalize(text.encode()[t.start : t.end].decode()) == t.term


def test_raw_keeps_everything_and_custom_stopwords_are_normalized():
    assert Analyzer.raw().terms("The CATS are running") == ["the", "cats", "are", "running"]
    assert Analyzer.raw().with_stopwords(["ÁGUA"]).terms("água mole") == ["mole"]
    assert Analyzer.from_json(Analyzer().to_json()) == Analyzer()


def test_expressions_agree_with_python(spark):
    found = ["positions", "carelessness", "coracoes", "abc", "nationalization", "relational", "is"]
    df = spark.createDataFrame([(found,)], "w array<string>")
    assert df.select(analysis.stem_all(F.col("w"))).first()[0] == [stem(w) for w in found]
    assert df.select(analysis.keep_words(F.col("w"), Analyzer())).first()[0] == [w for w in found if w != "is"]
    assert spark.sql("select ' a \n\t b ' as t").select(analysis.collapse_whitespace(F.col("t"))).first()[0] == "a b"


@given(st.lists(st.integers(0, codec.MOST), max_size=40).map(sorted))
def test_gap_coding_round_trips(values):
    data = codec.encode_sorted(values)
    assert codec.decode_sorted(data, len(values)) == (values, len(data))
    assert codec.decode_plain(codec.encode_plain(values), len(values))[0] == values


def test_codec_edges():
    assert [len(codec.write_varint(v)) for v in (0, 127, 128, 16383, 16384, codec.MOST)] == [1, 1, 2, 2, 3, 5]
    assert codec.read_varint(b"\x80\x80") == (0, 2)
    assert codec.read_varint(b"\xff" * 9) == (0, 9)
    block = [(3, [0, 5]), (900, [7])]
    assert codec.decode_block(codec.encode_block(block), 2) == block


def test_sizes_as_expressions(spark):
    df = spark.createDataFrame([([0, 5, 300, 70000],)], "p array<int>")
    assert df.select(codec.positions_length(F.col("p"))).first()[0] == len(codec.encode_sorted([0, 5, 300, 70000]))


def test_bm25():
    assert math.isclose(Bm25.idf(1, 1000), math.log(1 + 999.5 / 1.5))
    assert (Bm25(-1, 5).k1, Bm25(-1, 5).b) == (0, 1)
    assert Bm25(k1=0).score(9, 4, 5, 2.0) == 2.0
    assert Bm25().score(0, 4, 5, 2.0) == 0 == Bm25().score(3, 4, 0, 2.0)
    with pytest.raises(ValueError):
        Bm25(b=math.nan)


def test_bm25_expression_agrees(spark):
    b = Bm25(1.7, 0.4)
    df = spark.createDataFrame([(3, 12, 9.5, 2.25)], "tf int, n int, avg double, idf double")
    assert math.isclose(df.select(b.score_expr(F.col("tf"), F.col("n"), F.col("avg"), F.col("idf"))).first()[0], b.score(3, 12, 9.5, 2.25))


def test_snippets():
    h = Highlighter()
    assert h.snippet("rust", Analyzer.raw(), {"rust"}) == ("**rust**", 1)
    text, n = h.with_max_chars(40).snippet("one two three four five six seven eight nine ten eleven twelve target thirteen", Analyzer.raw(), {"target"})
    assert n == 1 and "**target**" in text and text.startswith("…")
    assert h.snippet("no hit here", Analyzer.raw(), {"x"}) == ("no hit here", 0)
    assert h.with_max_chars(3).max_chars == 16
    assert h.with_markers("<", ">").snippet("a bc", Analyzer.raw(), {"bc"})[0] == "a <bc>"
    data = "aé".encode()
    assert (floor_boundary(data, 2), ceil_boundary(data, 2)) == (1, 3)
    assert collapse("  a \n b ") == "a b"
    long = "é" * 400
    assert h.head(long).endswith("…")


def test_lists_of_words_are_normalized_as_words_are():
    words = ["Ação", "PLAIN", "ΟΔΟΣ", "naïve", "", "İstanbul", "한국", "Ação"]
    lists = [words, [], None, ["b"], words[::-1]] * 150
    array = pa.array(lists, pa.list_(pa.string()))
    want = [[normalize(w) for w in ws or []] for ws in lists]
    assert analysis.normalize_lists(array).to_pylist() == want
    assert analysis.normalize_lists(array.slice(3, 301)).to_pylist() == want[3:304]
    assert analysis.normalize_lists(array.slice(0, 0)).to_pylist() == []


def test_a_batch_does_not_become_python_words():
    array = pa.array([["Coração", "plain", "words"] * 100] * 2000, pa.list_(pa.string()))
    tracemalloc.start()
    assert len(analysis.normalize_lists(array)) == 2000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20  # 600,000 strings of their own would take over 30 MB


def test_stopwords_are_looked_up_and_not_searched(spark):
    df = spark.createDataFrame([(["is", "a", "word", "b", None],)], "w array<string>")
    kept = df.select(analysis.keep_words(F.col("w"), Analyzer()).alias("k"))
    assert kept.first()["k"] == ["word"]
    assert "array_contains" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert df.select(analysis.keep_words(F.col("w"), Analyzer.raw())).first()[0] == ["is", "a", "word", "b"]
