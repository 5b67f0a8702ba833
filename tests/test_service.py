import json
import time

import pytest

from tessera import cli, render
from tessera.engine import Engine
from tessera.functions.analysis import Analyzer
from tessera.sources import crawl, store
from tessera.streaming.service import SearchService


@pytest.fixture
def tree(tmp_path):
    for name, text in {"rust.md": "##  Rust \nno collector", "nested/go.TXT": "\n\nGo has goroutines and a collector", "photo.png": "x", ".git/HEAD.txt": "x", "a-b.md": "", "a/b.md": "# \n# Title", "txt": "x", ".txt": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_crawl(spark, tree):
    got = [(r["doc_id"], r["uri"].removeprefix(f"{tree}/"), r["title"]) for r in crawl.read_tree(spark, str(tree)).orderBy("doc_id").collect()]
    assert got == [(0, "a/b.md", "Title"), (1, "a-b.md", "a-b"), (2, "nested/go.TXT", "Go has goroutines and a collector"), (3, "rust.md", "Rust")]
    assert crawl.read_tree(spark, str(tree), [".MD"]).count() == 3


def test_crawl_rejects_bad_text(spark, tree):
    (tree / "bad.md").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="UTF-8"):
        crawl.read_tree(spark, str(tree)).collect()


def test_engine_round_trip(spark, tree, tmp_path):
    e = Engine(spark)
    assert e.index_dir(str(tree)) == 4
    hits = e.search("goroutines").collect()
    assert len(hits) == 1 and "**goroutines**" in hits[0]["snippet"]
    e.add_document("x", "X", "a new collector")
    e.save(f"file://{tmp_path}/index")
    again = Engine(spark).load(f"file://{tmp_path}/index")
    assert [(r["title"], r["score"]) for r in again.search("collector").collect()] == [(r["title"], r["score"]) for r in e.search("collector").collect()]
    assert again.search("collector").count() == 3


def test_store_errors(spark, tmp_path):
    def kind(path):
        with pytest.raises(store.StoreError) as e:
            store.load(spark, f"file://{path}")
        return e.value.kind

    assert kind(tmp_path / "none") == "missing"
    (tmp_path / "d").mkdir()
    assert kind(tmp_path / "d") == "incomplete"
    (tmp_path / "d/meta.json").write_text("{")
    assert kind(tmp_path / "d") == "decode"
    (tmp_path / "d/meta.json").write_text('{"format": 99}')
    assert kind(tmp_path / "d") == "version"


def test_generations(spark, tree, tmp_path):
    service = SearchService(spark, f"file://{tmp_path}/service")
    with pytest.raises(LookupError):
        service.snapshot()
    assert service.reindex(str(tree)) == 1
    held = service.snapshot()
    other = Engine(spark, Analyzer.raw())
    other.add_document("s", "Stamps", "a collector of stamps")
    assert service.publish(other) == 2
    assert held.engine.search("collector").count() == 2
    found, number = service.search("collector")
    assert (found.count(), number) == (1, 2)
    assert service.collect() == []
    del held
    assert service.collect(grace=3600) == []  # another process may still read it
    assert service.collect() == [1]
    with pytest.raises(Exception):  # noqa: B017
        service.reindex(str(tmp_path / "missing"))
    assert service.generation() == 2
    assert SearchService(spark, f"file://{tmp_path}/service").generation() == 2


def test_watch(spark, tree, tmp_path):
    root = tmp_path.parent / (tmp_path.name + "-watch")
    service = SearchService(spark, f"file://{root}/service")
    stream = service.watch(str(tree), 1, f"file://{root}/at", ["*.md", "*.TXT"])
    try:
        deadline = time.time() + 90
        while service.generation() < 1 and time.time() < deadline:
            time.sleep(0.5)
        assert service.search("goroutines")[0].count() == 1
    finally:
        stream.stop()


def test_cli(spark, tree, tmp_path, capsys):
    at = f"file://{tmp_path}/cli"
    assert cli.main(["index", str(tree), "-i", at, "--no-stemming"], spark) == 0
    assert cli.main(["search", "goroutines", "-i", at, "--json"], spark) == 0
    out = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert out["count"] == 1 and out["strategy"] == "wand" and "**goroutines**" in out["results"][0]["snippet"]
    assert cli.main(["search", "collector", "-i", at, "--explain", "--k1", "2"], spark) == 0
    assert "strategy: wand" in capsys.readouterr().out
    assert cli.main(["stats", "-i", at], spark) == 0
    assert "documents:" in capsys.readouterr().out
    assert cli.main(["search", '"open', "-i", at], spark) == 1
    assert cli.main(["search", "x", "-i", at + "-none"], spark) == 1


def test_render():
    rows = [{"uri": "u", "title": "T", "score": 1.25, "snippet": "s"}]
    assert render.results("q", []) == "no results for 'q'"
    assert "1. T  1.250" in render.results("q", rows)
    assert "avoided:  50.0 %" in render.explain({"strategy": "wand", "candidates": 4, "scored": 2})
