import re
from collections import Counter

import corpus_pipeline
from tessera.llm import neardup, quality, secrets
from tessera.llm.vocabularies import vocabulary


def test_stages(spark, docs, clashing, tmp_path):
    for table in (docs, clashing):
        now, seen = table, []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, "")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == table.columns
            path = f"file://{tmp_path}/{len(table.columns)}-{k}"
            out.write.parquet(path)
            now = spark.read.parquet(path)
            seen.append(now)
        rated, unique, clean, mixed, packed = seen
        bits = quality.ledger(table).where(quality.passes(quality.FULL))
        assert Counter(r[0] for r in rated.select("doc_id").collect()) == Counter(r[0] for r in bits.select("doc_id").collect())
        classes = {r["class_id"] for r in neardup.classes(rated).collect()}
        assert Counter(r["doc_id"] for r in unique.collect()) == Counter(classes)
        texts = {r["doc_id"]: r["text"] for r in clean.collect()}
        assert texts == {r["doc_id"]: secrets.mask(r["text"], secrets.find(r["text"], words=vocabulary("byte_bpe_50k.json"))[1]) for r in unique.collect()}
        count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert abs(sum(count(r["text"]) for r in mixed.collect()) - 1.5 * sum(map(count, texts.values()))) <= 4
        assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()}


def test_empty(spark, empty, tmp_path):
    now = empty
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path}/{k}"
        stage(spark, now, "").write.parquet(path)
        now = spark.read.parquet(path)
    assert now.count() == 0


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {n.split("_")[0] for n in names} | {"pipeline"}
