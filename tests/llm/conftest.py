import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" + "," * (rng.random() < 0.1) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and odd texts, copies, near copies, shared passages, one long text."""
    rng = random.Random(3)
    out = [prose(rng, rng.randint(12, 90), 5000) for _ in range(60)]
    passage = prose(rng, 70, 5000)
    for i in range(5):
        out[i] = out[i] + "\n" + passage + "\n" + out[i + 20]
    near = out[40].split(" ")
    near[-1] = "changed"
    long = prose(rng, 6000, 30000)
    out += [None, None, "", " \t\n ", "one", "one two three", "one  two three", out[30], out[30], " ".join(near), "same line here now ok\n" * 8, "# $ % & | < > *** ###" * 9, "é ñ ü ß 漢字 a b \U0001f600 #\n" * 4, long]
    out += ["word " * 300, "password=abcdef123 x", "AKIA" + "A1" * 8 + " secret: \"ab\" hex " + "0af" * 9, "a" * 5000]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", [None, "a", "b", "é"][i % 4 if i % 3 else 1], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no id here at all, this text has none, but it counts", "en", "b", 0), (500, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["_key", "_text", "size", "target", "taken", "digest", "node", "key", "gram", "doc", "at", "score", "h", "b", "q", "absent", "piece", "_row", "failed_bits", "n_words"]
    return docs.withColumns({c: F.lit(1) for c in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def rows(docs):
    """(doc_id, text, source) as plain rows."""
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
