"""DuckDB SQL that says independently what the queries of ``tessera.catalog`` return."""

from __future__ import annotations

from tessera.functions.analysis import STOPWORDS, SUFFIX_RULES

Clause = tuple[str, list[tuple[str, int]]]


def _strip(column: str) -> str:
    whens = " ".join(
        f"WHEN ends_with({column}, '{e}') AND length({column}) >= {len(e) + least} THEN left({column}, length({column}) - {len(e)}) || '{put}'" for e, put, least in SUFFIX_RULES
    )
    return f"CASE {whens} ELSE {column} END"


def words(source: str = "documents", key: str = "doc_id") -> str:
    return f"""
    ws AS (SELECT {key} AS doc_id, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {source}),
    raw AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM ws),
    norm AS (SELECT doc_id, pos, w, lower(strip_accents(w)) AS n FROM raw)"""


def tokens(plain: bool = False, source: str = "documents", key: str = "doc_id") -> str:
    if plain:
        return words(source, key) + ",\n    tok AS (SELECT doc_id, pos, n AS term FROM norm)"
    stops = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))
    return (
        words(source, key)
        + f""",
    kept AS (SELECT * FROM norm WHERE length(n) >= 2 AND n NOT IN ({stops})),
    voc AS (SELECT DISTINCT n FROM kept),
    once AS (SELECT n, {_strip("n")} AS s FROM voc),
    twice AS (SELECT n, {_strip("s")} AS term FROM once),
    tok AS (SELECT doc_id, pos, term FROM kept JOIN twice USING (n))"""
    )


def index(plain: bool = False, source: str = "documents", key: str = "doc_id") -> str:
    return (
        tokens(plain, source, key)
        + f""",
    len AS (SELECT d.{key} AS doc_id, count(t.pos) AS length FROM {source} d LEFT JOIN tok t ON t.doc_id = d.{key} GROUP BY 1),
    post AS (SELECT term, doc_id, count(*) AS tf, any_value(length) AS length FROM tok JOIN len USING (doc_id) GROUP BY 1, 2),
    coll AS (SELECT count(*) AS n, sum(length)::BIGINT AS total FROM len)"""
    )


TERMS = "terms AS (SELECT term, count(*) AS df, max(tf) AS max_tf, min(length) AS min_len FROM post GROUP BY 1)"
NUMBERED = "num AS (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 128 AS block_no FROM post)"
GAPS = "gap AS (SELECT *, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term, block_no ORDER BY doc_id), 0) AS gap FROM num)"


def vlen(x: str) -> str:
    return "(1 + " + " + ".join(f"({x} >= {1 << 7 * i})::INT" for i in range(1, 5)) + ")"


def bm25(tf: str, length: str, df: str, k1: float = 1.2, b: float = 0.75) -> str:
    return f"(ln(1e0 + (coll.n - {df} + 0.5e0) / ({df} + 0.5e0)) * {tf} * {k1 + 1!r}e0 / ({tf} + {k1!r}e0 * ({1 - b!r}e0 + {b!r}e0 * {length} / (coll.total::DOUBLE / coll.n))))"


def clause(i: int, terms: list[tuple[str, int]]) -> str:
    if len(terms) == 1:
        return f"c{i} AS (SELECT doc_id, tf FROM post WHERE term = '{terms[0][0]}')"
    joins = " ".join(f"JOIN tok t{j} ON t{j}.doc_id = t0.doc_id AND t{j}.pos = t0.pos + {off} AND t{j}.term = '{t}'" for j, (t, off) in enumerate(terms) if j)
    return f"c{i} AS (SELECT t0.doc_id, count(*) AS tf FROM tok t0 {joins} WHERE t0.term = '{terms[0][0]}' GROUP BY 1)"


def scores(clauses: list[Clause], k1: float = 1.2, b: float = 0.75, plain: bool = False, source: str = "documents", key: str = "doc_id") -> str:
    """CTEs down to hits(doc_id, score)."""
    ctes = [clause(i, terms) for i, (_, terms) in enumerate(clauses)]
    parts = []
    for i, (occur, _) in enumerate(clauses):
        if occur != "-":
            parts.append(f"SELECT doc_id, {bm25('tf', 'length', f'(SELECT count(*) FROM c{i})', k1, b)} AS s FROM c{i} JOIN len USING (doc_id), coll")
    where = "".join(f" AND doc_id {'NOT ' * (o == '-')}IN (SELECT doc_id FROM c{i})" for i, (o, _) in enumerate(clauses) if o)
    return index(plain, source, key) + ",\n" + ",\n".join(ctes) + f",\nhits AS (SELECT doc_id, round(sum(s), 6) AS score FROM ({' UNION ALL '.join(parts)}) WHERE true{where} GROUP BY 1)"


def top(clauses: list[Clause], k: int = 10, **kw) -> str:
    return f"WITH {scores(clauses, **kw)} SELECT doc_id, score FROM hits ORDER BY score DESC, doc_id LIMIT {k}"
