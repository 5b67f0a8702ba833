"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) > 5),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g FROM p),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
             length(array_to_string(words, ''))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 4 ELSE 0 END
        + CASE WHEN 4 * n_symbols > word_chars THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
        + CASE WHEN word_chars > 40 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM b
"""

OP5 = r"""
WITH d AS (SELECT doc_id, source, md5(doc_id::VARCHAR) AS digest,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place
      FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[place % 3 + 1]::DOUBLE AS weight, source_size::DOUBLE * 2 AS cap FROM s),
k AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total, sum(weight) OVER () AS all_weight,
             coalesce(sum(cap) OVER f, 0) AS cap_before, coalesce(sum(weight) OVER f, 0) AS weight_before FROM w
      WINDOW f AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - cap_before) / (all_weight - weight_before) AS level FROM k),
g AS (SELECT source, place, source_size,
             least(coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight, cap), cap) AS target FROM l),
o AS (SELECT d.doc_id, d.size, place, source_size, target, floor(target + 1e-6)::BIGINT AS goal,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
t AS (SELECT *, greatest(least(goal - begins, size), 0) AS taken1, greatest(least(goal - begins - source_size, size), 0) AS taken2,
             begins / target AS u FROM o),
q AS (SELECT *, CASE place % 3
        WHEN 0 THEN 2e0 * u / (1.25e0 + sqrt(greatest(1.5625e0 - 1e0 * u, 1e-300)))
        WHEN 1 THEN u
        ELSE CASE WHEN u * 1e0 <= 0.375e0 THEN 2e0 * u / (0.5e0 + sqrt(0.25e0 + 2e0 * u))
             ELSE 0.5e0 + 2e0 * (u - 0.375e0) / (1e0 + sqrt(1e0 + 2e0 * (u - 0.375e0))) END END AS due FROM t)
SELECT doc_id, size, source_size, target, (taken1 + taken2)::BIGINT AS taken,
       ((taken1 > 0)::INT + (taken2 > 0)::INT)::INT AS n_passes,
       round(CASE WHEN taken1 > 0 THEN least(due, 1e0) END, 9) AS position
FROM q
"""

OP9 = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) AS doc,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT r, doc_id, doc, unnest(range(0, len(words) - 49)) AS i, words FROM w WHERE len(words) >= 50),
g AS (SELECT doc_id, doc, i, md5_number(array_to_string(words[i + 1:i + 50], ' ')) AS g FROM p),
s AS (SELECT g FROM g GROUP BY g HAVING min(doc) <> max(doc)),
h AS (SELECT DISTINCT doc_id, doc, i FROM g SEMI JOIN s USING (g)),
m AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM h),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM m)
SELECT any_value(doc_id) AS doc_id, min(i)::BIGINT AS start_word, (max(i) + 50)::BIGINT AS end_word,
       (max(i) + 50 - min(i))::BIGINT AS n_words FROM k GROUP BY doc, span
"""

ORACLES: dict[str, str] = {"op1_quality": OP1, "op5_mixing": OP5, "op9_passages": OP9}
