"""DuckDB SQL for the corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
PLAIN_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _gram(n: int) -> str:
    """The ``n`` words from a word on, joined by spaces, which no word holds; null where the document ends sooner."""
    return " || ' ' || ".join(["word", *(f"lead(word, {j}) OVER d" for j in range(1, n))])


OP2 = f"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({FOLD}, '{PLAIN_WORD}') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts),
grams AS (SELECT doc_id, {_gram(4)} AS g FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
sets AS (
  SELECT DISTINCT doc_id, g FROM grams WHERE g IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM texts WHERE len(w) BETWEEN 1 AND 3
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.c >= 85 * (x.n + y.n - c.c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, m.component_id, coalesce(k.n, 0) AS n_links
FROM texts t
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = t.doc_id
LEFT JOIN sizes s ON s.doc_id = t.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = t.doc_id
"""

OP4 = f"""
WITH texts AS (SELECT doc_id, regexp_extract_all({FOLD}, '{ALNUM_WORD}') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS doc_id, regexp_extract_all({FOLD}, '{ALNUM_WORD}') AS w FROM benchmark),
item_words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM items),
windows AS (
  SELECT DISTINCT doc_id AS item, 8 AS m, g FROM (SELECT doc_id, {_gram(8)} AS g FROM item_words WINDOW d AS (PARTITION BY doc_id ORDER BY pos)) WHERE g IS NOT NULL
  UNION ALL SELECT doc_id, len(w), array_to_string(w, ' ') FROM items WHERE len(w) BETWEEN 1 AND 7
),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts),
starts AS (SELECT doc_id, pos, {", ".join(f"{_gram(m)} AS g{m}" for m in range(1, 9))} FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
found AS ({" UNION ALL ".join(f"SELECT s.doc_id, s.pos, x.m, x.item FROM starts s JOIN windows x ON x.m = {m} AND x.g = s.g{m}" for m in range(1, 9))}),
hits AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + m)) AS pos FROM found) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(o.n, 0) AS n_items,
  sha256(coalesce(o.items, '')) AS items_sha256, coalesce(o.n, 0) >= 2 AS contaminated
FROM texts t LEFT JOIN hits h ON h.doc_id = t.doc_id LEFT JOIN owners o ON o.doc_id = t.doc_id
"""

OP5 = f"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{PLAIN_WORD}') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts),
starts AS (SELECT doc_id, pos, word, {_gram(20)} AS g FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
seen AS (SELECT doc_id, pos, word, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) > 1 AS again FROM starts),
judged AS (SELECT doc_id, pos, word, max(CAST(again AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM seen),
kept AS (SELECT doc_id, sum(gone) AS n, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS words FROM judged GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.words, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""

ORACLE_SQL = {"op2_ngram_jaccard_join": OP2, "op4_benchmark_decontamination": OP4, "op5_substring_dedup": OP5}
