"""DuckDB texts for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from tidewright.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, split_words

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w
), n AS (
  SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 75 * (x.n + y.n - k)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(a, b) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL
"""

COSINE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), ok AS (
  SELECT * FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1), d AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY 1)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN d USING (vec_id)
"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_PHRASES = ", ".join(f"('{label}', {_list(split_words(p))})" for p, label in PHRASES.items())
_TEMPLATES = ", ".join(f"('{label}', {_list(sorted(set(split_words(t))))}, {len(split_words(t))})" for label, t in TEMPLATES)

LICENSES = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
p(label, words) AS (VALUES {_PHRASES}), m(label, words, size) AS (VALUES {_TEMPLATES}),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(1, len(w) - len(words) + 2), lambda i: w[i] = words[1] AND w[i:i + len(words) - 1] = words)) - 1 AS place
  FROM d, p
), base AS (
  SELECT doc_id, count(*) AS n, min(place) AS low, max(place) AS high FROM places GROUP BY 1
), lines AS (
  SELECT doc_id, list_distinct(regexp_extract_all(line, {_WORDS})) AS w FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
), starts AS (
  SELECT doc_id, label, words, size, d.w AS w, unnest(list_filter(range(1, len(d.w) + 1), lambda i: list_contains(words, d.w[i]))) AS i FROM d, m
), tried AS (
  SELECT doc_id, label, words, w FROM lines, m UNION ALL SELECT doc_id, label, words, w[i:i + size - 1] FROM starts
), met AS (
  SELECT doc_id, label, len(list_intersect(words, w)) / len(words) AS share FROM tried
  WHERE len(list_intersect(words, w)) >= ceil({THRESHOLD} * len(words) - 1e-9)
), labels AS (
  SELECT doc_id, label, true AS own FROM places UNION ALL SELECT doc_id, label, false FROM met
), named AS (
  SELECT doc_id, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (own), '') AS own, string_agg(DISTINCT label, ',' ORDER BY label) AS every
  FROM labels GROUP BY 1
), best AS (SELECT doc_id, max(share) AS score FROM met GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(base.n, 0) AS n_base, base.low AS first_word, base.high AS last_word,
       coalesce(named.own, '') AS base_labels, coalesce(named.every, '') AS labels, coalesce(best.score, 0.0) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
"""
