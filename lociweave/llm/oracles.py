"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH lines AS (
  SELECT doc_id, u.i AS i, string_split(coalesce(text, ''), chr(10))[u.i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i) u
), keyed AS (
  SELECT doc_id, i, line,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), flagged AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT a.doc_id, a.i, a.line, coalesce(a.doc_id < f.keeper, false) AS gone FROM keyed a LEFT JOIN flagged f ON a.k = f.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP4 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bench AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS s
  FROM bench, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p) u WHERE len(w) > 0
), grams AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM words, (SELECT DISTINCT n FROM windows) l, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS p) u
), found AS (
  SELECT g.doc_id, g.p, g.n, v.item_id FROM grams g JOIN windows v ON g.n = v.n AND g.s = v.s
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM found)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(i.names, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM words w LEFT JOIN hit h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""


OP1 = r"""
WITH t AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    string_split(coalesce(text, ''), chr(10)) AS l
  FROM documents
), grams AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
  FROM t, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS p) u
), again AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (
    SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
  ) GROUP BY doc_id
), lines AS (
  SELECT doc_id, host, x AS line, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, host, unnest(l) AS x FROM t)
), worded AS (
  SELECT doc_id, host, line, len(w) AS n,
    translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000') AS k
  FROM lines WHERE len(w) > 0
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY doc_id
), own AS (
  SELECT doc_id, host, k, sum(n) AS n FROM worded GROUP BY ALL
), hosts AS (
  SELECT host, count(*) AS n FROM t GROUP BY host
), above AS (
  SELECT o.host, o.k FROM own o JOIN hosts h ON o.host IS NOT DISTINCT FROM h.host
  GROUP BY o.host, o.k, h.n HAVING count(*) >= 10 AND count(*) > 0.005 * h.n
), lost AS (
  SELECT doc_id, count(*) AS lines, sum(o.n) AS words FROM own o JOIN above a ON o.k = a.k AND o.host IS NOT DISTINCT FROM a.host GROUP BY doc_id
), base AS (
  SELECT t.doc_id, len(t.w)::BIGINT AS n_words, length(array_to_string(t.w, ''))::BIGINT AS word_chars,
    (length(t.text) - length(regexp_replace(t.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(a.n, 0)::BIGINT AS n_repeat_words,
    coalesce(l.lines, 0)::BIGINT AS n_lines_removed, coalesce(l.words, 0)::BIGINT AS gone
  FROM t LEFT JOIN dups d USING (doc_id) LEFT JOIN again a USING (doc_id) LEFT JOIN lost l USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, gone > 0.5 * n_words AS depleted FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed, n_words - gone AS n_words_left,
  base_failed, depleted, NOT (base_failed OR depleted) AS kept
FROM judged
"""

OP5 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[p:p + least(5, len(w)) - 1], ' ')) AS s
  FROM t, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p) u WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes n ON n.doc_id = a.doc_id JOIN sizes m ON m.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, n.n, m.n HAVING 100 * count(*) >= 75 * (n.n + m.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM t UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least_id AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept
FROM t LEFT JOIN sizes n USING (doc_id) JOIN least_id c USING (doc_id)
"""

OP10 = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM t, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS p) u
), firsts AS (
  SELECT h, min(doc_id) AS lo FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM windows JOIN firsts USING (h) WHERE doc_id > lo
), words AS (
  SELECT doc_id, u.q AS q, w[u.q] AS word FROM t, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS q) u
), kept AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.q) AS s FROM words a ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.q = g.q GROUP BY a.doc_id
), n AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM t LEFT JOIN kept k USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1, "op2_line_dedup": OP2, "op4_decontaminate": OP4, "op5_minhash_dedup": OP5, "op10_substring_dedup": OP10}
