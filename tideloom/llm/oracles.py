"""The queries that SQL can say, as DuckDB SQL."""

from __future__ import annotations

from .quality_rules import ALPHA, EPS, RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w),
g AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w WHERE len(w) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM g),
c AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS i FROM k WHERE n > 1),
q AS (SELECT p.doc_id, count(c.i) AS n_removed, coalesce(string_agg(p.x, ' ' ORDER BY p.i) FILTER (c.i IS NULL), '') AS kept FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN q ON w.doc_id = q.doc_id
"""

_WITHIN = ", ".join(f"len(list_filter({[float(c) for c in cuts]}, lambda c: {e.replace(' / ', '::DOUBLE / ')} <= c))" for e, cuts in RULES.values())
_LEVELS = min(len(cuts) for _, cuts in RULES.values())

OP7_SQL = rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest(range(3)) AS i FROM k WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
f AS (SELECT w.doc_id, lang, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l.l)::BIGINT AS n_lines
      FROM w JOIN l ON w.doc_id = l.doc_id LEFT JOIN r ON w.doc_id = r.doc_id),
v AS (SELECT *, least({_WITHIN}) AS within FROM f),
good AS (SELECT v.lang, within FROM v SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) y ON v.doc_id = y.doc_id),
s AS (SELECT lang, j, count(*) AS n, count(*) FILTER (within <= j) AS k FROM good, range({_LEVELS}) c(j) GROUP BY ALL),
z AS (SELECT *, CASE WHEN k > n * {EPS} THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END - CASE WHEN n - i > 0 THEN lgamma(n - i + 1) ELSE 0 END + i * ln({EPS}) + (n - i) * ln(1 - {EPS}))) FROM range(0, k + 1) t(i)) END <= {ALPHA} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM good)) AS ok FROM s),
b AS (SELECT lang, coalesce(min(j) FILTER (NOT ok), {_LEVELS}) - 1 AS level FROM z GROUP BY ALL),
d AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v)
SELECT d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND within > coalesce(level, -1) AS kept
FROM d LEFT JOIN b ON d.lang IS NOT DISTINCT FROM b.lang
"""

OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, vec_id = c.c AS kept FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""

_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP8_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LOW}', '{_LOW.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
s AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * k >= 90 * (m + n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, c.c AS component_id FROM g JOIN c ON g.doc_id = c.a
"""


def _crc_table() -> list[int]:
    """The reflected CRC-32 table, from its polynomial."""
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        out.append(b)
    return out


_BYTES = "list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)"
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda a, b: xor(a >> 8, ({_crc_table()}::BIGINT[])[1 + (xor(a, b) & 255)])))"
_SPACE = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Best edits from the last row to the first: for each row and grammar state the least (cost, audit), insertions before the row included.
OP13_SQL = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM d),
f AS (SELECT *, left(role, 1) AS r, rtrim(text, {_SPACE}) AS e, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS after FROM o),
g AS (SELECT *, CASE WHEN e = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM f),
n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
      count(*) FILTER (after IS NOT NULL AND r || after NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM g GROUP BY conv_id),
ins(q, cost, a, t, q2) AS (SELECT q, 0, '', '', q FROM range(4) x(q) UNION ALL VALUES (0, 5, 'I', E'user:\n', 2), (1, 5, 'I', E'user:\n', 2), (2, 5, 'I', E'assistant:\n', 3), (3, 5, 'I', E'user:\n', 2),
      (0, 10, 'II', E'user:\nassistant:\n', 3), (1, 10, 'II', E'user:\nassistant:\n', 3)),
keep(q, r, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
e AS (SELECT conv_id, i, q2 AS q, 0 AS cost, 'K' AS a, role || ':' || text || chr(10) AS t, keep.q AS q0, fault FROM g JOIN keep ON g.r = keep.r WHERE fault NOT IN ('b', 'd')
      UNION ALL SELECT conv_id, i, q2, 1, 'R', CASE keep.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text || chr(10), keep.q, fault FROM g JOIN keep ON keep.r <> 's' WHERE fault NOT IN ('b', 'd')
      UNION ALL SELECT conv_id, i, q, 2, 'D', '', q, '' FROM g, range(4) x(q)),
arc AS MATERIALIZED (SELECT conv_id, i, ins.q AS q0, e.q AS q1, ins.cost + e.cost + CASE WHEN fault = 't' THEN 5 ELSE 0 END AS cost, ins.a || e.a AS a, ins.t || e.t AS t FROM e JOIN ins ON ins.q2 = e.q0),
w AS (SELECT conv_id, n + 1 AS i, q, min({{'c': cost, 'a': a, 't': t}}) AS best FROM n JOIN ins ON ins.q2 IN (0, 3) GROUP BY ALL
      UNION ALL SELECT w.conv_id, w.i - 1 AS i, arc.q0 AS q, min({{'c': arc.cost + best.c, 'a': arc.a || best.a, 't': arc.t || best.t}}) AS best FROM w JOIN arc ON arc.conv_id IS NOT DISTINCT FROM w.conv_id AND arc.i = w.i - 1 AND arc.q1 = w.q GROUP BY ALL),
z AS (SELECT conv_id, best FROM w WHERE i = 1 AND q = 0)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(CASE WHEN best.t = '' THEN '' ELSE left(best.t, length(best.t) - 1) END, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON a.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN z ON a.conv_id IS NOT DISTINCT FROM z.conv_id
"""
