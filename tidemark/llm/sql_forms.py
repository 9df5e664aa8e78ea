"""SQL forms of the operators that SQL can say, for any engine with lists and regular expressions."""
from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS t, {_SPACED} AS w, row_number() OVER () AS r FROM documents),
grams AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS x FROM again) GROUP BY r),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT d.r, doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN lines USING (r) LEFT JOIN rep USING (r)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_symbols > 0.5 * n_words OR n_dup_lines > 0.3 * n_lines OR word_chars > 20 * n_words AS soft FROM c),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed OR soft)::DOUBLE AS f FROM j GROUP BY source),
p AS (SELECT sum(f) / sum(n) AS m, coalesce(var_samp(f / n) FILTER (n >= 2), 0) - sum(f) / sum(n) * (1 - sum(f) / sum(n)) * coalesce(avg(1 / n) FILTER (n >= 2), 0) AS between_ FROM h),
s AS (SELECT m, CASE WHEN between_ <= 0 THEN 1000.0 ELSE least(1000.0, greatest(2.0, m * (1 - m) / between_ - 1)) END AS k FROM p),
v AS (SELECT source, (f + m * k) / (n + k) > 0.5 AS rejected FROM h, s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND NOT (soft AND rejected) AS kept
FROM j JOIN v ON j.source IS NOT DISTINCT FROM v.source"""

DECONTAMINATE = rf"""
WITH b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_ALNUM} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
d AS MATERIALIZED (SELECT doc_id, {_ALNUM} AS w, row_number() OVER () AS r FROM documents),
pos AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw))),
hit AS (SELECT DISTINCT r, i, pos.n AS n, item_id FROM pos JOIN iw ON pos.n = iw.n AND pos.k = iw.k),
cov AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)"""

SUBSTRING = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_SPACED} AS w, row_number() OVER () AS r FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS x FROM rep),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS x FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY x) AS t FROM words ANTI JOIN gone USING (r, x) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""


BLANKS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w, row_number() OVER () AS r FROM documents),
l AS (SELECT r, doc_id, line, pos, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS k FROM (SELECT r, doc_id, unnest(w) AS line, generate_subscripts(w, 1) AS pos FROM d)),
many AS (SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
kept AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS t FROM l LEFT JOIN many USING (k) WHERE holder IS NULL OR holder = doc_id GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_lines, (len(w) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""


def _rounds(n: int) -> str:
    """Assignment 0, then update and assignment up to n."""
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"a0 AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min(row({far}::BIGINT, e)) AS b FROM parts JOIN c0 USING (p) GROUP BY vec_id, p)"]
    for i in range(1, n + 1):
        steps += [f"s{i} AS (SELECT p, e, i, sum(v) AS s, count(*) AS n FROM (SELECT p, b[2] AS e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{i - 1}) GROUP BY p, e, i)",
                  f"m{i} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{i} GROUP BY p, e)",
                  f"c{i} AS MATERIALIZED (SELECT p, e, coalesce(m{i}.c, c{i - 1}.c) AS c FROM c{i - 1} LEFT JOIN m{i} USING (p, e))",
                  f"a{i} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min(row({far}::BIGINT, e)) AS b FROM parts JOIN c{i} USING (p) GROUP BY vec_id, p)"]
    return ",\n".join(steps)


VECTOR_CODES = f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x, len(embedding) // 16 AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, x[p * n + 1:(p + 1) * n] AS x FROM (SELECT *, unnest(range(0, 16)) AS p FROM v)),
c0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < 64) USING (vec_id)),
{_rounds(2)},
o AS (SELECT vec_id, string_agg(lpad(lower(to_hex(b[2])), 2, '0'), '' ORDER BY p) AS code, sum(b[1])::BIGINT AS error FROM a2 GROUP BY vec_id),
t AS (SELECT label, sum(error)::BIGINT AS label_error FROM o JOIN v USING (vec_id) GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256
FROM o JOIN v USING (vec_id) JOIN t ON v.label IS NOT DISTINCT FROM t.label"""

#: States: E nothing put out, S system, U user last, A assistant last; one row of a conversation a step, insertions before it.
CONVERSATIONS = rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
bits AS MATERIALIZED (SELECT n AS v, list_reduce([n] || range(8)::BIGINT[], lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS t FROM range(256) r(n)),
table_ AS MATERIALIZED (SELECT list(t ORDER BY v) AS t FROM bits),
hashed AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)), 4294967295) % 20 AS d FROM raw, table_),
hurt AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE d <> 0),
seen AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, trim(text, {BLANKS}) AS bare, left(role, 1) AS ini FROM hurt),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, i, ini, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM seen),
stats AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
step(q, letter, want, q2, c, put) AS (VALUES ('E','I','','U',5,'user:'), ('S','I','','U',5,'user:'), ('U','I','','A',5,'assistant:'), ('A','I','','U',5,'user:'),
  ('E','K','s','S',0,''), ('E','K','u','U',0,''), ('S','K','u','U',0,''), ('U','K','a','A',0,''), ('A','K','u','U',0,''),
  ('E','R','','U',1,'user'), ('S','R','','U',1,'user'), ('U','R','','A',1,'assistant'), ('A','R','','U',1,'user'),
  ('E','D','','E',2,''), ('S','D','','S',2,''), ('U','D','','U',2,''), ('A','D','','A',2,'')),
lead_ AS MATERIALIZED (SELECT q, '' AS aud, q AS q2, 0 AS c, []::VARCHAR[] AS put FROM (VALUES ('E'), ('S'), ('U'), ('A')) s(q)
  UNION ALL SELECT q, 'I', q2, c, [put] FROM step WHERE letter = 'I'
  UNION ALL SELECT a.q, 'II', b.q2, a.c + b.c, [a.put, b.put] FROM step a JOIN step b ON a.letter = 'I' AND b.letter = 'I' AND a.q2 = b.q),
edit AS MATERIALIZED (SELECT l.q, l.aud || s.letter AS aud, s.q2, l.c + s.c AS c, s.letter, s.want, l.put AS ins, s.put AS new_role FROM lead_ l JOIN step s ON l.q2 = s.q AND s.letter <> 'I'),
walk(conv_id, i, q, w) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 'E', row(0::BIGINT, '', []::VARCHAR[]) FROM conversations
  UNION ALL
  SELECT f.conv_id, f.i, e.q2, min(row((w[1] + e.c + CASE WHEN fault = 't' AND letter <> 'D' THEN 5 ELSE 0 END)::BIGINT, w[2] || e.aud,
      w[3] || e.ins || CASE letter WHEN 'K' THEN [role || ':' || text] WHEN 'R' THEN [new_role || ':' || text] ELSE []::VARCHAR[] END))
  FROM walk JOIN f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.i = walk.i + 1 JOIN edit e ON e.q = walk.q AND (letter <> 'K' OR want = ini) AND (letter = 'D' OR fault NOT IN ('b', 'd'))
  GROUP BY f.conv_id, f.i, e.q2),
ended AS (SELECT walk.conv_id, min(row((w[1] + l.c)::BIGINT, w[2] || l.aud, w[3] || l.put)) AS w FROM walk JOIN lead_ l ON l.q = walk.q AND l.q2 IN ('E', 'A') LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM walk.conv_id
  WHERE walk.i = coalesce(n, 0) GROUP BY walk.conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  w[1]::BIGINT AS cost, w[2] AS audit, sha256(array_to_string(w[3], chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM e.conv_id"""
