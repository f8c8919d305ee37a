"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

#: Vectors that take part: finite doubles of the commonest length, scaled to whole numbers.
_VECTORS = """
  all_vectors AS (SELECT *, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
  wide AS (SELECT len(v) AS n FROM all_vectors GROUP BY 1 ORDER BY count(*) DESC, n LIMIT 1),
  vectors AS (
    SELECT * REPLACE (list_transform(v, lambda x: floor({factor} * x)) AS v) FROM all_vectors
    WHERE len(v) = (SELECT n FROM wide) AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
"""

SQL["op9_exact_top_k"] = f"""
WITH {_VECTORS.format(factor=1024)},
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors r ON q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""

SQL["op11_line_dedup"] = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT r, doc_id, string_split(text, chr(10)) AS lines FROM texts),
lines AS (
  SELECT r, doc_id, i, lines[i] AS line,
    translate(regexp_replace(regexp_replace(lines[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM cut)),
repeated AS (SELECT key, min(doc_id) AS keeper FROM lines WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT l.*, k.keeper IS NOT NULL AND k.keeper <> l.doc_id AS gone FROM lines l LEFT JOIN repeated k USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""

#: CRC-32 with the reversed polynomial 0xEDB88320, one entry of its table for each byte.
SQL["op12_prefix_trie"] = """
WITH RECURSIVE
entries AS (
  SELECT list(e ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS e FROM range(256) s(i))),
placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS position
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM placed), entries),
starts AS (SELECT c.conv_id, p.position, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.base AND p.position <= c.h),
rebuilt AS (
  SELECT * FROM starts UNION ALL
  SELECT c.conv_id, p.position - c.h + coalesce(s.got, 0), p.role, p.text
  FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.position > c.h LEFT JOIN (SELECT conv_id, count(*) AS got FROM starts GROUP BY 1) s ON s.conv_id = c.conv_id),
paths AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS points FROM convs UNION ALL
  SELECT p.conv_id, p.depth + 1, md5(p.path || '/' || strlen(r.role) || ':' || r.role || r.text), length(r.text)
  FROM paths p JOIN rebuilt r ON r.conv_id = p.conv_id AND r.position = p.depth + 1),
lasts AS (SELECT conv_id, max(depth) AS last FROM paths GROUP BY 1),
members AS (
  SELECT p.*, l.last, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM paths p JOIN lasts l USING (conv_id)),
nodes AS (
  SELECT depth, path, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(points) AS points,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = last) AS ends
  FROM members GROUP BY depth, path),
children AS (SELECT depth - 1 AS depth, above AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
whole AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, path)),
lines AS (SELECT m.conv_id, m.depth, m.path FROM members m),
below AS (
  SELECT a.depth, a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.points) AS saved
  FROM whole b JOIN lines a ON a.conv_id = b.conv_id AND a.depth <= b.depth GROUP BY 1, 2)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, b.n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM whole w JOIN below b USING (depth, path) LEFT JOIN whole p ON p.depth = w.depth - 1 AND p.path = w.above
"""

SQL["op13_hard_negatives"] = f"""
WITH {_VECTORS.format(factor=256)},
rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM vectors WHERE label IS NOT NULL),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
windows AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * p.positive_score AND 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM windows WHERE rank <= 3
"""
