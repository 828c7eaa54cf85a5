"""DuckDB SQL of the queries that SQL can express, written for clarity and not for speed."""

SQL = {}

SQL["op4_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
a AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, len(ws) AS n, len(coalesce(js, [])) AS m,
        list_filter(list_transform(range(1, len(ws) + 1),
          lambda j: CASE WHEN list_contains(coalesce(js, []), j) THEN NULL ELSE ws[j] END), lambda x: x IS NOT NULL) AS ks
      FROM w LEFT JOIN a USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM k
"""

# Two hexadecimal digits a byte; the odd ones start no byte.
SQL["op8_suffix_dedup"] = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 399)) AS i FROM t WHERE len(x) >= 800),
g AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
s AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM r),
u AS (SELECT doc_id, i, sum(CASE WHEN before + 400 >= i THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
v AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM u GROUP BY doc_id, run),
y AS (SELECT v.doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY v.doc_id ORDER BY a) AS kept_from, x
      FROM v JOIN t ON v.doc_id = t.doc_id),
z AS (SELECT doc_id, sum(b - a) AS m, count(*) AS n_spans, max(b) AS stop,
        string_agg(substr(x, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) AS head FROM y GROUP BY doc_id)
SELECT t.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(m, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN z ON t.doc_id = z.doc_id
"""

SQL["op1_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY h) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""

# Pairs are only formed by shared shingles; the links of a component are followed until nothing changes.
SQL["op6_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, l.y FROM r JOIN l ON l.x = r.u),
c AS (SELECT v AS doc_id, min(u) AS component_id FROM r GROUP BY v)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

SQL["op9_decontamination"] = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS gram
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT k FROM g),
d AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS gram
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM low, sizes WHERE len(ws) >= k)),
h AS (SELECT DISTINCT doc_id, i, k, item_id FROM d JOIN g USING (k, gram)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT low.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN c ON c.doc_id = low.doc_id LEFT JOIN m ON m.doc_id = low.doc_id
"""

SQL["op11_hard_negatives"] = """
WITH r AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, b.id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor, other AS positive, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.positive AS positive_id,
  row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.other)::INT AS rank, s.other AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""
