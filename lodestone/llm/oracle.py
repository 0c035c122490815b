"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Smallest node reachable over links(a, b), both directions: reach(node, other), found breadth first.
_REACH = """
reach AS (
  SELECT a AS node, b AS other FROM links
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
)"""

OP2 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
),
fit AS (
  SELECT vec_id, e FROM v
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN e IF x <> 0]) > 0
),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM fit x JOIN fit y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95
),{_REACH}
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(r.least, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(r.least, v.vec_id)) AS kept
FROM v
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.vec_id
LEFT JOIN (SELECT node, min(other) AS least FROM reach GROUP BY node) r ON r.node = v.vec_id
"""

OP5 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w
),
classes AS (
  SELECT min(doc_id) AS rep, any_value(s) AS s, sha256(array_to_string(list_sort(s), chr(10))) AS k FROM sets WHERE len(s) > 0 GROUP BY k
),
rows_ AS (SELECT rep, len(s) AS n, hash(unnest(s)) AS h FROM classes),
links AS (
  SELECT x.rep AS a, y.rep AS b FROM rows_ x JOIN rows_ y ON x.h = y.h AND x.rep <> y.rep
  GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
),{_REACH}
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(least(c.rep, r.least), sets.doc_id) AS component_id
FROM sets
LEFT JOIN classes c ON len(sets.s) > 0 AND c.k = sha256(array_to_string(list_sort(sets.s), chr(10)))
LEFT JOIN (SELECT node, min(other) AS least FROM reach GROUP BY node) r ON r.node = c.rep
"""

_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = f"""
WITH items AS (
  SELECT DISTINCT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
grams AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
),
found AS (SELECT r, item, n, i FROM grams JOIN windows USING (n, g)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN held USING (r)
"""

OP10 = r"""
WITH lines AS (
  SELECT doc_id, md5(text) AS th, unnest(range(0, len(string_split(text, chr(10))))) AS no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL
),
sets AS (
  SELECT doc_id, no, list_sort(list_distinct([x FOR x IN regexp_split_to_array(lower(line), '[ \t\r\x0B\x0C]+') IF x <> ''])) AS s FROM lines
),
named AS (SELECT doc_id, no, s, md5(array_to_string(s, ' ')) AS k, row_number() OVER (ORDER BY doc_id, no) AS pos FROM sets WHERE len(s) > 0),
firsts AS (SELECT k, min(pos) AS pos, any_value(s) AS s, len(any_value(s)) AS n FROM named GROUP BY k),
tokens AS (SELECT pos, n, unnest(s) AS t FROM firsts),
df AS (SELECT t, count(*) AS c FROM tokens GROUP BY t),
ranked AS (SELECT pos, n, t, row_number() OVER (PARTITION BY pos ORDER BY c, t) AS p FROM tokens JOIN df USING (t)),
prefix AS (SELECT pos, n, t FROM ranked WHERE p <= n - (80 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT x.pos AS x, y.pos AS y FROM prefix x JOIN prefix y ON x.t = y.t AND x.pos < y.pos AND 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n),
alike AS (
  SELECT DISTINCT p.y AS pos FROM pairs p JOIN firsts a ON a.pos = p.x JOIN firsts b ON b.pos = p.y
  WHERE 100 * len(list_intersect(a.s, b.s)) >= 80 * (a.n + b.n - len(list_intersect(a.s, b.s)))
),
gone AS (
  SELECT doc_id, no FROM named JOIN firsts USING (k) WHERE named.pos <> firsts.pos
  UNION ALL SELECT doc_id, no FROM named WHERE pos IN (SELECT pos FROM alike)
),
kept AS (
  SELECT doc_id, count(*) FILTER (g.no IS NOT NULL) AS n_removed, string_agg(line, chr(10) ORDER BY l.no) FILTER (g.no IS NULL) AS text
  FROM lines l LEFT JOIN gone g USING (doc_id, no) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_removed, 0)::INTEGER AS n_removed,
  length(CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END)::BIGINT AS n_chars, sha256(CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END) AS text_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

ORACLE_SQL = {"op2_embedding_near_dedup": OP2, "op5_ngram_jaccard": OP5, "op9_decontamination": OP9, "op10_line_dedup": OP10}
