"""SQL of the operators that SQL can express, for an engine with list functions and recursive tables."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_next = lambda n, key: ", ".join(["word", *(f"lead(word, {i}) OVER (PARTITION BY {key} ORDER BY i)" for i in range(1, n))])

#: The smallest id reachable by ``links`` (a, b), both directions given.
_REACHED = "reached(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reached r JOIN links l ON r.other = l.a)"

DECONTAMINATE = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS ws FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT item, ws, least(len(ws), 8) AS n, unnest(range(1, len(ws) - least(len(ws), 8) + 2)) AS i FROM items WHERE len(ws) > 0)),
docs AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM docs),
grams AS (SELECT doc_id, i, [{_next(8, "doc_id")}] AS g FROM words),
found AS (SELECT doc_id, i, n, array_to_string(g[1:n], ' ') AS w FROM grams, (SELECT DISTINCT n FROM windows) WHERE g[n] IS NOT NULL),
hits AS (SELECT f.doc_id, f.i, f.n, windows.item FROM found f JOIN windows USING (n, w)),
spots AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs LEFT JOIN spots USING (doc_id) LEFT JOIN named USING (doc_id)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM docs WHERE len(ws) >= 3),
grams AS (SELECT doc_id, [{_next(3, "doc_id")}] AS g FROM words),
sets AS (SELECT DISTINCT doc_id, array_to_string(g, ' ') AS s FROM grams WHERE g[3] IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM docs WHERE len(ws) BETWEEN 1 AND 2),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
{_REACHED},
roots AS (SELECT id, min(other) AS root FROM reached GROUP BY id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(root, doc_id)) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN roots ON id = doc_id
"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
fine AS (SELECT * FROM vectors WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
{_REACHED},
roots AS (SELECT id, min(other) AS root FROM reached GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(root, vec_id)) AS component_id, vec_id <= coalesce(root, vec_id) AS kept
FROM vectors LEFT JOIN counts ON a = vec_id LEFT JOIN roots ON id = vec_id
"""
