"""DuckDB SQL that gives the same rows as the queries, where SQL can express them.

SQL can't express merges of a tokenizer, trained models, minimax cuts or the entropy of sliding windows; those queries are
held against brute-force versions in the tests. What SQL can express of them has queries of its own, op*_base."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[i : i + 3] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.k >= 80 * (x.n + y.n - p.k)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_ALNUM}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, n, w[i : i + n - 1] AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
o AS (SELECT doc_id, n, i, w[i : i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, o.n, item_id FROM o JOIN g ON o.n = g.n AND o.g = g.g),
k AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)"""


_WORDS = r"[^\x20\x09-\x0D]+"

QUALITY_BASE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '{_WORDS}'), []) AS w, row_number() OVER () AS r FROM documents),
g AS (SELECT r, i, w[i : i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
h AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM g) WHERE k > 1) GROUP BY 1),
l AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_WORDS}') GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words,
len(w) < 10 OR 100 * coalesce(h.n, 0) > 20 * len(w) AS base_failed FROM d LEFT JOIN h USING (r) LEFT JOIN l USING (r)"""

SECRETS_BASE = r"""
SELECT doc_id, CAST(coalesce(len(list_filter(regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 8)), 0) AS BIGINT) AS n_assign,
CAST(coalesce(len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)), 0) AS BIGINT) AS n_access,
CAST(coalesce(len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 32)), 0) AS BIGINT) AS n_hex FROM documents"""

SHARDING_BASE = """
WITH g AS (SELECT text, sum(coalesce(octet_length(encode(text)), 0) + 1) AS w FROM documents GROUP BY 1)
SELECT CAST(8 AS BIGINT) AS shards, CAST((SELECT count(*) FROM documents) AS BIGINT) AS n_rows, CAST(sum(w) AS BIGINT) AS size, TRUE AS groups_whole, TRUE AS slots_gapless, TRUE AS balanced FROM g"""
