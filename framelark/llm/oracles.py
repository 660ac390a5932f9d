"""SQL forms (DuckDB) of the operators that SQL can express, for small tables."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
m AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
f AS (SELECT e.* FROM e SEMI JOIN m USING (g)),
z AS (SELECT w.doc_id, coalesce(n, 0) AS n FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM e GROUP BY 1) USING (doc_id)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT x, y FROM p JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 100 * p.n >= 75 * (a.n + b.n - p.n)),
l AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x)
SELECT z.doc_id, z.n::BIGINT AS n_shingles, c.component_id, c.component_id = z.doc_id AS kept
FROM z JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = z.doc_id
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
tw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM t WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM tw))),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN tw ON tw.g = dw.g AND tw.n = dw.n),
c AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)
"""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM k) WHERE n > 1),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM f) GROUP BY 1),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
g AS (SELECT DISTINCT doc_id, unnest(gone) AS p FROM c),
o AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN g USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(c.gone), 0)::BIGINT AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)
"""
