"""SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, CASE WHEN i + 50 <= n THEN array_slice(h, i + 1, i + 50) END AS s, array_slice(h, i + 1, i + 1) AS b FROM d, unnest(range(CAST(n AS BIGINT))) t(i)),
l AS (SELECT s, min(doc_id) AS first FROM w WHERE s IS NOT NULL GROUP BY s),
f AS (SELECT doc_id, i, b, coalesce(first < doc_id, false) AS hit FROM w LEFT JOIN l USING (s)),
c AS (SELECT doc_id, i, b, max(CAST(hit AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c),
a AS (SELECT doc_id, sum(gone) AS removed, sum(CASE WHEN gone = 1 AND before = 0 THEN 1 ELSE 0 END) AS spans, string_agg(hex(b), '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""

_WORDS5 = "regexp_extract_all(" + _LOWER.format(t="coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS5} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS5} AS w FROM benchmark),
k AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g FROM i, unnest(range(1, CAST(len(w) - least(13, len(w)) + 2 AS BIGINT))) t(s) WHERE len(w) > 0),
m AS (SELECT DISTINCT n FROM k),
g AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM d, m, unnest(range(1, CAST(greatest(len(w) - n + 2, 1) AS BIGINT))) t(s)),
h AS (SELECT doc_id, s, g.n, item FROM g JOIN k ON g.g = k.g AND g.n = k.n),
c AS (SELECT doc_id, count(DISTINCT q) AS hit FROM (SELECT doc_id, unnest(range(CAST(s AS BIGINT), CAST(s + n AS BIGINT))) AS q FROM h) GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(hit, 0) > 0 AND 20 * coalesce(hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format(t="coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g FROM d, unnest(range(1, CAST(len(w) - least(4, len(w)) + 2 AS BIGINT))) t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_ >= 80 * (p.n + q.n - both_)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.doc_id = d.doc_id
"""
