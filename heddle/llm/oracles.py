"""Reference SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

#: Bytes of a document kept as they are by the benchmark rule: digits, a-z and everything above ASCII, after lower-casing A-Z only.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS r FROM (SELECT doc_id, g, n, count(*) OVER (PARTITION BY g) AS c FROM s JOIN n USING (doc_id))),
p AS (SELECT * FROM x WHERE r <= n - ceil(0.85 * n) + 1),
c AS (SELECT DISTINCT p.doc_id AS a, q.doc_id AS b FROM p JOIN p q ON p.g = q.g AND p.doc_id < q.doc_id AND 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n)),
i AS (SELECT a, b, count(*) AS nb FROM c JOIN s ON s.doc_id = a JOIN s t ON t.doc_id = b AND t.g = s.g GROUP BY a, b),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * nb >= 85 * (x.n + y.n - nb)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.doc_id WHERE t.root < e.b),
m AS (SELECT doc_id, min(root) AS root FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(m.root, d.doc_id), d.doc_id) AS component_id, coalesce(least(m.root, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

_OP4 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item, list_aggregate(w[i:least(i + 9, len(w))], 'string_agg', ' ') AS k, least(10, len(w)) AS n FROM b, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 8))) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM p),
g AS (SELECT rid, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS k FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
h AS (SELECT g.rid, g.i, g.n, p.item FROM g JOIN p ON g.k = p.k AND g.n = p.n),
c AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM h) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN s USING (rid)
"""

_OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS target FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM target THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM target THEN target END AS refers_to FROM t
"""

_OP9 = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT rid, i, list_aggregate(w[i:i + 34], 'string_agg', ' ') AS k FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS c FROM g) WHERE c > 1),
x AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS j FROM r),
t AS (SELECT d.rid, u.j, d.w[u.j] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS j) u),
k AS (SELECT t.rid, string_agg(word, ' ' ORDER BY t.j) AS s FROM t ANTI JOIN x ON t.rid = x.rid AND t.j = x.j GROUP BY t.rid),
c AS (SELECT rid, count(*) AS n FROM x GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN c USING (rid) LEFT JOIN k USING (rid)
"""

_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, bool_or(quality IS NOT DISTINCT FROM 1)::INT AS good, bool_or(toxic IS NOT DISTINCT FROM 1)::INT AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
 + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x))::INT + 8 * regexp_matches(x, '[#$%&*|]')::INT
 + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY x), false)::INT AS mask FROM d LEFT JOIN g USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, list_sum(bits[1:k]) - bits[k] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
r AS (SELECT c.part, s.filter_order, s.step, s.bit, sum(CASE WHEN mask & (bit | before::INT) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before::INT = 0 THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN mask & bit > 0 AND mask & before::INT > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN mask & bit > 0 AND mask & before::INT = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & before::INT = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
(sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""

_OP12 = f"""
WITH t AS (SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) ORDER BY i) AS v FROM range(256) r(i)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
gd AS (SELECT rid, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, greatest(len(w), 1))])) AS g FROM d),
gb AS (SELECT unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, greatest(len(w), 1))])) AS g FROM b),
u AS (SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM gd UNION SELECT g FROM gb)),
k AS (SELECT g, xor(list_reduce([('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(strlen(h) // 2)], lambda c, x: xor(c >> 8, v[1 + (xor(c, x) & 255)]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM u, t),
s AS (SELECT bucket, count(*) AS s FROM gd JOIN k USING (g) GROUP BY bucket),
q AS (SELECT bucket, count(*) AS t FROM gb JOIN k USING (g) GROUP BY bucket),
n AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS bs, coalesce((SELECT sum(t) FROM q), 0)::DOUBLE AS bt),
e AS (SELECT bucket, floor(1000.0 * ln((coalesce(t, 0) + 1)::DOUBLE * (bs + 10000) / ((s + 1)::DOUBLE * (bt + 10000))))::BIGINT AS gain FROM s LEFT JOIN q USING (bucket), n),
m AS (SELECT rid, count(*) AS n_features, sum(gain)::BIGINT AS total FROM gd JOIN k USING (g) JOIN e USING (bucket) GROUP BY rid),
w AS (SELECT rid, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, CASE WHEN total IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END::BIGINT AS weight FROM d LEFT JOIN m USING (rid)),
c AS (SELECT *, weight + floor(-1000.0 * ln(-ln((('0x' || substr(sha256(concat('7:', doc_id)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM w),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, rid) AS place FROM c WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * (SELECT count(*) FROM r) // 100 THEN place END::BIGINT AS rank FROM c LEFT JOIN r USING (rid)
"""

ORACLES: dict[str, str] = {"op1_near_dedup": _OP1, "op4_decontaminate": _OP4, "op5_warc": _OP5, "op9_substring_dedup": _OP9, "op11_filter_audit": _OP11, "op12_importance": _OP12}
