"""DuckDB SQL for those queries of this subpackage that SQL can express, worked out from their definitions."""

from __future__ import annotations

from . import mixing

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HEX = "CAST('0x' || substr(md5({0}), 1, {1}) AS BIGINT)"
_SEED = mixing.SEED

_MIXING = f"""
WITH sums AS (SELECT source, CAST(sum(coalesce(octet_length(encode(text)), 0) + 1) AS DOUBLE) AS bytes FROM documents GROUP BY source),
rates AS (SELECT source, pow(bytes, {mixing.EXPONENT}) / sum(pow(bytes, {mixing.EXPONENT})) OVER () * sum(bytes) OVER () / bytes AS rate FROM sums),
distribution AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS f FROM rates, (SELECT unnest(range(200)) AS k)),
drawn AS (SELECT *, CAST(doc_id AS VARCHAR) AS id, {_HEX.format(f"'{_SEED}|' || CAST(doc_id AS VARCHAR) || '|1'", 13)} / 4503599627370496.0 AS u FROM documents),
times AS (SELECT d.*, (SELECT count(*) FROM distribution f WHERE f.source IS NOT DISTINCT FROM d.source AND f.f <= d.u) AS n FROM drawn d),
copies AS (SELECT * EXCLUDE (n, u), unnest(range(1, n + 1)) AS copy FROM times)
SELECT * EXCLUDE (id, copy), CAST(copy AS INT) AS copy, {_HEX.format(f"'order{_SEED}|' || id || '|' || CAST(copy AS VARCHAR)", 15)} AS shuffle_key FROM copies"""

_JOIN = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0))),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id"""

# base32: 8 characters of 5 bits from every 10 hexadecimal digits
_WARC = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages),
digests AS (SELECT page_id, octet_length(encode(p)) AS n, max(page_id) OVER (PARTITION BY p) AS top,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 10 * (i // 8) + 1, 10) AS BIGINT) >> (5 * (7 - i % 8))) & 31 AS INT) + 1, 1)), '') AS d FROM payloads)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM digests"""

_TOPK = """
WITH vectors AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

_PATTERN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LEAKS = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '{_PATTERN}') AS w FROM documents),
items AS (SELECT item_id, w, least(10, len(w)) AS m FROM (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '{_PATTERN}') AS w FROM benchmark) WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM items)),
lengths AS (SELECT DISTINCT m FROM items),
doc_windows AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, lengths WHERE len(w) >= m)),
hits AS (SELECT d.doc_id, d.i, d.m, x.item_id FROM doc_windows d JOIN item_windows x ON x.m = d.m AND x.s = d.s),
hit_words AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(x.n, 0) AS n_items, sha256(coalesce(x.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN hit_items x ON x.doc_id = d.doc_id"""

_URLS = """
WITH rules AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS r(h, p, v)),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC) AS i FROM parts JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits ON fits.n = parts.n AND i = 1"""

# time zones are DuckDB's own; quotients of HUGEINTs are floored by taking the remainder off first
_RESAMPLED = """
WITH points AS (SELECT client_id, t, v FROM (SELECT client_id, t, v, row_number() OVER (PARTITION BY client_id, t ORDER BY click_id DESC NULLS LAST, v DESC) AS r
FROM (SELECT client_id, click_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t, CAST(floor(100 * value + 0.5) AS BIGINT) AS v FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL AND isfinite(value))) WHERE r = 1),
next_points AS (SELECT *, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM points WINDOW w AS (PARTITION BY client_id ORDER BY t)),
segments AS (SELECT client_id, t, v, CASE WHEN t2 - t <= 900 THEN t2 - t ELSE 0 END AS d, coalesce(v2, v) - v AS rise FROM next_points),
days AS (SELECT *, CAST(timezone('Europe/Berlin', make_timestamp_ms(t * 1000)::TIMESTAMP AT TIME ZONE 'UTC') AS DATE) AS first, CAST(timezone('Europe/Berlin', make_timestamp_ms((t + greatest(d - 1, 0)) * 1000)::TIMESTAMP AT TIME ZONE 'UTC') AS DATE) AS last FROM segments),
split AS (SELECT *, unnest(range(CAST(last - first AS INT) + 1)) AS i FROM days),
borders AS (SELECT *, CAST(epoch(timezone('Europe/Berlin', CAST(first + CAST(i AS INT) AS TIMESTAMP))) AS BIGINT) AS a, CAST(epoch(timezone('Europe/Berlin', CAST(first + CAST(i + 1 AS INT) AS TIMESTAMP))) AS BIGINT) AS b FROM split),
ends AS (SELECT *, CAST(greatest(t, a) - t AS HUGEINT) AS u0, CAST(least(t + d, b) - t AS HUGEINT) AS u1, CAST(greatest(d, 1) AS HUGEINT) AS e FROM borders),
pieces AS (SELECT client_id, a, CASE WHEN i = 0 THEN 1 ELSE 0 END AS n, CASE WHEN d > 0 THEN u1 - u0 ELSE 0 END AS covered,
CASE WHEN d > 0 THEN 2 * v * (u1 - u0) + (rise * u1 * u1 - ((rise * u1 * u1) % e + e) % e) // e - (rise * u0 * u0 - ((rise * u0 * u0) % e + e) % e) // e ELSE 0 END AS area FROM ends),
sums AS (SELECT client_id, a, sum(n) AS n, sum(covered) AS c, sum(area) AS x FROM pieces WHERE n = 1 OR covered > 0 GROUP BY client_id, a)
SELECT client_id, a AS bucket_start, CAST(n AS BIGINT) AS n_points, CAST(c AS BIGINT) AS covered_seconds, CAST(x AS BIGINT) AS area2, CASE WHEN c > 0 THEN CAST((CAST(x AS HUGEINT) - (CAST(x AS HUGEINT) % CAST(2 * c AS HUGEINT) + CAST(2 * c AS HUGEINT)) % CAST(2 * c AS HUGEINT)) // CAST(2 * c AS HUGEINT) AS BIGINT) END AS avg_cents FROM sums"""

ORACLE_SQL = {
    "op2_mixing": _MIXING,
    "op7_ngram_join": _JOIN,
    "op8_warc": _WARC,
    "op9_topk": _TOPK,
    "op10_decontamination": _LEAKS,
    "op11_url_filters": _URLS,
    "op13_resampling": _RESAMPLED,
}
