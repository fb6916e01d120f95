"""DuckDB texts for the queries whose whole result SQL can express, over the same tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: crc32 of a text of ASCII characters, bit by bit, under the reflected polynomial of the standard.
_CRC32 = """xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::BIGINT), lambda c, b:
    list_reduce(range(8), lambda e, k: CASE WHEN e & 1 = 1 THEN xor(e >> 1, 3988292384) ELSE e >> 1 END, xor(c, b)),
    4294967295::BIGINT), 4294967295)"""

OP2 = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
first AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN first USING (payload_digest)
"""

OP5 = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (
    SELECT vec_id, e FROM v
    WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
    least(vec_id, coalesce(b, vec_id)) = vec_id AS kept
FROM v LEFT JOIN degree ON degree.a = vec_id LEFT JOIN least_of ON least_of.a = vec_id
"""

OP11 = rf"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS r,
        regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS p
    FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
found AS (
    SELECT r, item_id, i, x.size
    FROM (SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS p
          FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)) x JOIN windows USING (size, p)),
hits AS (SELECT r, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + size)) AS t(j) GROUP BY r),
named AS (
    SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

OP12 = f"""
WITH given AS (
    SELECT conv_id AS c, turn, octet_length(encode(coalesce(text, ''))) AS bytes,
        md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS tag
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, tag) - 1 AS pos, tag, bytes FROM given),
names AS (SELECT DISTINCT c FROM own),
taken AS (SELECT c, c - c % 5 AS family, {_CRC32.format("(c::VARCHAR)")} % 9 AS h FROM names),
paths AS (
    SELECT t.c, o.pos, tag, bytes FROM taken t JOIN own o ON o.c = t.family AND o.pos < t.h
    UNION ALL
    SELECT o.c, o.pos, tag, bytes FROM taken t JOIN own o ON o.c = t.c AND o.pos >= t.h),
numbered AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, tag, bytes FROM paths),
steps AS (
    SELECT c, d, bytes, md5(string_agg(tag, ',') OVER (PARTITION BY c ORDER BY d)) AS k FROM numbered
    UNION ALL SELECT c, 0, 0, 'root' FROM names),
nodes AS (SELECT k, min(d) AS depth, count(*) AS n_convs, min(c) AS conv_id, min(bytes) AS bytes FROM steps GROUP BY k),
parents AS (
    SELECT n.k, p.k AS parent, m.conv_id AS parent_conv_id
    FROM nodes n JOIN steps p ON p.c = n.conv_id AND p.d = n.depth - 1 JOIN nodes m ON m.k = p.k),
children AS (SELECT parent AS k, count(*) AS n_children FROM parents GROUP BY parent),
below AS (
    SELECT a.k, sum((x.n_convs - 1) * x.bytes) AS saved_tokens, count(*) FILTER (g.k IS NULL) AS n_leaves
    FROM nodes x JOIN steps a ON a.c = x.conv_id AND a.d <= x.depth LEFT JOIN children g ON g.k = x.k GROUP BY a.k),
finals AS (SELECT c, max_by(k, d) AS k FROM steps GROUP BY c),
ends AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256 FROM finals GROUP BY k)
SELECT n.conv_id, n.depth::BIGINT AS depth, parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
    n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN parents USING (k) LEFT JOIN children USING (k) JOIN below USING (k) LEFT JOIN ends USING (k)
"""
