"""DuckDB SQL for the operators that SQL can express; plain, not fast."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COMPONENTS = """
reach(a, b) AS (SELECT a, a FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component FROM reach GROUP BY a)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' #'] ELSE CAST([] AS VARCHAR[]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),{_COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, d.doc_id = coalesce(component, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.a = d.doc_id
"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),{_COMPONENTS}
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, coalesce(component, v.vec_id) AS component_id, v.vec_id = coalesce(component, v.vec_id) AS kept
FROM v LEFT JOIN comp ON comp.a = v.vec_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
r AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM r
"""

MIXING = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
o AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM o),
l AS (SELECT *, sum(source_size) OVER () AS total, sum(source_size) OVER x - source_size AS own_before, sum(weight) OVER () - sum(weight) OVER x + weight AS weight_left FROM k WINDOW x AS (ORDER BY source_size / weight, source NULLS LAST)),
m AS (SELECT *, CAST(total - 3.0 * own_before AS DOUBLE) / weight_left AS level_ FROM l),
f AS (SELECT min_by(level_, own_before) AS level_ FROM m WHERE level_ * weight < 3.0 * source_size),
t AS (SELECT source, source_size, CASE WHEN f.level_ IS NULL THEN CAST(3.0 * source_size AS DOUBLE) ELSE least(CAST(3.0 * source_size AS DOUBLE), f.level_ * weight) END AS target FROM k, f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(3.0::DOUBLE, t.target / t.source_size) ELSE 0 END AS rate,
  CAST(CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

NEAREST = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

LINES = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last_ FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> last_ AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""

#: The table of 256 values for a byte-wise crc32, as one row with the list tab.
_CRC_ROW = "list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
_CRC = f"crc_table AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, {_CRC_ROW} AS v FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))),"


def _crc(text: str) -> str:
    """An expression for the crc32; the row must have crc_table's tab."""
    code = f"hex(encode({text}))"
    steps = f"list_transform(range(0, length({code}) // 2), lambda i: CAST('0x' || substr({code}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), lambda c, b: xor(c >> 8, tab[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), CAST(4294967295 AS BIGINT))"


TRIE = f"""
WITH {_CRC}
t AS (SELECT conv_id, [coalesce(role, ''), coalesce(text, '')] AS turn_, turn AS at_ FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(turn_ ORDER BY at_ NULLS FIRST, sha256(CAST(strlen(turn_[1]) AS VARCHAR) || ':' || turn_[1] || turn_[2])) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, conv_id - conv_id % 20 AS family, CAST({_crc("CAST(conv_id AS VARCHAR)")} % 4 AS BIGINT) AS h FROM o, crc_table),
r AS (SELECT a.conv_id, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) AS turns FROM h a LEFT JOIN o b ON a.family = b.conv_id),
p AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM r),
n AS (SELECT depth, turns[1:depth] AS node, min(conv_id) AS conv_id, count(*) AS n_convs, list(conv_id ORDER BY conv_id) FILTER (WHERE len(turns) = depth) AS ends, max(len(turns)) > depth AS branches FROM p GROUP BY 1, 2),
s AS (SELECT depth, node, conv_id, n_convs, ends, branches, CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(node[depth][2], '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS own_saved FROM n),
up AS (SELECT node[1:d] AS node, count(*) FILTER (WHERE NOT branches) AS n_leaves, sum(own_saved) AS saved_tokens, count(*) FILTER (WHERE depth = d + 1) AS n_children
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM s) GROUP BY d, node[1:d])
SELECT s.conv_id, CAST(s.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, s.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(array_to_string(s.ends, ','), '')) AS ends_sha256
FROM s JOIN up ON s.node = up.node LEFT JOIN s q ON s.depth > 0 AND q.depth = s.depth - 1 AND q.node = s.node[1:s.depth - 1]
"""

_FEATURES = "regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(u=_UPPER, l=_LOWER)
IMPORTANCE = f"""
WITH {_CRC}
d AS (SELECT row_number() OVER () AS row_, doc_id, {_FEATURES} AS w FROM documents),
b AS (SELECT unnest({_FEATURES}) AS g FROM benchmark),
f AS (SELECT row_, unnest(w) AS g FROM d),
k AS (SELECT g, CAST({_crc("g")} % 10000 AS BIGINT) AS bucket FROM (SELECT g FROM f UNION SELECT g FROM b) v, crc_table),
s AS (SELECT bucket, count(*) AS n FROM f JOIN k USING (g) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN k USING (g) GROUP BY bucket),
z AS (SELECT CAST((SELECT count(*) FROM f) AS DOUBLE) + 10000 AS s_all, CAST((SELECT count(*) FROM b) AS DOUBLE) + 10000 AS t_all),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + CAST(1 AS DOUBLE)) * s_all / ((coalesce(s.n, 0) + CAST(1 AS DOUBLE)) * t_all))) AS BIGINT) AS gain FROM (SELECT DISTINCT bucket FROM k) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), z),
m AS (SELECT row_, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n FROM f JOIN k USING (g) JOIN gain USING (bucket) GROUP BY row_),
w AS (SELECT row_, doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
  CAST(CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) AS h FROM d LEFT JOIN m USING (row_)),
x AS (SELECT row_, doc_id, n_features, weight, CAST(weight + floor(CAST(-1000 AS DOUBLE) * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM w),
e AS (SELECT row_, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS k, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= n * 10 // 100 THEN k END AS rank FROM x LEFT JOIN e USING (row_)
"""
