"""SQL that gives the rows of the registered queries, written from their contracts and not from the operators."""

from __future__ import annotations

#: Lower-cases A-Z alone.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CHAT = r"""
WITH own AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM own),
m AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id, alone) AS turns,
  length(text) + length(regexp_replace(text, '[^\\<>\[]', '', 'g'))
  + CASE role WHEN 'user' THEN length('<s>[INST] ') + length(' [/INST]') WHEN 'assistant' THEN length(' ') + length(' </s>')
    ELSE length('<<') + length(role) + length(regexp_replace(role, '[^\\<>\[]', '', 'g')) + length('>> ') + length(' <</>>') END AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id, alone ORDER BY n) AS said FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(said) FILTER (WHERE role = 'assistant' OR n = turns) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id, alone"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
d AS (SELECT *, sha1(h) AS x FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(x, CAST(5 * (k // 4) + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM d"""

SUBSTRINGS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, k, md5(substr(h, CAST(2 * k + 1 AS BIGINT), 400)) AS m FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS k FROM d WHERE length(h) >= 400)),
again AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
hit AS (SELECT r, k, CASE WHEN k > lag(k) OVER (PARTITION BY r ORDER BY k) + 200 THEN 1 ELSE 0 END AS new FROM w SEMI JOIN again USING (m)),
spans AS (SELECT r, min(k) AS a, max(k) + 200 AS b FROM (SELECT r, k, sum(new) OVER (PARTITION BY r ORDER BY k) AS s FROM hit) GROUP BY r, s),
gaps AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS prior FROM spans),
cut AS (SELECT r, sum(b - a) AS gone, count(*) AS n, string_agg(substr(h, CAST(2 * prior + 1 AS BIGINT), CAST(2 * (a - prior) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS kept
        FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)"""

NEAR = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D ]+') AS w FROM documents),
n AS (SELECT text, min(doc_id) AS node, any_value(w) AS w FROM d WHERE len(w) > 0 GROUP BY text),
g AS (SELECT node, array_to_string(w[k : k + 4], ' ') AS g, count(*) AS c FROM (SELECT node, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM n) GROUP BY ALL),
t AS (SELECT node, sum(c) AS t FROM g GROUP BY 1),
p AS (SELECT a.node AS u, b.node AS v, sum(least(a.c, b.c)) AS common FROM g a JOIN g b ON a.g = b.g AND a.node < b.node GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN t x ON x.node = u JOIN t y ON y.node = v WHERE common >= 0.8 * (x.t + y.t - common)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach AS (SELECT node AS a, node AS b FROM n UNION SELECT a, v FROM reach JOIN e ON b = u),
c AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a)
SELECT doc_id, CASE WHEN len(d.w) = 0 OR doc_id IS NULL THEN doc_id ELSE class_id END AS class_id FROM d LEFT JOIN n ON d.text = n.text LEFT JOIN c ON c.a = n.node"""

LEAKS = f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[k : k + 9], ' ') AS x
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM items WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
places AS (SELECT r, size, k, array_to_string(w[k : k + size - 1], ' ') AS x
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
hits AS (SELECT r, size, k, x FROM places SEMI JOIN windows USING (x, size)),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(k, k + size)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits JOIN windows USING (x, size)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""


def _crc_table() -> str:
    """The 256 entries of the reflected polynomial 0xEDB88320, from its rule."""
    out = []
    for k in range(256):
        for _ in range(8):
            k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
        out.append(k)
    return f"[{', '.join(map(str, out))}]"


_FEATURES = (
    "SELECT {0}, w[k] AS f FROM {1} UNION ALL SELECT {0}, w[k] || ' ' || w[k + 1] FROM {1} WHERE k < len(w)"
    " UNION ALL SELECT {0}, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] FROM {1} WHERE k < len(w) - 1"
)

DRAW = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
dk AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d),
bk AS (SELECT 0 AS r, w, unnest(range(1, len(w) + 1)) AS k FROM b),
df AS MATERIALIZED (SELECT r, f, count(*) AS n FROM ({_FEATURES.format("r", "dk")}) GROUP BY ALL),
bf AS MATERIALIZED (SELECT f, count(*) AS n FROM ({_FEATURES.format("r", "bk")}) GROUP BY ALL),
known AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
crc AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(h) // 2), lambda k: CAST('0x' || substr(h, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))),
  lambda c, x: xor(c >> 8, {_crc_table()}[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM known),
ds AS MATERIALIZED (SELECT r, bucket, sum(n) AS n FROM df JOIN crc USING (f) GROUP BY ALL),
s AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS s FROM ds GROUP BY 1),
t AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS t FROM bf JOIN crc USING (f) GROUP BY 1),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s, (SELECT coalesce(sum(t), 0) FROM t) AS t),
gain AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.t, 0) + 1) * (total.s + 10000) / ((s.s + 1) * (total.t + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket), total),
weights AS (SELECT r, sum(n) AS n, sum(n * g) AS w FROM ds JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(d.w) >= 20 AS eligible, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weights.w, 0) AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN weights USING (r)),
noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id NULLS LAST) AS p, count(*) FILTER (WHERE eligible) OVER () AS total FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND p <= 5 * total // 100 THEN p END AS rank FROM ranked"""

AUDIT = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT doc_id, max(quality) AS good, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask,
  CAST(coalesce(l.good = 1, false) AS INT) AS good, CAST(coalesce(l.toxic = 1, false) AS INT) AS toxic FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, CAST(list_sum(list_transform(string_split(substr(filter_order, 1, step), ''), lambda y: 1 << (ascii(y) - 65))) AS INT) AS upto
  FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
b AS (SELECT *, 1 << (ascii(filter) - 65) AS bit, upto - (1 << (ascii(filter) - 65)) AS prior FROM s),
c AS (SELECT part, filter_order, step, filter,
  sum(n) FILTER (WHERE mask & upto = 0) AS kept, sum(n) FILTER (WHERE mask & prior = 0 AND mask & bit <> 0) AS removed,
  sum(n) FILTER (WHERE mask & prior <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
  sum(good) FILTER (WHERE mask & prior = 0 AND mask & bit <> 0) AS good_lost, sum(toxic) FILTER (WHERE mask & prior = 0 AND mask & bit <> 0) AS toxic_lost
  FROM m, b GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter), 0) AS BIGINT) AS shapley FROM c"""
