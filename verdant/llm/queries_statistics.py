"""Queries of the operators that weigh and compare: importance resampling, exact top-k search, divergence audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant.llm import divergence, importance, topk
from verdant.llm.registry import query, table

# crc32 of a word, byte by byte, from the polynomial's table; computed once per distinct word.
_IMPORTANCE_SQL = r"""WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, [0,0,0,0,0,0,0,0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, unnest(ws) AS word FROM d),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM w UNION SELECT word FROM b)),
bytes AS (SELECT word, list_transform(range(1, length(h), 2), lambda i: 16 * (strpos('0123456789ABCDEF', substr(h, i, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, i + 1, 1)) - 1) AS bs FROM v),
crc AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bs::BIGINT[]), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
s AS (SELECT bucket, count(*) AS s FROM w JOIN crc USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM b JOIN crc USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM w) AS sn, (SELECT count(*) FROM b) AS tn),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sn + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tn + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), sums),
x AS (SELECT rid, count(*) AS n, sum(gain) AS weight FROM w JOIN crc USING (word) JOIN g USING (bucket) GROUP BY rid),
r AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN x USING (rid)),
z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM o"""


@query("op11_importance_resampling", _IMPORTANCE_SQL)
def _(spark, sf):
    found = importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_TOPK_SQL = r"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x, row_number() OVER () AS rid FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON c.rid <> q.rid WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""


@query("op12_exact_top_k_search", _TOPK_SQL)
def _(spark, sf):
    return topk.search(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


_DIVERGENCE_SQL = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT lang, source, rid, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS m FROM k GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(any_value(v), 0) AS v, coalesce(any_value(m), 0) AS m FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN l USING (lang) GROUP BY ALL),
z AS (SELECT g.lang, g.source, g.v, g.m, coalesce(sum(n), 0)::HUGEINT AS s FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT z.lang, z.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (s + 2 * v) AS p, 1 + 1000000000::HUGEINT * (total + 2) // (m + 2 * v) AS q
  FROM z JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM r QUALIFY part = 'pair' OR rank <= 10"""


@query("op13_source_divergence_audit", _DIVERGENCE_SQL)
def _(spark, sf):
    return divergence.audit(table(spark, sf, "documents"))
