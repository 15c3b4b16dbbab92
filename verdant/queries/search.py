"""Vector, lexical, fused and combined retrieval for all benchmark items over all active chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant.functions import vectors as vx
from verdant.operators import search, vectors
from verdant.queries import standins as st
from verdant.queries.registry import query, table

EMB = "embedding::DOUBLE[]"


@query("l2_normalise", f"""SELECT vec_id, round(list_sum(u), 9) AS total, round(u[1], 9) AS first_value, round(sqrt(list_sum([x * x for x in u])), 9) AS length
FROM (SELECT vec_id, [x / n for x in v] AS u FROM (SELECT vec_id, [y * 3 for y in {EMB}] AS v, sqrt(list_sum([y * 3 * y * 3 for y in {EMB}])) AS n FROM embeddings))""")
def _(spark, sf):
    unit = vx.l2_normalise(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3.0))
    df = table(spark, sf, "embeddings").select("vec_id", unit.alias("u"))
    return df.select(
        "vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 9).alias("total"),
        F.round(F.element_at("u", 1), 9).alias("first_value"), F.round(vx.norm(F.col("u")), 9).alias("length"),
    )


# query vectors: the mean vector of each label, from the whole table
CENTROIDS = f"""flat AS (SELECT label, unnest({EMB}) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
mid AS (SELECT label, i, round(avg(x), 6) AS m FROM flat GROUP BY 1, 2),
centroids AS (SELECT label::BIGINT AS query_id, list(m ORDER BY i) AS embedding FROM mid GROUP BY 1)"""


def centroids(spark, sf):
    flat = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mid = flat.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    # 64 entries per label
    listed = mid.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("s"))
    return listed.select(F.col("label").cast("long").alias("query_id"), F.col("s.m").alias("embedding"))


@query("cosine_similarity", f"""WITH {CENTROIDS} SELECT vec_id, label, round(list_cosine_similarity(e.{EMB}, c.embedding), 9) AS cosine
FROM embeddings e JOIN centroids c ON c.query_id = e.label""")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").withColumnRenamed("embedding", "v").join(
        centroids(spark, sf), F.col("label") == F.col("query_id")
    )
    return rows.select("vec_id", "label", F.round(vx.cosine(F.col("v"), F.col("embedding")), 9).alias("cosine"))


@query("vector_search", f"""WITH {CENTROIDS},
s AS (SELECT query_id, vec_id AS chunk_id, round(list_dot_product(c.embedding, e.{EMB}), 9) AS score FROM centroids c, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM r WHERE rank <= 3 AND (score >= 0.4 OR rank = 1)""")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return vectors.search_naive(centroids(spark, sf), rows)


@query("chunk_vector_search", f"""WITH RECURSIVE {st.EMBEDDED},
s AS (SELECT query_id, chunk_id, round(list_dot_product(q.embedding, c.embedding), 9) AS score FROM questions q, embedded c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 3)
SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM r WHERE score >= 0.95""")
def _(spark, sf):
    return vectors.search_naive(st.questions(spark, sf), st.embedded_chunks(spark, sf), 3, threshold=0.95)


STATS = f"""
toks AS MATERIALIZED (SELECT chunk_id, {st.tokens_sql('text')} AS t FROM embedded),
post AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf, any_value(n) AS length FROM (SELECT chunk_id, len(t) AS n, unnest(t) AS term FROM toks) GROUP BY 1, 2),
totals AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM toks),
freq AS MATERIALIZED (SELECT term, count(*)::DOUBLE AS df, ln(((SELECT n FROM totals) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM post GROUP BY 1)"""


@query("corpus_statistics", f"WITH RECURSIVE {st.EMBEDDED}, {STATS} SELECT term, df, round(idf, 9) AS idf FROM freq")
def _(spark, sf):
    stats = search.corpus_statistics(st.embedded_chunks(spark, sf))
    return stats.frequencies.select("term", "df", F.round("idf", 9).alias("idf"))


def _bm25_sql(source: str, keys: str) -> str:
    return f"""
asked AS (SELECT {keys}, term, count(*) AS times FROM (SELECT {keys}, unnest({st.tokens_sql('text')}) AS term FROM {source}) GROUP BY ALL),
bm AS MATERIALIZED (SELECT {keys}, chunk_id, round(sum(times * idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * (length / (SELECT avgdl FROM totals)))))), 9) AS score
  FROM asked JOIN freq USING (term) JOIN post USING (term) GROUP BY ALL),
lowest AS (SELECT chunk_id FROM embedded ORDER BY chunk_id LIMIT 15),
padded AS (SELECT {keys}, chunk_id, max(score) AS score FROM (SELECT * FROM bm UNION ALL SELECT {keys}, chunk_id, 0 FROM {source}, lowest) GROUP BY ALL),
sparse AS MATERIALIZED (SELECT {keys}, chunk_id, score, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, chunk_id) AS rank FROM padded QUALIFY rank <= 15)"""


@query("bm25_ranked", f"WITH RECURSIVE {st.EMBEDDED}, {STATS}, {_bm25_sql('questions', 'query_id')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM sparse")
def _(spark, sf):
    stats = search.corpus_statistics(st.embedded_chunks(spark, sf))
    ranked = search.bm25_ranked(st.questions(spark, sf), stats, ["query_id"])
    return ranked.withColumn("score", F.round("score", 6))


VARIANTS = f"""
qt AS (SELECT query_id, text, {st.tokens_sql('text')} AS t FROM questions),
variants0 AS (SELECT query_id, 0 AS variant, text FROM qt UNION ALL SELECT query_id, 1, array_to_string(t[1:4], ' ') FROM qt WHERE len(t) >= 3
  UNION ALL SELECT query_id, 2, array_to_string(t[greatest(1, len(t) - 3):len(t)], ' ') FROM qt WHERE len(t) >= 3),
variants AS MATERIALIZED (SELECT query_id, variant, text, {st._profile_sql('text')} AS embedding FROM variants0)"""


def variants(spark, sf):
    """Variants with their own vectors."""
    return search.query_variants(st.questions(spark, sf)).withColumn("embedding", st.letter_profile(F.col("text")))


@query("query_variants", f"WITH RECURSIVE {st.EMBEDDED}, {VARIANTS} SELECT query_id, variant, text FROM variants")
def _(spark, sf):
    return search.query_variants(st.questions(spark, sf))


FUSED = f"""{VARIANTS}, {STATS}, {_bm25_sql('variants', 'query_id, variant')},
dense0 AS (SELECT query_id, variant, chunk_id, round(list_dot_product(v.embedding, c.embedding), 9) AS score FROM variants v, embedded c),
dense AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, chunk_id) AS rank FROM dense0 QUALIFY rank <= 15),
lists AS (SELECT query_id, variant, 'dense' AS kind, chunk_id, rank FROM dense UNION ALL SELECT query_id, variant, 'sparse', chunk_id, rank FROM sparse),
fused0 AS (SELECT query_id, chunk_id, round(sum(1::DOUBLE / (60 + rank)), 12) AS fused FROM lists GROUP BY 1, 2),
fused AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS place FROM fused0 QUALIFY place <= 24)"""


@query("ranked_lists", f"WITH RECURSIVE {st.EMBEDDED}, {FUSED} SELECT * FROM lists")
def _(spark, sf):
    return search.ranked_lists(variants(spark, sf), st.embedded_chunks(spark, sf)).select("query_id", "variant", "kind", "chunk_id", "rank")


@query("reciprocal_rank_fusion", f"WITH RECURSIVE {st.EMBEDDED}, {FUSED} SELECT query_id, chunk_id, round(fused, 9) AS fused, place FROM fused")
def _(spark, sf):
    fused = search.fuse(search.ranked_lists(variants(spark, sf), st.embedded_chunks(spark, sf)))
    return fused.withColumn("fused", F.round("fused", 9))


CHOSEN = f"""{FUSED},
cand AS MATERIALIZED (SELECT f.query_id, f.chunk_id, place, c.embedding, list_cosine_similarity(q.embedding, c.embedding) AS rel, list_dot_product(q.embedding, c.embedding) AS dense
  FROM fused f JOIN embedded c USING (chunk_id) JOIN questions q ON q.query_id = f.query_id),
alike AS MATERIALIZED (SELECT a.query_id, a.chunk_id AS x, b.chunk_id AS y, list_cosine_similarity(a.embedding, b.embedding) AS sim FROM cand a JOIN cand b USING (query_id)),
greedy AS (
  SELECT query_id, 1 AS step, [arg_max(chunk_id, (round(rel, 9), -place))] AS picked FROM cand GROUP BY 1
  UNION ALL
  SELECT query_id, step + 1, list_append(picked, best) FROM (
    SELECT g.query_id, g.step, g.picked, arg_max(s.chunk_id, (round(0.65::DOUBLE * s.rel - (1 - 0.65::DOUBLE) * (SELECT max(sim) FROM alike WHERE alike.query_id = s.query_id AND alike.x = s.chunk_id AND list_contains(g.picked, alike.y)), 9), -s.place)) AS best
    FROM greedy g JOIN cand s ON s.query_id = g.query_id AND NOT list_contains(g.picked, s.chunk_id) WHERE g.step < 10 GROUP BY 1, 2, 3)),
chosen AS MATERIALIZED (SELECT query_id, unnest(picked) AS chunk_id FROM (SELECT query_id, arg_max(picked, step) AS picked FROM greedy GROUP BY 1))"""


@query("mmr_selection", f"WITH RECURSIVE {st.EMBEDDED}, {CHOSEN} SELECT query_id, chunk_id FROM chosen")
def _(spark, sf):
    rows, asked = st.embedded_chunks(spark, sf), st.questions(spark, sf)
    pool = search.fuse(search.ranked_lists(variants(spark, sf), rows))
    return search.diversify(pool, rows, asked)


ADVANCED = f"""{CHOSEN},
words AS (SELECT c.query_id, c.chunk_id, list_distinct({st.tokens_sql('q.text')}) AS qw, {st.tokens_sql('e.text')} AS ew, q.text AS qtext, e.text AS etext, dense
  FROM chosen c JOIN questions q ON q.query_id = c.query_id JOIN embedded e ON e.chunk_id = c.chunk_id JOIN cand ON cand.query_id = c.query_id AND cand.chunk_id = c.chunk_id),
rerank AS (SELECT query_id, chunk_id, round(0.60::DOUBLE * dense + 0.25::DOUBLE * CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, ew)) / len(qw) ELSE 0 END
    + CASE WHEN contains(lower(etext), lower(qtext)) THEN 0.15 ELSE 0 END, 9) AS score FROM words),
advanced AS MATERIALIZED (SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM rerank) WHERE rank <= 4 AND (score >= 0.4 OR rank = 1))"""


@query("advanced_search", f"WITH RECURSIVE {st.EMBEDDED}, {ADVANCED} SELECT * FROM advanced")
def advanced_query(spark, sf):
    return search.search_advanced(st.questions(spark, sf), variants(spark, sf), st.embedded_chunks(spark, sf))


NAIVE = """
vec AS (SELECT query_id, chunk_id, round(list_dot_product(q.embedding, c.embedding), 9) AS score FROM questions q, embedded c),
naive AS MATERIALIZED (SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vec QUALIFY rank <= 4) WHERE score >= 0.4 OR rank = 1)"""
HITS = """
once AS (SELECT query_id, chunk_id, arg_min(score, src) AS score, CASE WHEN min(src) = 0 THEN 'advanced' ELSE 'naive' END AS strategy
  FROM (SELECT query_id, chunk_id, score, 0 AS src FROM advanced UNION ALL SELECT query_id, chunk_id, score, 1 FROM naive) GROUP BY 1, 2),
hits AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, strategy, chunk_id) AS rank FROM once QUALIFY rank <= 4)"""


def hits(spark, sf):
    rows, asked = st.embedded_chunks(spark, sf), st.questions(spark, sf)
    advanced = search.search_advanced(asked, variants(spark, sf), rows)
    return rows, search.union_hits(advanced, vectors.search_naive(asked, rows, 4), 4)


@query("retrieval_union", f"WITH RECURSIVE {st.EMBEDDED}, {ADVANCED}, {NAIVE}, {HITS} SELECT query_id, chunk_id, score, strategy, rank FROM hits")
def _(spark, sf):
    return hits(spark, sf)[1]


@query("context_assembly", f"""WITH RECURSIVE {st.EMBEDDED}, {ADVANCED}, {NAIVE}, {HITS}
SELECT query_id, string_agg('[Manba: ''' || document_name || ''', ' || page_number || '-bet (Score: ' || CAST(round(score::DECIMAL(10, 4), 2) AS DECIMAL(10, 2)) || ')]' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS sources
FROM hits JOIN embedded USING (chunk_id) GROUP BY 1""")
def _(spark, sf):
    rows, found = hits(spark, sf)
    return search.assemble_context(found, rows).select("query_id", "context", F.size("sources").alias("sources"))
