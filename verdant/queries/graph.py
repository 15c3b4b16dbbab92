"""Knowledge graph and combined retrieval; the dictionary is a parameter table of frequent words."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant import constants as K
from verdant.operators import graph
from verdant.plans import retrieval
from verdant.queries import search as sq
from verdant.queries import standins as st
from verdant.queries.registry import query, table
from verdant.session import cut_lineage

DICTIONARY = (
    ("the|and|this|that|with|have", "English", "the words of that language"),
    ("der|die|und|nicht|auf", "German", "the other words"),
    ("las|los|del|que|con", "Spanish", "palabras de la lengua"),
    ("les|des|dans|pour|est|que", "French", "mots de la langue"),
)

_FOUND = " UNION ALL ".join(
    rf"SELECT document_id, document_name, chunk_id, {i} AS place, {st.sql_text(kind)} AS type, {st.sql_text(text)} AS description, "
    rf"unnest(regexp_extract_all(s, '(?i)(?:^|[^\pL\pN_])({words})(?:[^\pL\pN_]|$)', 1)) AS w FROM spaced"
    for i, (words, kind, text) in enumerate(DICTIONARY)
)
GRAPH = rf"""
spaced AS (SELECT document_id, document_name, chunk_id, ' ' || regexp_replace(text, '([^\pL\pN_])', '\1\1', 'g') || ' ' AS s FROM embedded),
raw AS ({_FOUND}),
mention AS MATERIALIZED (SELECT document_id, document_name, chunk_id, upper(w[1]) || lower(w[2:]) AS name, min(place) AS place, arg_min(type, place) AS type, arg_min(description, place) AS description
  FROM raw GROUP BY 1, 2, 3, 4),
books AS (SELECT DISTINCT document_id, document_name FROM embedded),
nodes AS MATERIALIZED (SELECT document_id, name AS node_id, arg_min(type, place) AS type, arg_min(description, place) AS description FROM mention GROUP BY 1, 2
  UNION ALL SELECT document_id, document_name, {st.sql_text(K.DOCUMENT_NODE[0])}, {st.sql_text(K.DOCUMENT_NODE[1])} || document_name FROM books),
placed AS (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_id ORDER BY place, name) AS i FROM mention),
edges AS MATERIALIZED (SELECT DISTINCT document_id, document_name AS source, name AS target, {st.sql_text(K.CONTAINS_EDGE[0])} AS type, {st.sql_text(K.CONTAINS_EDGE[1])} AS description FROM mention
  UNION ALL SELECT DISTINCT a.document_id, a.name, b.name, {st.sql_text(K.RELATED_EDGE[0])}, a.name || ' va ' || b.name || {st.sql_text(K.RELATED_EDGE[1].split('%s')[2])}
  FROM placed a JOIN placed b ON a.document_id = b.document_id AND a.chunk_id = b.chunk_id AND b.i - a.i BETWEEN 1 AND 3)"""


def parts(spark, sf):
    rows = st.embedded_chunks(spark, sf)
    return rows, *graph.extract(rows, DICTIONARY)


@query("graph_nodes", f"WITH RECURSIVE {st.EMBEDDED}, {GRAPH} SELECT * FROM nodes")
def _(spark, sf):
    return graph.extract_nodes(st.text_chunks(spark, sf), DICTIONARY)


@query("graph_edges", f"WITH RECURSIVE {st.EMBEDDED}, {GRAPH} SELECT * FROM edges")
def _(spark, sf):
    return graph.extract_edges(st.text_chunks(spark, sf), DICTIONARY)


@query("graph_refresh", f"""WITH RECURSIVE {st.EMBEDDED}, {GRAPH} SELECT document_id, node_id, CASE WHEN document_id IN (SELECT doc_id FROM labels) THEN 'refreshed' ELSE type END AS type FROM nodes
WHERE NOT (document_id IN (SELECT doc_id FROM labels) AND type <> {st.sql_text(K.DOCUMENT_NODE[0])})""")
def _(spark, sf):
    # read three times: as the stored rows, for the refreshed ones and for their documents
    nodes = cut_lineage(graph.extract_nodes(st.text_chunks(spark, sf), DICTIONARY).drop("description"))

    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"))
    fresh = nodes.filter(F.col("type") == K.DOCUMENT_NODE[0]).join(labelled, "document_id", "left_semi").withColumn("type", F.lit("refreshed"))
    return graph.refresh(nodes, fresh)


_SCORES = f"""
qtok AS MATERIALIZED (SELECT query_id, {st.tokens_sql('text')} AS t FROM questions),
qn AS (SELECT query_id, len(t) AS n, unnest(t) AS token FROM qtok),
texts0 AS (SELECT node_id AS text FROM nodes UNION SELECT description FROM nodes UNION SELECT source FROM edges UNION SELECT target FROM edges UNION SELECT type FROM edges UNION SELECT description FROM edges),
texts AS (SELECT text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm FROM texts0),
overlap AS MATERIALIZED (SELECT query_id, text, sum(CASE WHEN contains(norm, token) THEN 1 WHEN length(token) >= 4 AND contains(norm, substr(token, 1, floor(length(token) * 0.65)::INTEGER)) THEN 0.5 ELSE 0 END)::DOUBLE / any_value(n) AS o
  FROM qn, texts GROUP BY 1, 2 HAVING o > 0),
node_kinds AS (SELECT node_id, type, description, min(document_id) AS document_id FROM nodes GROUP BY 1, 2, 3),
edge_kinds AS (SELECT source, target, type, description, min(document_id) AS document_id FROM edges GROUP BY 1, 2, 3, 4),
node_scores AS MATERIALIZED (SELECT q.query_id, document_id, node_id, type, description, round(coalesce(a.o, 0) * 1.5 + coalesce(b.o, 0), 9) AS score FROM nodes_scored CROSS JOIN (SELECT query_id FROM questions) q
  LEFT JOIN overlap a ON a.query_id = q.query_id AND a.text = node_id LEFT JOIN overlap b ON b.query_id = q.query_id AND b.text = description
  WHERE round(coalesce(a.o, 0) * 1.5 + coalesce(b.o, 0), 9) >= 0.2),
edge_scores AS MATERIALIZED (SELECT * FROM (SELECT q.query_id, document_id, source, target, k.type, k.description, round(greatest(coalesce(s.o, 0), coalesce(t.o, 0)) + coalesce(y.o, 0) + 0.5 * coalesce(d.o, 0), 9) AS score
  FROM edges_scored k CROSS JOIN (SELECT query_id FROM questions) q LEFT JOIN overlap s ON s.query_id = q.query_id AND s.text = source LEFT JOIN overlap t ON t.query_id = q.query_id AND t.text = target
  LEFT JOIN overlap y ON y.query_id = q.query_id AND y.text = k.type LEFT JOIN overlap d ON d.query_id = q.query_id AND d.text = k.description) WHERE score >= 0.2)"""
SCORES = _SCORES.replace("nodes_scored", "node_kinds").replace("edges_scored", "edge_kinds")
#: The same with a score in every document that holds the node or edge, not in the first of them only.
ALL_SCORES = _SCORES.replace("nodes_scored", "nodes").replace("edges_scored", "edges")


def scored(spark, sf):
    nodes, edges = graph.extract(st.text_chunks(spark, sf), DICTIONARY)
    texts = nodes.select(F.explode(F.array("node_id", "description")).alias("text")).unionByName(
        edges.select(F.explode(F.array("source", "target", "type", "description")).alias("text"))
    )
    return nodes, edges, *graph.text_classes(st.questions(spark, sf), texts)


@query("graph_node_scores", f"WITH RECURSIVE {st.EMBEDDED}, {GRAPH}, {ALL_SCORES} SELECT query_id, document_id, node_id, type, round(score, 6) AS score FROM node_scores")
def _(spark, sf):
    nodes, _, members, overlaps = scored(spark, sf)
    return graph.score_nodes(nodes, members, overlaps).select("query_id", "document_id", "node_id", "type", F.round("score", 6).alias("score"))


@query("graph_edge_scores", f"""WITH RECURSIVE {st.EMBEDDED}, {GRAPH}, {ALL_SCORES}
SELECT query_id, document_id, source, target, type, description, round(score, 6) AS score FROM edge_scores""")
def _(spark, sf):
    _, edges, members, overlaps = scored(spark, sf)
    return graph.score_edges(edges, members, overlaps).withColumn("score", F.round("score", 6))


def _step(n: int, cap: int) -> str:
    """One level of the queue: ``wait`` holds who waits at which place; a node is taken while fewer than ``cap`` nodes are in."""
    wait, known = f"wait{n - 1}", f"in{n - 1}"
    return f"""
reach{n} AS MATERIALIZED (SELECT w.query_id, w.document_id, spot, neighbour, source, target, type FROM {wait} w JOIN links USING (document_id, node_id)),
first{n} AS MATERIALIZED (SELECT query_id, document_id, neighbour AS node_id, min(spot) AS parent FROM reach{n} r
  WHERE NOT EXISTS (SELECT 1 FROM {known} x WHERE x.query_id = r.query_id AND x.document_id = r.document_id AND x.node_id = r.neighbour) GROUP BY 1, 2, 3),
size{n} AS (SELECT query_id, document_id, count(*) AS held FROM {known} GROUP BY 1, 2),
taken{n} AS MATERIALIZED (SELECT w.query_id, w.document_id, w.spot FROM {wait} w JOIN size{n} s USING (query_id, document_id)
  WHERE held + (SELECT count(*) FROM first{n} f WHERE f.query_id = w.query_id AND f.document_id = w.document_id AND f.parent < w.spot) < {cap}),
touch{n} AS (SELECT DISTINCT r.query_id, r.document_id, source, target, type FROM reach{n} r JOIN taken{n} USING (query_id, document_id, spot)),
new{n} AS MATERIALIZED (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY query_id, document_id ORDER BY parent, node_id) AS spot FROM first{n} f) JOIN size{n} USING (query_id, document_id) WHERE held + spot <= {cap}),
wait{n} AS MATERIALIZED (SELECT query_id, document_id, node_id, spot FROM new{n}),
in{n} AS MATERIALIZED (SELECT * FROM {known} UNION ALL SELECT query_id, document_id, node_id, 0::DOUBLE, {n} FROM new{n})"""


def expanded_sql(cap: int = K.BFS_NODES) -> str:
    return f"""
best_nodes AS MATERIALIZED (SELECT * FROM node_scores QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY score DESC, document_id) = 1),
hit_edges AS (SELECT s.query_id, e.document_id, e.source, e.target FROM edges e JOIN edge_scores s ON s.source = e.source AND s.target = e.target AND s.type = e.type AND s.description = e.description),
in0 AS MATERIALIZED (SELECT query_id, document_id, node_id, max(score) AS score, 0 AS depth FROM (SELECT query_id, document_id, node_id, score FROM best_nodes
  UNION ALL SELECT query_id, document_id, source, 0 FROM hit_edges UNION ALL SELECT query_id, document_id, target, 0 FROM hit_edges) GROUP BY 1, 2, 3),
links AS MATERIALIZED (SELECT document_id, source AS node_id, target AS neighbour, source, target, type FROM edges UNION ALL SELECT document_id, target, source, source, target, type FROM edges),
wait0 AS MATERIALIZED (SELECT query_id, document_id, node_id, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, node_id) AS spot FROM in0),
{_step(1, cap)}, {_step(2, cap)},
nodes2 AS (SELECT * FROM in2),
touched AS MATERIALIZED (SELECT * FROM touch1 UNION SELECT * FROM touch2)"""


EXPANDED = expanded_sql()
SMALL_CAP = 4  # fills up in the middle of a level in many documents


def _expansion_sql(cap: int) -> str:
    return f"""WITH RECURSIVE {st.EMBEDDED}, {GRAPH}, {SCORES}, {expanded_sql(cap)}
SELECT query_id, document_id, 'node' AS kind, node_id AS name, '' AS target, '' AS type, depth FROM nodes2
UNION ALL SELECT query_id, document_id, 'edge', source, target, type, 0 FROM touched"""


def _expansion(spark, sf, cap):
    nodes, edges, members, overlaps = scored(spark, sf)
    rows = graph.classed(edges, members, graph.LINKED)
    starts, asked = graph.shared_starts(graph.score_nodes(graph.first_nodes(nodes), members, overlaps), rows, graph.score_edge_classes(rows, overlaps))
    walked = graph.walk(starts, edges, cap=cap)

    def listed(part, kind, **columns):
        return F.transform(part, lambda v: F.struct(F.lit(kind).alias("kind"), *[(F.lit(c) if c in ("", 0) else v[c]).alias(n) for n, c in columns.items()]))

    found = F.concat(listed("nodes", "node", name="node_id", target="", type="", depth="depth"), listed("touched", "edge", name="source", target="target", type="type", depth=0))
    found = walked.select("document_id", "hits", found.alias("found")).select("document_id", F.explode("hits").alias("hit"), "found")
    return found.join(asked, "hit").select("query_id", "document_id", F.inline("found"))


@query("graph_expansion", _expansion_sql(K.BFS_NODES))
def _(spark, sf):
    return _expansion(spark, sf, K.BFS_NODES)


@query("graph_expansion_small_cap", _expansion_sql(SMALL_CAP))
def _(spark, sf):
    return _expansion(spark, sf, SMALL_CAP)


_NODE = "'[Ob''ekt] ' || node_id || ' | turi: ' || type || ' | tavsif: ' || description"
_EDGE = "'[Munosabat] ' || source || ' --[' || type || ']--> ' || target || ' | izoh: ' || description"
CONTEXT = f"""
detail AS (SELECT node_id, arg_min(type, document_id) AS type, arg_min(description, document_id) AS description FROM nodes GROUP BY 1),
final AS (SELECT query_id, node_id, score, type, description FROM best_nodes UNION ALL
  SELECT DISTINCT v.query_id, v.node_id, 0, d.type, d.description FROM nodes2 v JOIN detail d USING (node_id) WHERE NOT EXISTS (SELECT 1 FROM best_nodes b WHERE b.query_id = v.query_id AND b.node_id = v.node_id)),
node_lines AS (SELECT query_id, 0 AS part, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rn, {_NODE} AS line FROM final QUALIFY rn <= 15),
kinds AS (SELECT DISTINCT query_id, source, target, type FROM touched),
edge_texts AS (SELECT source, target, type, arg_min(description, document_id) AS description FROM edges GROUP BY 1, 2, 3),
edge_lines AS (SELECT query_id, 1 AS part, rn, {_EDGE} AS line FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source, target, type) AS rn FROM kinds QUALIFY rn <= 15) JOIN edge_texts USING (source, target, type)),
context AS MATERIALIZED (SELECT query_id, string_agg(line, chr(10) ORDER BY part, rn) AS graph_context FROM (SELECT * FROM node_lines UNION ALL SELECT * FROM edge_lines) GROUP BY 1)"""


@query("graph_context", f"WITH RECURSIVE {st.EMBEDDED}, {GRAPH}, {SCORES}, {EXPANDED}, {CONTEXT} SELECT * FROM context")
def _(spark, sf):
    nodes, edges = graph.extract(st.text_chunks(spark, sf), DICTIONARY)
    return graph.search_graph(st.questions(spark, sf), nodes, edges)


@query("graph_search", f"""WITH RECURSIVE {st.EMBEDDED}, {GRAPH}, {SCORES}, {EXPANDED}, {CONTEXT}, {sq.ADVANCED}
SELECT q.query_id, md5(graph_context) AS context_digest, chunk_id FROM questions q LEFT JOIN context c USING (query_id)
LEFT JOIN (SELECT query_id, chunk_id FROM advanced WHERE rank <= 2 AND query_id NOT IN (SELECT query_id FROM context)) USING (query_id)""")
def _(spark, sf):
    rows, nodes, edges = parts(spark, sf)
    asked = st.questions(spark, sf)
    context, chunks = retrieval.graph_or_chunks(asked, sq.variants(spark, sf), rows, nodes, edges)
    return asked.select("query_id").join(context, "query_id", "left").join(chunks, "query_id", "left").select(
        "query_id", F.md5("graph_context").alias("context_digest"), "chunk_id"
    )


_ALL = f"{st.EMBEDDED}, {GRAPH}, {SCORES}, {EXPANDED}, {CONTEXT}, {sq.ADVANCED}, {sq.NAIVE}, {sq.HITS}"
_STRATEGY = """CASE WHEN n > 0 AND length(trim(graph_context)) > 20 THEN 'all_in_one' WHEN n > 0 THEN 'advanced' WHEN length(trim(graph_context)) > 20 THEN 'graph' ELSE 'direct_llm' END"""


@query("combined_search", f"""WITH RECURSIVE {_ALL}, h AS (SELECT query_id, count(*) AS n, max(score) AS top_score FROM hits GROUP BY 1)
SELECT query_id, {_STRATEGY} AS strategy, coalesce(n, 0) AS hits, coalesce(top_score, 0) AS top_score, md5(graph_context) AS context_digest
FROM questions LEFT JOIN h USING (query_id) LEFT JOIN context USING (query_id)""")
def _(spark, sf):
    rows, nodes, edges = parts(spark, sf)
    summary = retrieval.search_all(st.questions(spark, sf), sq.variants(spark, sf), rows, nodes, edges)[1]
    return summary.select("query_id", "strategy", "hits", "top_score", F.md5("graph_context").alias("context_digest"))


_MODES = f"[{st.sql_list(K.RAG_MODES)}][query_id % 6 + 1]"


@query("search_by_mode", f"""WITH RECURSIVE {_ALL}, h AS (SELECT query_id, count(*) AS n FROM hits GROUP BY 1),
m AS (SELECT query_id, {_MODES} AS mode FROM questions),
vec3 AS (SELECT query_id, chunk_id, rank FROM naive WHERE rank <= 3)
SELECT query_id, mode, CASE mode WHEN 'naive' THEN 'naive' WHEN 'graph' THEN CASE WHEN graph_context IS NOT NULL THEN 'graph' ELSE 'direct_llm' END WHEN 'direct_llm' THEN 'direct_llm'
  WHEN 'all_in_one' THEN {_STRATEGY} ELSE 'advanced' END AS strategy,
  coalesce(CASE WHEN mode IN ('advanced', 'auto') THEN (SELECT string_agg(chunk_id, ',' ORDER BY rank) FROM advanced a WHERE a.query_id = m.query_id)
  WHEN mode = 'naive' THEN (SELECT string_agg(chunk_id, ',' ORDER BY rank) FROM vec3 a WHERE a.query_id = m.query_id)
  WHEN mode = 'all_in_one' THEN (SELECT string_agg(chunk_id, ',' ORDER BY rank) FROM hits a WHERE a.query_id = m.query_id)
  WHEN mode = 'graph' AND graph_context IS NULL THEN (SELECT string_agg(chunk_id, ',' ORDER BY rank) FROM advanced a WHERE a.query_id = m.query_id AND rank <= 2) END, '') AS found
FROM m LEFT JOIN h USING (query_id) LEFT JOIN context USING (query_id)""")
def _(spark, sf):
    rows, nodes, edges = parts(spark, sf)
    mode = F.get(F.array(*[F.lit(m) for m in K.RAG_MODES]), (F.col("query_id") % 6).cast("int"))
    asked = st.questions(spark, sf).withColumn("mode", mode)
    found = retrieval.dispatch(asked, sq.variants(spark, sf), rows, nodes, edges)
    # at most four chunks per query
    listed = found.groupBy("query_id", "mode", "strategy").agg(
        F.sort_array(F.collect_list(F.when(F.col("chunk_id").isNotNull(), F.struct("rank", F.col("chunk_id").cast("string").alias("c"))))).alias("h")
    )
    return listed.select("query_id", "mode", "strategy", F.array_join(F.col("h.c"), ",").alias("found"))
