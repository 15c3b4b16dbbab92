"""Knowledge graph of documents: entities, co-occurrence, scored lookup, expansion, context."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.functions import text as tx
from verdant.operators.store import newest
from verdant.session import cut_lineage

Dictionary = tuple[tuple[str, str, str], ...]


def _mentions(chunks: DataFrame, dictionary: Dictionary) -> DataFrame:
    """(document_id, document_name, chunk_id, place, name, type, description), one row per chunk and name.

    The place is dictionary order; a name two dictionaries know keeps the first.
    """
    found = F.array(
        *[
            F.struct(
                F.lit(i).alias("place"), F.lit(kind).alias("type"), F.lit(text).alias("description"),
                F.array_distinct(F.regexp_extract_all("text", F.lit(rf"(?iuU)\b({words})\b"), F.lit(1))).alias("names"),
            )
            for i, (words, kind, text) in enumerate(dictionary)
        ]
    )
    rows = chunks.select("document_id", "document_name", "chunk_id", F.explode(found).alias("_d")).select(
        "*", F.explode("_d.names").alias("_match")
    )
    match = F.trim("_match")
    name = F.concat(F.upper(F.substring(match, 1, 1)), F.lower(F.substring(match, F.lit(2), F.length(match))))
    named = rows.select("document_id", "document_name", "chunk_id", "_d.place", name.alias("name"), "_d.type", "_d.description")
    keys = ["document_id", "document_name", "chunk_id", "name"]
    return named.groupBy(*keys).agg(F.min(F.struct("place", "type", "description")).alias("_f")).select(*keys, "_f.*")


def extract_nodes(chunks: DataFrame, dictionary: Dictionary = K.ENTITY_DICTIONARY) -> DataFrame:
    """(document_id, node_id, type, description): entities by first dictionary, and the document itself."""
    return _nodes(chunks, _mentions(chunks, dictionary))


def _nodes(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    named = mentions.groupBy("document_id", "name").agg(F.min(F.struct("place", "type", "description")).alias("_f"))
    entities = named.select("document_id", F.col("name").alias("node_id"), "_f.type", "_f.description")
    books = chunks.select("document_id", "document_name").distinct().select(
        "document_id", F.col("document_name").alias("node_id"), F.lit(K.DOCUMENT_NODE[0]).alias("type"),
        F.concat(F.lit(K.DOCUMENT_NODE[1]), "document_name").alias("description"),
    )
    return entities.join(books.select("document_id", "node_id"), ["document_id", "node_id"], "left_anti").unionByName(books)


def extract_edges(chunks: DataFrame, dictionary: Dictionary = K.ENTITY_DICTIONARY) -> DataFrame:
    """(document_id, source, target, type, description), each edge once per document.

    A chunk's entities are ordered by dictionary and name and numbered; their number is bounded by
    the dictionary. An entity is linked to the three after it by a lead over that order.
    """
    return _edges(_mentions(chunks, dictionary))


def _edges(found: DataFrame) -> DataFrame:
    inside = found.select(
        "document_id", F.col("document_name").alias("source"), F.col("name").alias("target"),
        F.lit(K.CONTAINS_EDGE[0]).alias("type"), F.lit(K.CONTAINS_EDGE[1]).alias("description"),
    ).distinct()
    order = Window.partitionBy("document_id", "chunk_id").orderBy("place", "name")
    ahead = found.select("document_id", "name", *[F.lead("name", i).over(order).alias(f"n{i}") for i in (1, 2, 3)])
    pairs = ahead.select("document_id", F.col("name").alias("source"), F.explode(F.array("n1", "n2", "n3")).alias("target"))
    pairs = pairs.filter(F.col("target").isNotNull()).distinct()
    related = pairs.select(
        "*", F.lit(K.RELATED_EDGE[0]).alias("type"), F.format_string(K.RELATED_EDGE[1], "source", "target").alias("description")
    )
    return inside.unionByName(related)


def extract(chunks: DataFrame, dictionary: Dictionary = K.ENTITY_DICTIONARY) -> tuple[DataFrame, DataFrame]:
    """N1 and N2, stored: the texts are searched for the dictionary's words once for both."""
    mentions = cut_lineage(_mentions(chunks, dictionary))
    return cut_lineage(_nodes(chunks, mentions)), cut_lineage(_edges(mentions))


def refresh(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of the refreshed documents replace their stored rows."""
    kept = stored.join(fresh.select("document_id").distinct(), "document_id", "left_anti")
    return kept.unionByName(fresh.select(*stored.columns))


# scoring ---------------------------------------------------------------------------------------


def _needles(queries: DataFrame) -> DataFrame:
    """(query_id, at, token, needle, points): a token scores 1, its leading part one half."""
    tokens = queries.select("query_id", F.posexplode(tx.tokens(F.col("text"))).alias("at", "token"))
    length = F.length("token")
    part = F.when(length >= 4, F.substring(F.col("token"), F.lit(1), F.floor(length * 0.65).cast("int")))
    options = F.array(
        F.struct(F.col("token").alias("needle"), F.lit(1.0).alias("points")), F.struct(part.alias("needle"), F.lit(0.5).alias("points"))
    )
    return tokens.select("query_id", "at", F.explode(options).alias("_o")).select("query_id", "at", "_o.*").filter("needle IS NOT NULL")


def _pieces(c: Column) -> Column:
    """The different pieces of three characters, and of two, that a text contains."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 1))
    return F.array_distinct(F.flatten(F.transform(F.array(F.lit(2), F.lit(3)), lambda n: F.transform(starts, lambda p: F.substring(c, p, n)))))


def text_classes(queries: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text, class) of the texts that hold a query's needle, and (query_id, class, overlap): mean points of the query tokens.

    "Contained in" becomes an equi-join on pieces of three characters (two, for a needle of two): a needle is
    looked up by that of its pieces which the fewest texts hold, and only those texts are compared. A needle
    with a piece that no text holds is dropped at once. Texts are distinct and numbered, so the index
    holds numbers, and repeated nodes cost nothing. Texts that hold the same needles form a class; queries are
    scored against classes, however many texts these have.
    """
    size = queries.select("query_id", F.size(tx.tokens(F.col("text"))).alias("tokens"))
    needles = cut_lineage(_needles(queries))
    normal = texts.select("text").distinct().withColumn("_n", tx.normalise(F.col("text"))).filter("_n <> ''")
    normal = cut_lineage(normal.withColumn("tid", F.monotonically_increasing_id()))
    index = cut_lineage(normal.select("tid", F.explode(_pieces(F.col("_n"))).alias("piece")))
    long = F.filter(_pieces(F.col("needle")), lambda p: F.length(p) == F.least(F.lit(3), F.length("needle")))
    wanted = needles.select("needle").distinct().select("needle", F.explode(long).alias("piece"))
    held = index.join(wanted.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("texts"))
    rarest = wanted.join(held, "piece", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "piece")).alias("_r"))
    near = rarest.filter("_r.texts > 0").select("needle", "_r.piece").join(index, "piece").select("needle", "tid")
    hits = near.join(normal, "tid").filter(F.contains("_n", "needle"))
    listed = cut_lineage(hits.groupBy("tid", "text").agg(F.sort_array(F.collect_list("needle")).alias("needles")))
    classes = cut_lineage(listed.groupBy("needles").agg(F.min("tid").alias("class")))
    members = cut_lineage(listed.join(classes, "needles").select("text", "class"))
    points = classes.select("class", F.explode("needles").alias("needle")).join(needles, "needle")
    points = points.groupBy("query_id", "class", "at").agg(F.max("points").alias("points"))
    summed = points.groupBy("query_id", "class").agg(F.sum("points").alias("points"))
    return members, cut_lineage(summed.join(size, "query_id").select("query_id", "class", (F.col("points") / F.col("tokens")).alias("overlap")))


def text_overlap(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, text, overlap): mean points of the query tokens found in each text."""
    members, overlaps = text_classes(queries, texts)
    return members.join(overlaps, "class").select("query_id", "text", "overlap")


def classed(rows: DataFrame, members: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with the class of the text in each of ``columns`` as ``c_…``; -1 where no query's needle is in it.

    The texts of a column are looked up once each; for a column of few texts that is a table Spark broadcasts.
    """
    for c in columns:
        own = cut_lineage(rows.select(c).distinct().join(members.withColumnRenamed("text", c), c).withColumnRenamed("class", f"c_{c}"))
        rows = rows.join(own, c, "left")
    return cut_lineage(rows.fillna(-1, [f"c_{c}" for c in columns]))


def _class_scores(rows: DataFrame, overlaps: DataFrame, columns: list[str], score: Column) -> DataFrame:
    """(query_id, c_…, score) from the threshold on, for every combination of classes that ``rows`` hold.

    ``score`` is made of the overlaps ``p_…`` of the columns, which are 0 where there is none.
    """
    keys = [f"c_{c}" for c in columns]
    kinds = cut_lineage(rows.select(*keys).distinct())
    every = None
    for c in columns:
        points = [(F.col("overlap") if c == n else F.lit(0.0)).alias(f"p_{n}") for n in columns]
        part = kinds.join(overlaps.withColumnRenamed("class", f"c_{c}"), f"c_{c}").select("query_id", *keys, *points)
        every = part if every is None else every.unionByName(part)
    best = every.groupBy("query_id", *keys).agg(*[F.max(f"p_{n}").alias(f"p_{n}") for n in columns])
    kept = best.withColumn("score", F.round(score, 9)).filter(F.col("score") >= K.NODE_THRESHOLD)
    return cut_lineage(kept.select("query_id", *keys, "score"))


NAMED, LINKED = ["node_id", "description"], ["source", "target", "type", "description"]


def score_node_classes(rows: DataFrame, overlaps: DataFrame) -> DataFrame:
    """N4 for classed nodes: 1.5 × name + description, from 0.20 on."""
    return _class_scores(rows, overlaps, NAMED, F.col("p_node_id") * 1.5 + F.col("p_description"))


def score_edge_classes(rows: DataFrame, overlaps: DataFrame) -> DataFrame:
    """N4 for classed edges: better end + type + half the description, from 0.20 on."""
    score = F.greatest("p_source", "p_target") + F.col("p_type") + 0.5 * F.col("p_description")
    return _class_scores(rows, overlaps, LINKED, score)


def score_nodes(nodes: DataFrame, members: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(query_id, document_id, node_id, type, description, score) for the nodes of every document.

    Queries are scored against the classes of ``text_classes``; rows of nodes meet the few scores at the end.
    """
    rows = classed(nodes, members, NAMED)
    kept = rows.join(score_node_classes(rows, overlaps), [f"c_{c}" for c in NAMED])
    return kept.select("query_id", "document_id", "node_id", "type", "description", "score")


def score_edges(edges: DataFrame, members: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(query_id, document_id, source, target, type, description, score) for the edges of every document."""
    rows = classed(edges, members, LINKED)
    kept = rows.join(score_edge_classes(rows, overlaps), [f"c_{c}" for c in LINKED])
    return kept.select("query_id", "document_id", *LINKED, "score")


# expansion -------------------------------------------------------------------------------------


def first_nodes(nodes: DataFrame) -> DataFrame:
    """Equal nodes once, in the smallest of their documents: there a name scores best, as ties go by document."""
    return nodes.groupBy("node_id", "type", "description").agg(F.min("document_id").alias("document_id")).select(*nodes.columns)


def best_nodes(scored_nodes: DataFrame) -> DataFrame:
    """A query's node names, each in the document where it scores best."""
    return newest(scored_nodes, ["query_id", "node_id"], (F.col("score").desc(), F.col("document_id")), 1)


def seeds(scored_nodes: DataFrame, scored_edges: DataFrame) -> DataFrame:
    """(query_id, document_id, node_id, score, depth = 0).

    A node name counts in the document where it scores best; the ends of scored edges count in every document that
    holds the edge, as each document's graph is expanded by itself.
    """
    ends = scored_edges.select("query_id", "document_id", F.explode(F.array("source", "target")).alias("node_id"), F.lit(0.0).alias("score"))
    rows = best_nodes(scored_nodes).select("query_id", "document_id", "node_id", "score").unionByName(ends)
    return rows.groupBy("query_id", "document_id", "node_id").agg(F.max("score").alias("score")).withColumn("depth", F.lit(0))


def shared_starts(scored_nodes: DataFrame, rows: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ``seeds`` of all queries, those of one document that are the same only once: (starts, asked).

    ``starts`` (query_id, document_id, seeds, hits) has a row, numbered in place of a query, for the different seeds of a
    document, and ``asked`` (hit, query_id) the queries of a hit. ``rows`` are classed edges, ``kept`` the scores of their classes.
    Queries are put together for types of documents, which hold edges of the same scored classes; a document with a
    best node is a type of its own. So no row is made per query and document.
    """
    keys = [f"c_{c}" for c in LINKED]
    kinds = cut_lineage(kept.select(*keys).distinct().withColumn("kind", F.monotonically_increasing_id()))
    best = cut_lineage(best_nodes(scored_nodes).select("query_id", "document_id", "node_id", "score"))
    # a document's edges are bounded by the dictionary
    listed = rows.join(kinds, keys).groupBy("document_id").agg(F.collect_list(F.struct("kind", "source", "target")).alias("held"))
    own = best.select("document_id").distinct().withColumn("own", F.col("document_id"))
    listed = listed.join(own, "document_id", "full_outer").withColumn("held", F.coalesce("held", F.expr("array()").cast(listed.schema["held"].dataType)))
    type_key = F.struct(F.array_sort(F.array_distinct("held.kind")).alias("kinds"), "own")
    listed = cut_lineage(listed.withColumn("key", type_key))
    types = cut_lineage(listed.groupBy("key").agg(F.min("document_id").alias("type")))
    # few rows, each of which meets many types: dealt over all tasks, as they are one file
    scores = kept.join(kinds, keys).select("query_id", "kind").repartition(kept.sparkSession.sparkContext.defaultParallelism, "query_id", "kind")
    by_kind = types.select("type", F.explode("key.kinds").alias("kind")).join(scores, "kind")
    by_kind = by_kind.groupBy("type", "query_id").agg(F.sort_array(F.collect_list("kind")).alias("kinds"))
    by_node = types.filter("key.own IS NOT NULL").select("type", F.col("key.own").alias("document_id")).join(best, "document_id")
    by_node = by_node.groupBy("type", "query_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "score"))).alias("best"))
    hits = by_kind.join(by_node, ["type", "query_id"], "full_outer")
    hits = hits.groupBy("type", "kinds", "best").agg(F.collect_list("query_id").alias("queries"))
    hits = cut_lineage(hits.withColumn("hit", F.monotonically_increasing_id()))
    typed = listed.select("document_id", "held", "key").join(types, "key").select("document_id", "held", "type")
    every = typed.join(hits.drop("queries"), "type")
    ends = F.flatten(F.transform(F.filter("held", lambda e: F.array_contains("kinds", e["kind"])), lambda e: F.array(e["source"], e["target"])))
    rest = F.array_except(F.coalesce(F.sort_array(F.array_distinct(ends)), F.array().cast("array<string>")), F.coalesce(F.col("best.node_id"), F.array().cast("array<string>")))
    zero = F.transform(rest, lambda n: F.struct(n.alias("node_id"), F.lit(0.0).alias("score")))
    every = every.select("document_id", "hit", F.when(F.col("best").isNull(), zero).otherwise(F.concat("best", zero)).alias("seeds"))
    alike = every.groupBy("document_id", "seeds").agg(F.collect_list("hit").alias("hits"))
    alike = cut_lineage(alike.withColumn("query_id", F.monotonically_increasing_id()))
    return alike, hits.select("hit", F.explode("queries").alias("query_id"))


def shared_seeds(scored_nodes: DataFrame, rows: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``shared_starts`` as rows of seeds: (found, starts, asked).

    ``found`` is as ``seeds`` returns it with a start for a query, ``starts`` (query_id, hit) holds the hits of a start.
    """
    alike, asked = shared_starts(scored_nodes, rows, kept)
    found = alike.select("query_id", "document_id", F.inline("seeds")).withColumn("depth", F.lit(0))
    return found, alike.select("query_id", F.explode("hits").alias("hit")), asked


def alike_documents(rows: DataFrame, nodes: DataFrame, scored_nodes: DataFrame, n: int) -> DataFrame:
    """(document_id, own, names): one document for all that have the same graph but for their own name; stored.

    ``own`` is the name of the document's node, ``names`` the ``n`` first such names among the documents it stands for. The
    same graph means equal classed edges (``rows``) with the own name left open, and as many other names before it: then
    seeds and queues are the same, as they go by name. A document with a best node stands for itself.
    """
    own = nodes.filter(F.col("type") == K.DOCUMENT_NODE[0]).groupBy("document_id").agg(F.min("node_id").alias("own"))
    at = {c: F.coalesce(F.col(c) == F.col("own"), F.lit(False)) for c in ("source", "target")}
    opened = [F.when(~is_own, F.col(c)).alias(c) for c, is_own in at.items()]
    edge = F.struct(*opened, *[is_own.alias(f"o_{c}") for c, is_own in at.items()], "type", *[f"c_{c}" for c in LINKED])
    # a document's edges are bounded by the dictionary
    shapes = rows.join(own, "document_id", "left").groupBy("document_id", "own").agg(F.sort_array(F.collect_set(edge)).alias("_e"))
    before = F.size(F.array_distinct(F.filter(F.concat("_e.source", "_e.target"), lambda c: c < F.col("own"))))
    shapes = shapes.select("document_id", "own", F.sha2(F.to_json(F.struct("_e", before.alias("before"))), 256).alias("shape"))
    best = best_nodes(scored_nodes).select("document_id", F.col("document_id").alias("itself")).distinct()
    shapes = shapes.join(best, "document_id", "left")
    named = shapes.groupBy("shape", "itself", "own").agg(F.min("document_id").alias("document_id"))
    first = newest(named, ["shape", "itself"], (F.col("own"), F.col("document_id")), n)
    alike = first.groupBy("shape", "itself").agg(F.min(F.struct("rn", "document_id", "own")).alias("_d"), F.sort_array(F.collect_list("own")).alias("names"))
    return cut_lineage(alike.select("_d.document_id", "_d.own", "names"))


def for_alike(walked: DataFrame, alike: DataFrame) -> DataFrame:
    """Rows of ``walk`` with what is found under the own name of a document repeated under the names that it stands for.

    Of all documents it stands for, that holds the ``n`` first nodes and edges: each goes by the names in it.
    """
    rows = walked.join(alike, "document_id", "left")
    names = F.coalesce("names", F.array("own"))

    def own(c: Column) -> Column:
        return F.coalesce(c == F.col("own"), F.lit(False))

    def renamed(part: str, columns: list[str]) -> Column:
        def under(v: Column) -> Column:
            each = F.transform(names, lambda n: reduce(lambda r, c: r.withField(c, F.when(own(v[c]), n).otherwise(v[c])), columns, v))
            return F.when(reduce(or_, [own(v[c]) for c in columns]), each).otherwise(F.array(v))

        return F.flatten(F.transform(part, under))

    return rows.withColumns({"nodes": renamed("nodes", ["node_id"]), "touched": renamed("touched", ["source", "target"])}).select(walked.columns)


def for_queries(rows: DataFrame, starts: DataFrame, asked: DataFrame) -> DataFrame:
    """What was found from shared seeds, for every query that has them."""
    return rows.join(starts, "query_id").drop("query_id").join(asked, "hit").select(*rows.columns)


def first_for_queries(walked: DataFrame, asked: DataFrame, part: str, columns: list[str], n: int) -> DataFrame:
    """(query_id, columns…): at least the ``n`` first different values that each query finds from shared seeds.

    They are among the first of a start and of a hit, so all queries of a hit get these and no more. ``part`` is the
    column of ``walked`` that holds the values, different ones in a row.
    """
    first = F.slice(F.sort_array(F.transform(part, lambda v: F.struct(*[v[c].alias(c) for c in columns]))), 1, n)
    of_hit = walked.select(F.explode("hits").alias("hit"), first.alias("_v")).select("hit", F.inline("_v")).distinct()
    return newest(of_hit, ["hit"], tuple(F.col(c) for c in columns), n).join(asked, "hit").select("query_id", *columns)


def both_ways(edges: DataFrame) -> DataFrame:
    out = edges.select("document_id", F.col("source").alias("node_id"), F.col("target").alias("neighbour"), "source", "target", "type")
    back = edges.select("document_id", F.col("target").alias("node_id"), F.col("source").alias("neighbour"), "source", "target", "type")
    return out.unionByName(back)


def document_graphs(edges: DataFrame) -> DataFrame:
    """(document_id, links, held): per document the sorted neighbours of every node, and its different edges.

    Both are bounded by the dictionary.
    """
    links = both_ways(edges).filter("node_id IS NOT NULL").groupBy("document_id", "node_id").agg(F.sort_array(F.collect_set("neighbour")).alias("near"))
    links = links.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "near"))).alias("links"))
    held = edges.groupBy("document_id").agg(F.collect_set(F.struct("source", "target", "type")).alias("held"))
    return held.join(links, "document_id", "left")


def walk(starts: DataFrame, edges: DataFrame, depth: int = K.BFS_DEPTH, cap: int = K.BFS_NODES) -> DataFrame:
    """N5 for rows with a ``document_id`` and ``seeds`` (node_id, score): ``nodes`` (node_id, score, depth) and ``touched`` edges in place of the seeds; stored.

    Nodes wait in a queue: seeds by score and name, then every node's new neighbours by name. A node is taken from
    it only while there is room; then all its edges count as touched, and its new neighbours are let in as far as
    the cap allows. Each start meets the graph of its document once and walks it inside its row.
    """
    none = F.array().cast("array<string>")
    rows = starts.join(document_graphs(edges), "document_id", "left")
    queue = F.transform(F.sort_array(F.transform("seeds", lambda s: F.struct((-s["score"]).alias("a"), s["node_id"].alias("b")))), lambda s: s["b"])
    rows = rows.withColumns({"_known": queue, "_wait": queue, "_taken": none})
    rows = rows.withColumn("nodes", F.transform("seeds", lambda s: F.struct(s["node_id"].alias("node_id"), s["score"].cast("double").alias("score"), F.lit(0).alias("depth"))))
    for step in range(1, depth + 1):

        def taken(state: Column, node: Column) -> Column:
            inside = F.concat(F.col("_known"), state["fresh"])
            near = F.coalesce(F.try_element_at(F.col("links"), node), none)
            after = F.struct(F.concat(state["fresh"], F.array_except(near, inside)).alias("fresh"), F.concat(state["taken"], F.array(node)).alias("taken"))
            return F.when(F.size(inside) < cap, after).otherwise(state)

        rows = rows.withColumn("_walk", F.aggregate("_wait", F.struct(none.alias("fresh"), none.alias("taken")), taken))
        rows = rows.withColumn("_wait", F.slice("_walk.fresh", F.lit(1), F.greatest(F.lit(0), F.lit(cap) - F.size("_known"))))
        fresh = F.transform("_wait", lambda n: F.struct(n.alias("node_id"), F.lit(0.0).alias("score"), F.lit(step).alias("depth")))
        rows = rows.withColumns({"_known": F.concat("_known", "_wait"), "_taken": F.concat("_taken", "_walk.taken"), "nodes": F.concat("nodes", fresh)})
    touched = F.filter("held", lambda e: F.array_contains("_taken", e["source"]) | F.array_contains("_taken", e["target"]))
    kept = [c for c in starts.columns if c != "seeds"]
    return cut_lineage(rows.select(*kept, "nodes", F.coalesce(touched, F.array().cast("array<struct<source:string,target:string,type:string>>")).alias("touched")))


def expand(found: DataFrame, edges: DataFrame, depth: int = K.BFS_DEPTH, cap: int = K.BFS_NODES) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges within ``depth`` steps, at most ``cap`` nodes per query and document; see ``walk``."""
    group = ["query_id", "document_id"]
    walked = walk(found.groupBy(*group).agg(F.collect_list(F.struct("node_id", "score")).alias("seeds")), edges, depth, cap)
    return walked.select(*group, F.inline("nodes")), walked.select(*group, F.inline("touched"))


def graph_context(
    scored_nodes: DataFrame, visited: DataFrame, touched: DataFrame, nodes: DataFrame, edges: DataFrame, top: int = K.GRAPH_TOP
) -> DataFrame:
    """(query_id, graph_context): the best nodes, then edges, one line each."""
    half = top // 2
    detail = nodes.groupBy("node_id").agg(F.min_by(F.struct("type", "description"), "document_id").alias("_d"))
    reached = visited.select("query_id", "node_id").distinct().join(detail, "node_id").select(
        "query_id", "node_id", F.lit(0.0).alias("score"), "_d.type", "_d.description"
    )
    known = newest(scored_nodes, ["query_id", "node_id"], (F.col("score").desc(), F.col("document_id")), 1)
    known = known.select("query_id", "node_id", "score", "type", "description")
    every = known.unionByName(reached.join(known.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti"))
    best = newest(every, ["query_id"], (F.col("score").desc(), F.col("node_id")), half)
    note = F.coalesce(F.when(F.col("description") != "", F.col("description")), F.lit("—"))
    node_lines = best.select("query_id", F.lit(0).alias("part"), "rn", F.format_string(K.NODE_LINE, "node_id", "type", note).alias("line"))
    kinds = ["source", "target", "type"]
    picked = newest(touched.select("query_id", *kinds).distinct(), ["query_id"], tuple(F.col(c) for c in kinds), half)
    texts = edges.groupBy(*kinds).agg(F.min_by("description", "document_id").alias("description"))
    edge_lines = picked.join(texts, kinds).select(
        "query_id", F.lit(1).alias("part"), "rn", F.format_string(K.EDGE_LINE, "source", "type", "target", note).alias("line")
    )
    listed = node_lines.unionByName(edge_lines).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("part", "rn", "line"))).alias("_l"))
    return listed.select("query_id", F.array_join(F.col("_l.line"), "\n").alias("graph_context"))


def search_graph(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q10 without its fallback: (query_id, graph_context) of queries that match a node or an edge."""
    texts = nodes.select(F.explode(F.array("node_id", "description")).alias("text")).unionByName(
        edges.select(F.explode(F.array("source", "target", "type", "description")).alias("text"))
    )
    # each of these is used several times below; written once, none is worked out again
    members, overlaps = text_classes(queries, texts)
    scored_nodes = cut_lineage(score_nodes(first_nodes(nodes), members, overlaps))
    rows = classed(edges, members, LINKED)
    # Of nodes without a score of their own the first half line up behind those that have one, which may be among them.
    half = K.GRAPH_TOP // 2
    alike = alike_documents(rows, nodes, scored_nodes, half)
    few = rows.join(alike, "document_id", "left_semi")
    starts, asked = shared_starts(scored_nodes, few, score_edge_classes(few, overlaps))
    walked = for_alike(walk(starts, few), alike)
    visited = first_for_queries(walked, asked, "nodes", ["node_id"], half)
    touched = first_for_queries(walked, asked, "touched", ["source", "target", "type"], half)
    return graph_context(scored_nodes, visited, touched, nodes, edges)
