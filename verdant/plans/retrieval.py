"""Q10–Q12: graph, combined and per-mode retrieval for a table of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.operators import search, vectors
from verdant.operators.graph import search_graph
from verdant.session import cut_lineage


def graph_or_chunks(
    queries: DataFrame, variants: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, threshold: float | None = None,
    corpus: search.Corpus | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Q10: graph context per matching query; the others fall back to two chunks of the hybrid search."""
    context = cut_lineage(search_graph(queries, nodes, edges))
    left = queries.join(context.select("query_id"), "query_id", "left_anti")
    rest = variants.join(left.select("query_id"), "query_id", "left_semi")
    return context, search.search_advanced(left, rest, chunks, 2, threshold, corpus=corpus)


def _titles(strategy: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in K.STRATEGY_TITLES.items() for x in pair])
    return F.element_at(names, strategy)


def combine(
    queries: DataFrame, advanced: DataFrame, naive: DataFrame, context: DataFrame, chunks: DataFrame, top_k: int, threshold: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """Q11 from the hits of the single searches: (united hits, one row per query with its strategy)."""
    hits = cut_lineage(search.union_hits(advanced, naive, top_k, threshold))
    context = context.filter(F.length(F.trim("graph_context")) > K.MIN_GRAPH_CONTEXT)
    counted = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("top_score"))
    joined = queries.select("query_id").join(counted, "query_id", "left").join(context, "query_id", "left")
    has_hits, has_graph = F.coalesce("hits", F.lit(0)) > 0, F.col("graph_context").isNotNull()
    strategy = (
        F.when(has_hits & has_graph, "all_in_one").when(has_hits, "advanced").when(has_graph, "graph").otherwise("direct_llm")
    )
    # nothing active means nothing was searched at all
    searched = chunks.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    result = joined.withColumn("searched", searched).select(
        "query_id", F.when(F.col("searched") == 0, "direct_llm").otherwise(strategy).alias("strategy"), F.coalesce("hits", F.lit(0)).alias("hits"),
        F.coalesce("top_score", F.lit(0.0)).alias("top_score"), "graph_context",
    )
    return hits, result.withColumn("title", _titles(F.col("strategy")))


def search_all(
    queries: DataFrame, variants: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, top_k: int = 4,
    threshold: float | None = None, corpus: search.Corpus | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Q11: hits of vector and hybrid search united, plus graph context; and the strategy per query."""
    advanced = search.search_advanced(queries, variants, chunks, top_k, threshold, corpus=corpus)
    naive = vectors.search_naive(queries, chunks, top_k, threshold)
    return combine(queries, advanced, naive, search_graph(queries, nodes, edges), chunks, top_k, threshold)


def dispatch(
    queries: DataFrame, variants: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, corpus: search.Corpus | None = None
) -> DataFrame:
    """Q12: (query_id, mode, strategy, chunk_id, score, rank) for queries with a mode each.

    Each engine runs once, over the queries of all modes that need it; a mode that wants fewer hits takes the
    first of them, as ranks are given before weak hits are left out. A query without chunks keeps one row.
    """

    def of(*modes: str) -> DataFrame:
        return queries.filter(F.col("mode").isin(*modes))

    hybrid = of("advanced", "auto", "graph", "all_in_one")
    hybrid_variants = variants.join(hybrid.select("query_id"), "query_id", "left_semi")
    advanced = cut_lineage(search.search_advanced(hybrid, hybrid_variants, chunks, 4, corpus=corpus))
    naive = cut_lineage(vectors.search_naive(of("naive", "all_in_one"), chunks, 4))
    context = cut_lineage(search_graph(of("graph", "all_in_one"), nodes, edges))
    columns = ["query_id", "strategy", "chunk_id", "score", "rank"]

    def tagged(own: DataFrame, hits: DataFrame, name: str) -> DataFrame:
        strategy = F.when(F.col("chunk_id").isNotNull(), name).otherwise("direct_llm")
        return own.select("query_id").join(hits, "query_id", "left").withColumn("strategy", strategy).select(*columns)

    matched = of("graph").select("query_id").join(context.select("query_id", F.lit(True).alias("_matched")), "query_id", "left")
    fallback = matched.filter(F.col("_matched").isNull()).drop("_matched").join(advanced.filter("rank <= 2"), "query_id")
    graphed = matched.join(fallback, "query_id", "left").withColumn("strategy", F.when(F.col("_matched"), "graph").otherwise("direct_llm"))
    combined = of("all_in_one")

    def own(df: DataFrame) -> DataFrame:
        return df.join(combined.select("query_id"), "query_id", "left_semi")

    hits, summary = combine(combined, own(advanced), own(naive), own(context), chunks, 4)
    none = [F.lit("direct_llm").alias("strategy"), F.lit(None).cast("long").alias("chunk_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")]
    parts = [
        tagged(of("naive"), naive.filter("rank <= 3"), "naive"),
        tagged(of("advanced", "auto"), advanced, "advanced"),
        graphed.select(*columns),
        summary.select("query_id", "strategy").join(hits.drop("strategy"), "query_id", "left").select(*columns),
        of("direct_llm").select("query_id", *none),
    ]
    return reduce(DataFrame.unionByName, parts).join(queries.select("query_id", "mode"), "query_id")
