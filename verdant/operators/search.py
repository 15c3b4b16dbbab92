"""Lexical and hybrid retrieval for a table of queries over a table of chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.functions import text as tx
from verdant.functions.vectors import dot
from verdant.operators.lexical import Corpus, bm25_ranked, corpus_statistics
from verdant.operators.store import newest
from verdant.operators.vectors import DIGITS, keep_rule, nearest


def active_chunks(chunks: DataFrame, documents: DataFrame, selected: list[int] | None = None) -> DataFrame:
    """Chunks of active documents, optionally of selected ones only."""
    active = documents.filter("is_active").select("document_id", F.col("name").alias("document_name"))
    if selected:
        active = active.filter(F.col("document_id").isin(*selected))
    return chunks.join(active, "document_id")


def corpus_counts(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks and pages per document with its name and flag."""
    counted = chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.max("page_number").alias("total_pages")
    )
    return documents.select("document_id", "name", "is_active").join(counted, "document_id", "left").withColumn(
        "chunk_count", F.coalesce("chunk_count", F.lit(0))
    )


def query_variants(queries: DataFrame) -> DataFrame:
    """Q5: the query, and from three tokens on its first four and its last four tokens.

    Every variant needs its own vector; they are joined on (query_id, variant) by the caller.
    """
    listed = queries.withColumn("_t", tx.tokens(F.col("text")))
    size = F.size("_t")
    first = F.array_join(F.slice("_t", 1, 4), " ")
    last = F.array_join(F.slice("_t", F.greatest(F.lit(1), size - 3), F.lit(4)), " ")
    texts = F.when(size >= 3, F.array(F.col("text"), first, last)).otherwise(F.array(F.col("text")))
    return listed.select("query_id", F.posexplode(texts).alias("variant", "text"))


def fuse(ranked: DataFrame, pool: int = K.FUSED_POOL, k: int = K.RRF_K) -> DataFrame:
    """Q6: (query_id, chunk_id, fused, place) – reciprocal ranks summed over all lists of a query."""
    scored = ranked.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (F.col("rank") + float(k))).alias("fused"))
    scored = scored.withColumn("fused", F.round("fused", 12))
    return newest(scored, ["query_id"], (F.col("fused").desc(), F.col("chunk_id")), pool, "place")


def _mmr(pdf: pd.DataFrame, n: int, weight: float) -> pd.DataFrame:
    pdf = pdf.sort_values("place").reset_index(drop=True)
    if len(pdf) <= n:
        return pdf[["query_id", "chunk_id"]]

    def unit(m: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    vectors = unit(np.stack(pdf["embedding"]).astype(float))
    relevance = vectors @ unit(np.asarray(pdf["query_embedding"].iloc[0], dtype=float)[None, :])[0]
    alike = vectors @ vectors.T
    chosen: list[int] = []
    closest = np.full(len(pdf), -np.inf)
    for _ in range(n):
        value = relevance if not chosen else weight * relevance - (1.0 - weight) * closest
        value = np.round(value, DIGITS)
        value[chosen] = -np.inf
        best = int(np.argmax(value))
        chosen.append(best)
        closest = np.maximum(closest, alike[best])
    return pdf.loc[chosen, ["query_id", "chunk_id"]]


def diversify(pool: DataFrame, chunks: DataFrame, queries: DataFrame, n: int = K.MMR_COUNT, weight: float = K.MMR_LAMBDA) -> DataFrame:
    """Q7: greedy choice of ``n`` relevant and dissimilar chunks. A pool has at most 24 rows."""
    rows = pool.join(chunks.select("chunk_id", "embedding"), "chunk_id").join(
        queries.select("query_id", F.col("embedding").alias("query_embedding")), "query_id"
    )
    return rows.select("query_id", "chunk_id", "place", "embedding", "query_embedding").groupBy("query_id").applyInPandas(
        lambda pdf: _mmr(pdf, n, weight), "query_id long, chunk_id long"
    )


def rerank_score(query: Column, text: Column, dense: Column) -> Column:
    """Q8: weighted dense score, share of the query's words in the chunk, and a bonus for the whole phrase."""
    words = F.array_distinct(tx.tokens(query))
    common = F.size(F.array_intersect(words, tx.tokens(text)))
    share = F.when(F.size(words) > 0, common / F.size(words)).otherwise(0.0)
    phrase = F.when(F.contains(F.lower(text), F.lower(query)), K.RERANK_PHRASE).otherwise(0.0)
    return K.RERANK_DENSE * dense + K.RERANK_OVERLAP * share + phrase


def rerank(
    chosen: DataFrame, chunks: DataFrame, queries: DataFrame, top_k: int, threshold: float | None = None,
    cutoff: float = K.SIMILARITY_CUTOFF,
) -> DataFrame:
    """Q8: (query_id, chunk_id, score, rank) of at most ``top_k`` chunks that pass the keep rule."""
    rows = chosen.join(chunks.select("chunk_id", "text", "embedding"), "chunk_id").join(
        queries.select("query_id", F.col("text").alias("_query"), F.col("embedding").alias("_vector")), "query_id"
    )
    score = rerank_score(F.col("_query"), F.col("text"), dot(F.col("_vector"), F.col("embedding")))
    scored = rows.select("query_id", "chunk_id", F.round(score, DIGITS).alias("score"))
    ranked = newest(scored, ["query_id"], (F.col("score").desc(), F.col("chunk_id")), top_k, "rank")
    return keep_rule(ranked, "score", threshold, cutoff).withColumn("score", F.round("score", 4))


def ranked_lists(variants: DataFrame, chunks: DataFrame, n: int = K.RANKED_LIST, corpus: Corpus | None = None) -> DataFrame:
    """Dense and lexical lists of every variant: (query_id, variant, kind, chunk_id, score, rank).

    ``corpus``: the stored statistics of the chunks; without them they are worked out here.
    """
    keys = ["query_id", "variant"]
    coded = variants.withColumn("_code", F.shiftleft("query_id", 3) + F.col("variant"))
    dense = nearest(coded.select(F.col("_code").alias("query_id"), "embedding"), chunks.select("chunk_id", "embedding"), n)
    dense = dense.select(
        F.shiftright("query_id", 3).alias("query_id"), F.col("query_id").bitwiseAND(F.lit(7)).cast("int").alias("variant"),
        F.lit("dense").alias("kind"), "chunk_id", "score", "rank",
    )
    sparse = bm25_ranked(variants, corpus or corpus_statistics(chunks), keys, n).withColumn("kind", F.lit("sparse"))
    return dense.unionByName(sparse.select(*dense.columns))


def search_advanced(
    queries: DataFrame, variants: DataFrame, chunks: DataFrame, top_k: int = 4, threshold: float | None = None,
    cutoff: float = K.SIMILARITY_CUTOFF, corpus: Corpus | None = None,
) -> DataFrame:
    """Q9: lists → fusion → diversity → rerank for all queries at once."""
    pool = fuse(ranked_lists(variants, chunks, corpus=corpus))
    return rerank(diversify(pool, chunks, queries), chunks, queries, top_k, threshold, cutoff)


def union_hits(advanced: DataFrame, naive: DataFrame, top_k: int, threshold: float | None = None) -> DataFrame:
    """One row per query and chunk, the advanced hit before the vector hit, best ``top_k`` by score."""
    both = advanced.select("query_id", "chunk_id", "score").withColumn("source", F.lit(0)).unionByName(
        naive.select("query_id", "chunk_id", "score").withColumn("source", F.lit(1))
    )
    if threshold is not None:
        both = both.filter(F.col("score") >= threshold)
    once = both.groupBy("query_id", "chunk_id").agg(F.min_by(F.struct("score", "source"), "source").alias("_h"))
    once = once.select("query_id", "chunk_id", "_h.score", F.when(F.col("_h.source") == 0, "advanced").otherwise("naive").alias("strategy"))
    return newest(once, ["query_id"], (F.col("score").desc(), F.col("strategy"), F.col("chunk_id")), top_k, "rank")


def assemble_context(hits: DataFrame, chunks: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    """Q13: per query the text handed on and its sources; a query has at most a handful of hits."""
    rows = hits.join(chunks.select("chunk_id", "document_name", "page_number", "text"), "chunk_id")
    block = F.format_string(
        "[Manba: '%s', %d-bet (Score: %.2f)]\n%s", F.col("document_name"), F.col("page_number"), F.col("score"), F.col("text")
    )
    listed = rows.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", block.alias("block"), "document_name", "page_number", "score", "text"))).alias("_h")
    )
    sources = F.transform("_h", lambda h: h.dropFields("rank", "block"))
    out = listed.select("query_id", F.array_join(F.col("_h.block"), "\n\n").alias("_chunks"), sources.alias("sources"))
    if graph is None:
        return out.withColumnRenamed("_chunks", "context")
    joined = out.join(graph.select("query_id", "graph_context"), "query_id", "full_outer")
    block = F.when(F.col("graph_context") != "", F.concat(F.lit(K.GRAPH_HEADER), F.col("graph_context")))
    parts = F.array_compact(F.array(F.col("_chunks"), block))
    return joined.select("query_id", F.array_join(parts, "\n\n---\n\n").alias("context"), "sources")


