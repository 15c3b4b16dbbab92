"""Queries of the operators that look at the whole corpus: near-duplicates, decontamination, packing, toxicity."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from verdant.llm import decontaminate, near_dedup, packing, toxicity
from verdant.llm.registry import query, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@query("op7_benchmark_decontamination")
def _(spark, sf):
    found = decontaminate.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(found).alias("contaminated"), "near_items",
    )


@query("op8_best_fit_packing")
def _(spark, sf):
    return packing.pack(packing.pieces(table(spark, sf, "documents"), VOCABULARY))


@query("op4_minhash_near_dedup")
def _(spark, sf):
    found = near_dedup.classes(table(spark, sf, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", near_dedup.kept().alias("kept"))


@query("op9_toxicity")
def _(spark, sf):
    found = toxicity.scores(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
