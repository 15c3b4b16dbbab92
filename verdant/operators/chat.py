"""Chat-log analytics over messages (conv_id, message_id, role, content, created_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.operators.store import index_history, newest


def last_user_message(messages: DataFrame) -> DataFrame:
    """L1: (conv_id, last_user_message, last_user_id); '' where the user said nothing."""
    user = F.col("role") == "user"
    return messages.groupBy("conv_id").agg(
        F.coalesce(F.max_by("content", F.when(user, F.col("message_id"))), F.lit("")).alias("last_user_message"),
        F.max(F.when(user, F.col("message_id"))).alias("last_user_id"),
    )


def oldest(messages: DataFrame, n: int) -> DataFrame:
    """The first ``n`` messages of each conversation in id order."""
    return newest(messages, ["conv_id"], (F.col("message_id"),), n)


def transcript(messages: DataFrame, n: int = K.SUMMARY_MESSAGES) -> DataFrame:
    """L2: (conv_id, transcript, fallback_summary, message_count) of the first 30 messages."""
    role = F.when(F.col("role") == "user", K.ROLE_LABELS["user"]).otherwise(K.ROLE_LABELS["assistant"])
    text = F.substring(F.trim("content"), 1, 180)
    stamp = F.date_format("created_at", "yyyy-MM-dd HH:mm")
    line = F.concat(F.lit("[#"), F.col("message_id").cast("string"), F.lit(", "), stamp, F.lit("] "), role, F.lit(": "), text)
    # at most ``n`` lines of 180 characters per conversation
    listed = oldest(messages, n).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("message_id", line.alias("line"), text.alias("text")))).alias("_m")
    )
    tail = F.slice(F.col("_m.text"), F.greatest(F.size("_m") - 2, F.lit(1)), F.lit(3))
    return listed.select(
        "conv_id",
        F.array_join(F.col("_m.line"), "\n").alias("transcript"),
        F.concat(F.lit(K.SUMMARY_PREFIX), F.array_join(tail, "; ")).alias("fallback_summary"),
        F.size("_m").alias("message_count"),
    )


def summary_records(messages: DataFrame, updated_at: Column) -> DataFrame:
    """L3: (conv_id, summary_text, message_count, last_message_id, updated_at); the id is the last user message's."""
    last = last_user_message(messages).select("conv_id", F.col("last_user_id").alias("last_message_id"))
    return transcript(messages).join(last, "conv_id").select(
        "conv_id", F.col("fallback_summary").alias("summary_text"), "message_count", "last_message_id", updated_at.alias("updated_at")
    )


def recent_metrics(acquisitions: DataFrame, index_values: DataFrame, fields: DataFrame, n: int = K.KEPT_ACQUISITIONS) -> DataFrame:
    """L4: (field_id, context) – facts of a field and its last five acquisitions per index, as JSON."""
    history = index_history(acquisitions, index_values, n)
    entry = F.struct("acquired_at", "cloud_coverage", F.col("mean_value").alias("mean_ndvi"), F.col("min_value").alias("min"), F.col("max_value").alias("max"))
    per_index = history.groupBy("field_id", "index_name").agg(F.sort_array(F.collect_list(entry)).alias("points"))
    per_field = per_index.groupBy("field_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("index_name", "points")))).alias("metrics"))
    facts = F.struct("crop_name", F.round("area_hectares", 2).alias("area_hectares"), "planted_on")
    joined = fields.join(per_field, "field_id", "left")
    return joined.select("field_id", F.to_json(F.struct(facts.alias("field"), F.col("metrics"))).alias("context"))


def history_rounded(acquisitions: DataFrame, index_values: DataFrame) -> DataFrame:
    """L4: the last 30 observations with values of two digits."""
    names = ["cloud_coverage", "min_value", "mean_value", "median_value", "max_value"]
    history = index_history(acquisitions, index_values, K.HISTORY_ACQUISITIONS)
    return history.select("field_id", "acquisition_id", "acquired_at", "product_id", "index_name", *[F.round(c, 2).alias(c) for c in names])


def response_strategy(mode: Column, has_chunks: Column, has_graph: Column) -> Column:
    """Provenance of an answer, by mode and what was found."""
    either = F.when(has_chunks & has_graph, "all_in_one").when(has_chunks, "advanced").when(has_graph, "graph")
    return F.coalesce(
        F.when(mode == "all_in_one", either)
        .when(mode == "graph", F.when(has_graph, "graph"))
        .when(mode == "naive", F.when(has_chunks, "naive"))
        .when(mode != "direct_llm", F.when(has_chunks, "advanced")),
        F.lit("direct_llm"),
    )


def strategy_counts(messages: DataFrame) -> DataFrame:
    """Messages per strategy."""
    return messages.groupBy("rag_strategy").agg(F.count(F.lit(1)).alias("messages"))


def append_messages(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored messages followed by fresh ones; sources and strategy may be absent."""
    return stored.unionByName(fresh, allowMissingColumns=True)
