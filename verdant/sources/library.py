"""Files on disk against what the tables know. Only paths and sizes are read, never contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant import constants as K


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, name, length)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def reconcile(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Indexed documents and files united by name, newest documents first, unindexed files after them."""
    found = files.select("name", F.col("path").alias("_path"), "length")
    indexed = F.col("document_id").isNotNull()
    joined = documents.join(found, "name", "full_outer")
    return joined.select(
        "document_id", "name",
        F.coalesce("_path", "file_path").alias("file_path"),
        F.coalesce(F.round(F.col("length") / (1024 * 1024), 2), F.lit(0.0)).alias("size_mb"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.coalesce("is_active", F.lit(False)).alias("is_active"),
        indexed.alias("indexed"),
        "created_at",
    ).orderBy(indexed.desc(), F.col("created_at").desc(), "name")


def orphans(files: DataFrame, layers: DataFrame, root: str) -> DataFrame:
    """Files no layer of the current version refers to, sorted by path."""
    known = layers.filter(F.col("render_version") == K.RENDER_VERSION).select("relative_path").distinct()
    base = root.rstrip("/") + "/"
    # the part behind the last place of the root, which is plain text, not a pattern
    relative = F.substring_index("path", base, -1)
    return files.withColumn("relative_path", relative).join(known, "relative_path", "left_anti").select("relative_path").orderBy("relative_path")
