"""Book pages to chunks; the corpus as portable files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.functions import text as tx
from verdant.schemas import TABLES


def ingest_pages(pages: DataFrame, mode: str = "reference") -> DataFrame:
    """A5: pages (document_id, page_number, text) → chunks longer than 30 characters.

    A chunk's index counts all chunks of its page, short ones included.
    """
    cut = pages.withColumn("_chunks", tx.chunks(F.coalesce("text", F.lit("")), mode=mode))
    rows = cut.select("document_id", "page_number", F.posexplode("_chunks").alias("chunk_index", "text"))
    return rows.filter(F.length("text") > K.MIN_CHUNK)


def rejected_documents(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """A5: documents from which no chunk came."""
    return pages.select("document_id").distinct().join(chunks.select("document_id"), "document_id", "left_anti")


def export_corpus(documents: DataFrame, chunks: DataFrame, folder: str) -> None:
    """Both tables as JSON lines, ordered by id."""
    documents.orderBy("document_id").write.mode("overwrite").json(f"{folder}/documents")
    chunks.orderBy("chunk_id").write.mode("overwrite").json(f"{folder}/chunks")


def import_corpus(spark: SparkSession, folder: str, existing: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Reads the files back, only if no document is stored yet."""
    if not existing.isEmpty():
        return None
    documents = spark.read.schema(TABLES["documents"]).json(f"{folder}/documents")
    return documents, spark.read.schema(TABLES["chunks"]).json(f"{folder}/chunks")
