"""Streaming jobs over the given tables landed as several files in time order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from verdant.queries import standins as st
from verdant.queries.chat import messages
from verdant.queries.registry import query, table
from verdant.queries.text import mask_sql
from verdant.session import shared_folder
from verdant.streaming import jobs


def repeated(df, *order: str):
    """Every row twice, the copies mixed: repeats come in the same file and in later ones, old rows after newer ones."""
    return df.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("mixed", F.xxhash64(*order, "again")).drop("again")


def landed(spark, df, order: str, files: int = 4):
    """The rows as files in order, a fresh folder for the result and one for the checkpoint."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # a file holds a range of the order; a sort inside it would hold the file's rows in one task
    df.repartitionByRange(files, order).write.parquet(f"{base}/in")
    stream = jobs.read_files(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema)
    return stream, f"{base}/out", f"{base}/checkpoint"


@query("stream_catalogue_ingest", f"WITH {st.ACQUISITIONS} SELECT DISTINCT field_id, product_id, revision_key FROM acquisitions")
def _(spark, sf):
    arriving = repeated(st.acquisitions(spark, sf), "acquisition_id")
    return jobs.ingest_acquisitions(*landed(spark, arriving, "mixed")).select("field_id", "product_id", "revision_key")


@query("stream_zonal_statistics", f"""WITH {st.PIXELS}, {st.CORE}
SELECT field_id, acquisition_id, index_name, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value, count(value) AS valid_pixel_count
FROM core_long GROUP BY 1, 2, 3""")
def _(spark, sf):
    # landed by raster line, so that every acquisition's pixels arrive in several batches
    stats = jobs.upsert_statistics(*landed(spark, st.pixels(spark, sf), "row", 3))
    return stats.select(
        "field_id", "acquisition_id", "index_name", F.round("mean_value", 6).alias("mean_value"),
        F.round("median_value", 6).alias("median_value"), "valid_pixel_count",
    )


@query("stream_masked_log", f"SELECT conv_id, turn, {mask_sql('text')} AS text FROM conversations")
def _(spark, sf):
    stream, out, checkpoint = landed(spark, table(spark, sf, "conversations"), "conv_id")
    return jobs.mask_stream(stream, "text", out, checkpoint, ("thereti",)).select("conv_id", "turn", "text")


@query("stream_message_counts", f"SELECT conv_id, count(*) AS messages, max(conv_id * {st.TURNS_PER_CONVERSATION} + turn) AS last_message_id FROM conversations GROUP BY 1")
def _(spark, sf):
    return jobs.running_counts(*landed(spark, repeated(messages(spark, sf), "message_id"), "mixed"))
