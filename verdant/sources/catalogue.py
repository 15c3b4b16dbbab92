"""A1: catalogue bodies (JSON) to acquisitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.functions import keys

FEATURES = (
    "features array<struct<id: string, properties: struct<datetime: string, `eo:cloud_cover`: string, `s2:product_uri`: string, "
    "updated: string, created: string, `s2:processing_baseline`: string>>>, context struct<next: string>"
)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """One JSON body per file."""
    return spark.read.schema(FEATURES).option("multiLine", True).json(path)


def parse_bodies(bodies: DataFrame, column: str = "body") -> DataFrame:
    parsed = bodies.withColumn("_b", F.from_json(column, f"struct<{FEATURES.replace('features ', 'features: ').replace('context ', 'context: ')}>"))
    return parsed.select(*[c for c in bodies.columns if c != column], "_b.features")


def acquisitions(bodies: DataFrame) -> DataFrame:
    """(…, acquired_at, product_id, revision_key, cloud_coverage, source_metadata).

    A feature without a time or a product is left out; a cloud share that is no number is NULL.
    """
    rows = bodies.withColumn("_f", F.explode("features"))
    p = F.col("_f.properties")

    def at(name: str) -> Column:
        return p[name]

    uri, ident = at("s2:product_uri"), F.col("_f.id")
    product = F.coalesce(F.when(uri != "", uri), ident)
    cloud = at("eo:cloud_cover").try_cast("double")
    key = keys.revision_key(
        id=ident, updated=at("updated"), created=at("created"), product_uri=uri, processing_baseline=at("s2:processing_baseline")
    )
    metadata = F.struct(
        ident.alias("catalog_id"), at("datetime").alias("datetime"), product.alias("product_id"), at("updated").alias("updated"),
        at("created").alias("created"), at("s2:processing_baseline").alias("processing_baseline"), at("eo:cloud_cover").alias("cloud_coverage"),
    )
    keep = [c for c in bodies.columns if c not in ("features", "context")]
    kept = rows.filter(at("datetime").isNotNull() & product.isNotNull())
    return kept.select(
        *keep, F.to_timestamp(at("datetime")).alias("acquired_at"), product.alias("product_id"), key.alias("revision_key"),
        cloud.alias("cloud_coverage"), metadata.alias("source_metadata"),
    )
