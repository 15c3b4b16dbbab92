"""Field registration: polygon checks, canonical form, area, validation, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.functions import geo, keys
from verdant.functions.vectors import bind
from verdant.operators.validation import check_fields
from verdant.session import cut_lineage


def check_geometry(requests: DataFrame, column: str = "geometry_json") -> DataFrame:
    """G1: adds rings, error name, message and valid flag. Unreadable JSON counts as a wrong type.

    A geometry is read and checked once: what an explode gives is neither copied into the expressions that
    use it nor into a filter on it.
    """
    texts = F.create_map(*[F.lit(x) for pair in K.POLYGON_ERRORS.items() for x in pair])

    def checked(g: Column, numeric: Column) -> Column:
        error = F.when(g.isNull(), "type").otherwise(geo.polygon_error(g, numeric))
        return bind(error, lambda e: F.struct(e.alias("error"), F.when(e.isNull(), numeric).alias("rings")))

    once = bind(F.from_json(column, geo.GEOJSON), lambda g: bind(geo.numbers(g), lambda numeric: checked(g, numeric)))
    return (
        requests.withColumn("_c", F.explode(F.array(once)))
        .withColumn("error", F.col("_c.error"))
        .withColumn("message", F.try_element_at(texts, F.col("error")))
        .withColumn("valid", F.col("error").isNull())
        .withColumn("rings", F.col("_c.rings"))
        .drop("_c")
    )


def with_geometry(checked: DataFrame) -> DataFrame:
    """G2 + G3: canonical rings, hash and hectares of valid rows."""
    return (
        checked.withColumn("geometry", geo.canonical_rings(F.col("rings")))
        .withColumn("geometry_hash", F.when(F.col("valid"), geo.geometry_hash(F.col("geometry"))))
        .withColumn("area_hectares", geo.area_hectares(F.col("rings")))
    )


def split_duplicates(rows: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """``duplicate`` marks a hash that is stored already or came earlier in the batch.

    The earliest row per hash is found by a partial aggregation, so many copies of one polygon do
    not meet in one task.
    """
    first = rows.groupBy("geometry_hash").agg(F.min(order).alias("_first"))
    known = existing.select("geometry_hash").distinct().withColumn("_known", F.lit(True))
    joined = rows.join(first, "geometry_hash").join(known, "geometry_hash", "left")
    repeated = F.col("_known").isNotNull() | (F.col(order) != F.col("_first"))
    return joined.withColumn("duplicate", repeated).drop("_first", "_known")


def register_fields(requests: DataFrame, existing: DataFrame, now: Column) -> dict[str, DataFrame]:
    """(request_id, geometry_json, crop_name, planted_on, growth_stage) → accepted, rejected, duplicates."""
    # the polygon expressions are long; each result is written once and then only read
    checked = cut_lineage(check_geometry(requests))
    bad_shape = checked.filter("NOT valid").select("request_id", F.col("message").alias("reason"))
    rows = cut_lineage(check_fields(with_geometry(checked.filter("valid"))))
    bad_row = rows.filter(F.size("violations") > 0).select("request_id", F.array_join("violations", ",").alias("reason"))
    marked = split_duplicates(rows.filter(F.size("violations") == 0).drop("violations"), existing, "request_id")
    accepted = marked.filter("NOT duplicate").select(
        "request_id", keys.public_id(F.col("geometry_hash")).alias("public_id"), "geometry", "geometry_hash", "area_hectares",
        F.trim("crop_name").alias("crop_name"), "planted_on", F.trim("growth_stage").alias("growth_stage"),
        now.alias("created_at"), now.alias("updated_at"),
    )
    return {
        "accepted": accepted,
        "rejected": bad_shape.unionByName(bad_row),
        "duplicates": marked.filter("duplicate").select("request_id", "geometry_hash"),
    }
