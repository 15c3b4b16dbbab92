"""Pixel projections and per-acquisition statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.functions import spectral as S
from verdant.operators.quantiles import summaries

KEYS = ["field_id", "acquisition_id"]
PIXEL = [*KEYS, "row", "col"]


def _unpivot(df: DataFrame, keys: list[str], names: tuple[str, ...]) -> DataFrame:
    # A generator passes the keys through unchanged, unlike unpivot; that keeps two uses of the same
    # long table identical, so that Spark can share their exchange.
    pairs = [x for n in names for x in (F.lit(n), F.col(n))]
    return df.select(*keys, F.stack(F.lit(len(names)), *pairs).alias("index_name", "value"))


def core_index_pixels(pixels: DataFrame) -> DataFrame:
    """P1 + P3: one row per pixel with its mask and the five core indices."""
    masked = pixels.withColumn("valid", S.valid_pixel())
    return masked.select(*PIXEL, "valid", *[c.alias(n) for n, c in S.core_indices().items()])


def biophysical_pixels(pixels: DataFrame, keep_invalid: bool = True) -> DataFrame:
    """P1 + P5: thirteen indices per pixel; statistics always run under ``valid``."""
    masked = pixels.withColumn("valid", S.valid_pixel())
    if not keep_invalid:
        masked = masked.filter("valid")
    direct = S.biophysical_indices(pixels.columns)
    # As one method of a compiled stage the indices are too large for the JVM to compile; beside a function of arrays Spark
    # compiles them in parts, which takes a tenth of the time.
    valid = F.forall(F.array("valid"), lambda v: v).alias("valid")
    return masked.select(*PIXEL, valid, *[c.alias(n) for n, c in direct.items()]).withColumns(S.derived_indices())


def zonal_statistics(pixels: DataFrame) -> DataFrame:
    """Min, mean, median, max and count per acquisition and core index; NULLs where count is 0."""
    return statistics_columns(summaries(core_index_pixels(pixels), KEYS, K.CORE_INDICES))


def statistics_columns(summary: DataFrame) -> DataFrame:
    """A summary per index under the names of the statistics table."""
    return summary.select(
        *KEYS,
        "index_name",
        F.col("minimum").alias("min_value"),
        F.col("mean").alias("mean_value"),
        F.col("median").alias("median_value"),
        F.col("maximum").alias("max_value"),
        F.col("size").alias("valid_pixel_count"),
    )


def index_distribution(pixels: DataFrame, digits: int = 3) -> DataFrame:
    """Distribution of the thirteen indices under the mask, rounded; zeros when empty."""
    return rounded(summaries(under_mask(biophysical_pixels(pixels)), KEYS, K.BIOPHYSICAL_INDICES), digits)


def under_mask(indexed: DataFrame, *more: str) -> DataFrame:
    """The thirteen indices where the pixel is valid, else NULL; and the columns ``more``."""
    return indexed.select(*KEYS, *more, *[F.when(F.col("valid"), F.col(n)).alias(n) for n in K.BIOPHYSICAL_INDICES])


def rounded(summary: DataFrame, digits: int = 3) -> DataFrame:
    out = {"min": "minimum", "mean": "mean", "median": "median", "max": "maximum", "std": "std"}
    return summary.select(*KEYS, "index_name", *[F.coalesce(F.round(c, digits), F.lit(0.0)).alias(f"{n}_value") for n, c in out.items()])


def mean_ndvi(pixels: DataFrame) -> DataFrame:
    """Mean NDVI under the mask per acquisition, rounded to 3 as the anomaly test expects."""
    ndvi = S.biophysical_indices(pixels.columns)["NDVI"]
    masked = pixels.withColumn("valid", S.valid_pixel()).filter("valid")
    return masked.groupBy(*KEYS).agg(F.round(F.avg(ndvi), 3).alias("mean_ndvi"))


def flag_anomalies(pixels: DataFrame) -> DataFrame:
    """Valid pixels with their indices and the anomaly flag.

    The mean table has one row per acquisition. No hint: the join is broadcast when its measured
    size allows, otherwise adaptive execution splits a hot acquisition.
    """
    indexed = biophysical_pixels(pixels, keep_invalid=False)
    return indexed.join(mean_ndvi(pixels), KEYS).withColumn("anomalous", S.anomalous(F.col("mean_ndvi")))


def anomaly_totals(pixels: DataFrame, pixel_size_m: float = 10.0) -> DataFrame:
    """Valid and anomalous pixels, anomalous hectares and share, one row per acquisition."""
    counted = flag_anomalies(pixels).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("valid_pixels"),
        F.count_if("anomalous").alias("anomalous_pixels"),
    )
    return totals_of(pixels.select(*KEYS).distinct().join(counted, KEYS, "left"), pixel_size_m)


def totals_of(counted: DataFrame, pixel_size_m: float = 10.0) -> DataFrame:
    """E3 of (keys, valid_pixels, anomalous_pixels); NULL counts are 0."""
    hectares = pixel_size_m * pixel_size_m / 10000.0
    share = F.col("anomalous_pixels") / F.col("valid_pixels") * 100.0
    return counted.select(
        *KEYS,
        F.coalesce("valid_pixels", F.lit(0)).alias("valid_pixels"),
        F.coalesce("anomalous_pixels", F.lit(0)).alias("anomalous_pixels"),
        F.coalesce(F.col("anomalous_pixels") * hectares, F.lit(0.0)).alias("anomalous_area_ha"),
        F.when(F.col("valid_pixels") > 0, share).otherwise(0.0).alias("anomaly_percentage"),
    )


def quality_histogram(pixels: DataFrame) -> DataFrame:
    """Pixels per quality class and acquisition, inside the data mask."""
    return (
        pixels.withColumn("quality", S.quality_class())
        .filter(F.col("quality").isNotNull())
        .groupBy(*KEYS, "quality")
        .agg(F.count(F.lit(1)).alias("pixels"))
    )


def severity_histogram(pixels: DataFrame) -> DataFrame:
    """P10: valid pixels per layer and colour-ramp stretch."""
    long = _unpivot(
        core_index_pixels(pixels).filter("valid"), KEYS, K.CORE_INDICES
    ).withColumnRenamed("index_name", "layer_name")
    return (
        long.withColumn("band", S.severity_band(F.col("layer_name"), F.col("value")))
        .groupBy(*KEYS, "layer_name", "band")
        .agg(F.count(F.lit(1)).alias("pixels"))
    )


def hotspots(pixels: DataFrame, grids: DataFrame) -> DataFrame:
    """Where NDRE is lowest; ties go to the first pixel in row-major order.

    ``grids`` gives (field_id, acquisition_id, width, height, min_lon, min_lat, max_lon, max_lat).
    """
    lowest = (
        core_index_pixels(pixels)
        .filter(F.col("NDRE").isNotNull())
        .groupBy(*KEYS)
        .agg(F.min(F.struct("NDRE", "row", "col")).alias("at"))
    )

    def along(index: Column, length: str, low: str, high: str) -> Column:
        step = index / F.greatest(F.lit(1), F.col(length) - 1)
        return F.round(F.col(low) + step * (F.col(high) - F.col(low)), 6)

    return lowest.join(grids, KEYS).select(
        *KEYS,
        F.col("at.NDRE").alias("ndre"),
        along(F.col("height") - 1 - F.col("at.row"), "height", "min_lat", "max_lat").alias("lat"),
        along(F.col("at.col"), "width", "min_lon", "max_lon").alias("lon"),
    )
