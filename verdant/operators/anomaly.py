"""Anomaly clusters: aggregates, shape, diagnosis, ranking and the report per acquisition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.functions import spectral as S
from verdant.operators.components import TILE, label_components
from verdant.operators.quantiles import medians, proven, sketches
from verdant.operators.zonal import KEYS, biophysical_pixels, flag_anomalies, rounded, totals_of, under_mask
from verdant.session import cut_lineage

MEANS = {name: f"mean_{name.lower()}" for name in K.BIOPHYSICAL_INDICES}


def anisotropy(n: Column, var_row: Column, var_col: Column, covar: Column) -> Column:
    """E5: sqrt(l_max / (l_min + 1e-4)) of the 2x2 sample covariance, 1.0 below three pixels."""
    centre = (var_row + var_col) / 2
    spread = F.sqrt(((var_row - var_col) / 2) * ((var_row - var_col) / 2) + covar * covar)
    high = F.greatest(F.lit(0.0), centre + spread)
    low = F.greatest(F.lit(0.0), centre - spread)
    return F.when(n < 3, F.lit(1.0)).otherwise(F.round(F.sqrt(high / (low + 1e-4)), 2))


def orientation(e: Column) -> Column:
    return F.when(e > 3.0, "linear_furrow").otherwise("concentric_radial")


def cluster_pixels(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """P8 + C1: anomalous pixels with their indices and cluster id."""
    return labelled(flag_anomalies(pixels).filter("anomalous"), tile)


def labelled(anomalous: DataFrame, tile: int = TILE) -> DataFrame:
    """Anomalous pixels with their cluster id."""
    labels = label_components(anomalous.select(*KEYS, "row", "col"), KEYS, tile)
    return anomalous.join(labels, [*KEYS, "row", "col"])


def cluster_aggregates(clustered: DataFrame, pixel_size_m: float = 10.0) -> DataFrame:
    """E4 + E5: size, centroid, shape and index means; clusters below two pixels are dropped."""
    row, col = F.col("row").cast("double"), F.col("col").cast("double")
    area = pixel_size_m * pixel_size_m
    grouped = clustered.groupBy(*KEYS, "cluster_id").agg(
        F.count(F.lit(1)).alias("pixel_count"),
        F.avg(row).alias("centroid_row"),
        F.avg(col).alias("centroid_col"),
        F.var_samp(row).alias("_vr"),
        F.var_samp(col).alias("_vc"),
        F.covar_samp(row, col).alias("_cv"),
        *[F.avg(name).alias(alias) for name, alias in MEANS.items()],
    )
    shaped = grouped.filter("pixel_count >= 2").withColumn(
        "e_anisotropy", anisotropy(F.col("pixel_count"), F.col("_vr"), F.col("_vc"), F.col("_cv"))
    )
    return (
        shaped.withColumn("orientation_type", orientation(F.col("e_anisotropy")))
        .withColumn("area_m2", F.round(F.col("pixel_count") * area, 1))
        .withColumn("area_ha", F.round(F.col("pixel_count") * area / 10000.0, 3))
        .drop("_vr", "_vc", "_cv")
    )


def field_centres(pixels: DataFrame) -> DataFrame:
    """Mean row and column of the valid pixels of each acquisition."""
    return (
        pixels.filter(S.valid_pixel())
        .groupBy(*KEYS)
        .agg(F.avg("row").alias("centre_row"), F.avg("col").alias("centre_col"))
    )


def diagnosis_code(xylem_flag: Column) -> Column:
    """The first rule that holds for the means of a cluster."""
    ndsi, savi, ndre, bri, ndwi, ndvi = (
        F.col(MEANS[n]) for n in ("NDSI", "SAVI", "NDRE", "BRI", "NDWI", "NDVI")
    )
    dry = (ndwi < 0.25) & (ndre < 0.40)
    return (
        F.when((ndsi >= 0.38) & (savi < 0.30), "SALINITY_OSMOTIC_STRESS")
        .when((ndre < 0.45) & (bri > 1.20) & (ndwi >= 0.38), "EARLY_FUNGAL_INFECTION")
        .when(dry & xylem_flag, "XYLEM_BLOCKADE_ADVANCED_PATHOGEN")
        .when(dry, "HYDRO_STRESS_IRRIGATION_DEFICIT")
        .when((ndre < 0.35) & (ndwi >= 0.30), "NUTRIENT_NITROGEN_DEFICIENCY")
        .when(ndvi < 0.45, "MODERATE_VEGETATION_DECLINE")
        .otherwise("LOCAL_DEVIATION")
    )


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def crop_group(crop: Column) -> Column:
    lowered = F.lower(crop)
    return (
        F.when(_mentions(lowered, K.DIAGNOSIS_COTTON_WORDS), "cotton")
        .when(_mentions(lowered, K.DIAGNOSIS_WHEAT_WORDS), "wheat")
        .otherwise("other")
    )


def diagnosis_table(df: DataFrame) -> DataFrame:
    """The nine fixed (code, crop group) rows with risk level and texts."""
    return df.sparkSession.createDataFrame(
        list(K.DIAGNOSES),
        "diagnosis_code string, crop_group string, risk_level string, diagnosis_title string, "
        "pathogen_name string, recommended_treatment string, agrotechnical_action string",
    )


def diagnose(clusters: DataFrame, fields: DataFrame, xylem: DataFrame) -> DataFrame:
    """D1 with texts. ``fields``: (field_id, crop_name); ``xylem``: (field_id, ndre_before_ndwi)."""
    coded = (
        clusters.join(fields.select("field_id", "crop_name"), "field_id", "left")
        .join(xylem, "field_id", "left")
        .withColumn("crop_name", F.coalesce("crop_name", F.lit("Ekin")))
        .withColumn("ndre_before_ndwi", F.coalesce("ndre_before_ndwi", F.lit(False)))
        .withColumn("diagnosis_code", diagnosis_code(F.col("ndre_before_ndwi")))
        .withColumn(
            "crop_group",
            F.when(F.col("diagnosis_code") == "EARLY_FUNGAL_INFECTION", crop_group(F.col("crop_name")))
            .otherwise("any"),
        )
    )
    # nine constant rows: the broadcast cannot grow
    return coded.join(F.broadcast(diagnosis_table(clusters)), ["diagnosis_code", "crop_group"], "left")


def risk_weight(level: Column) -> Column:
    weight = F.create_map(*[F.lit(x) for pair in K.RISK_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(weight, level), F.lit(0))


def rank_clusters(diagnosed: DataFrame, top: int = 5) -> DataFrame:
    """The worst clusters of each acquisition, with the number of clusters before the cut.

    The rank filter is pushed below the shuffle, so at most ``top`` rows per task and acquisition move.
    """
    order = Window.partitionBy(*KEYS).orderBy(
        risk_weight(F.col("risk_level")).desc(), F.col("pixel_count").desc(), F.col("cluster_id")
    )
    counts = diagnosed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("cluster_count"))
    worst = diagnosed.withColumn("cluster_rank", F.row_number().over(order)).filter(F.col("cluster_rank") <= top)
    return worst.join(counts, KEYS)


def drop_order_flag(history: DataFrame) -> DataFrame:
    """Did NDRE fall before NDWI between the last two observations of a field?

    ``history``: (field_id, index_name, acquired_at, acquisition_id, mean_value); needs two of each index.
    """
    wanted = history.filter(F.col("index_name").isin("NDRE", "NDWI"))
    newest = Window.partitionBy("field_id", "index_name").orderBy(
        F.col("acquired_at").desc(), F.col("acquisition_id").desc()
    )
    two = wanted.withColumn("rn", F.row_number().over(newest)).filter("rn <= 2")

    def at(index: str, rn: int, default: float) -> Column:
        hit = (F.col("index_name") == index) & (F.col("rn") == rn)
        return F.max(F.when(hit, F.coalesce("mean_value", F.lit(default))))

    wide = two.groupBy("field_id").agg(
        at("NDRE", 2, 0.4).alias("ndre_prev"),
        at("NDRE", 1, 0.4).alias("ndre_curr"),
        at("NDWI", 2, 0.3).alias("ndwi_prev"),
        at("NDWI", 1, 0.3).alias("ndwi_curr"),
    )
    fell = (F.col("ndre_prev") - F.col("ndre_curr") > 0.08) & (F.col("ndwi_prev") - F.col("ndwi_curr") < 0.04)
    return wide.select("field_id", F.coalesce(fell, F.lit(False)).alias("ndre_before_ndwi"))


def located_clusters(pixels: DataFrame, clusters: DataFrame) -> DataFrame:
    """The compass sector of every cluster."""
    return located(clusters, field_centres(pixels))


def located(clusters: DataFrame, centres: DataFrame) -> DataFrame:
    """P11 with ``centres`` (keys, centre_row, centre_col)."""
    return clusters.join(centres, KEYS).withColumn(
        "compass_sector",
        S.compass_sector(F.col("centroid_row"), F.col("centroid_col"), F.col("centre_row"), F.col("centre_col")),
    )


def anomaly_clusters(pixels: DataFrame, fields: DataFrame, xylem: DataFrame, tile: int = TILE) -> DataFrame:
    """All clusters of two or more pixels with shape, sector and diagnosis."""
    clusters = cluster_aggregates(cluster_pixels(pixels, tile))
    return diagnose(located_clusters(pixels, clusters), fields, xylem)


def _cluster_struct() -> Column:
    label = F.create_map(*[F.lit(x) for pair in K.SHAPE_LABELS.items() for x in pair])
    rounded = [F.round(MEANS[n], 3).alias(MEANS[n]) for n in ("NDVI", "SAVI", "NDRE", "BRI", "NDWI", "NDSI")]
    return F.struct(
        "cluster_rank", "cluster_id", "pixel_count", "area_m2", "area_ha", "risk_level", "compass_sector",
        F.round("centroid_row", 1).alias("centroid_row"),
        F.round("centroid_col", 1).alias("centroid_col"),
        "e_anisotropy", "orientation_type",
        F.element_at(label, F.col("orientation_type")).alias("orientation_label"),
        "diagnosis_title", "diagnosis_code", "pathogen_name", "recommended_treatment", "agrotechnical_action",
        *rounded,
        F.round(MEANS["Delta_T"], 2).alias("mean_delta_t"),
    )


def anomaly_report(pixels: DataFrame, fields: DataFrame, xylem: DataFrame, tile: int = TILE) -> DataFrame:
    """One row per acquisition with totals, worst clusters, index summary and verdict.

    The pixels are read once: mask and indices are stored, and every part reads them there. One aggregate
    gives sums, sketches, means and centres, a second one proves the brackets and counts anomalous pixels.
    """
    indexed = cut_lineage(biophysical_pixels(pixels))
    under = under_mask(indexed, "row", "col", "valid")
    names = K.BIOPHYSICAL_INDICES
    place = {f"centre_{c}": F.avg(F.when(F.col("valid"), F.col(c))) for c in ("row", "col")}
    known = sketches(under, KEYS, names, valid_pixels=F.count_if("valid"), mean_ndvi=F.round(F.avg("NDVI"), 3), **place)
    known = proven(under, known, KEYS, names, ("mean_ndvi",), anomalous_pixels=F.count_if(F.col("valid") & S.anomalous(F.col("mean_ndvi"))))
    flagged = indexed.filter("valid").join(known.select(*KEYS, "mean_ndvi"), KEYS).filter(S.anomalous(F.col("mean_ndvi")))
    clusters = cluster_aggregates(labelled(cut_lineage(flagged.drop("mean_ndvi")), tile))
    ranked = rank_clusters(diagnose(located(clusters, known.select(*KEYS, "centre_row", "centre_col")), fields, xylem))
    # at most five structs per acquisition
    tops = ranked.groupBy(*KEYS).agg(
        F.max("cluster_count").alias("cluster_count"),
        F.array_sort(F.collect_list(_cluster_struct())).alias("top_clusters"),
    )
    parts = ["min", "mean", "median", "max", "std"]
    summary = rounded(medians(under, known, KEYS, names)).groupBy(*KEYS).agg(
        F.map_from_entries(
            F.array_sort(
                F.collect_list(F.struct("index_name", F.struct(*[F.col(f"{n}_value").alias(n) for n in parts])))
            )
        ).alias("field_metrics_summary")
    )
    joined = (
        totals_of(known)
        .join(tops, KEYS, "left")
        .join(summary, KEYS, "left")
        .join(fields.select("field_id", "crop_name"), "field_id", "left")
        .join(xylem, "field_id", "left")
        .withColumn("crop_name", F.coalesce("crop_name", F.lit("Ekin")))
        .withColumn("cluster_count", F.coalesce("cluster_count", F.lit(0)))
    )
    critical = F.exists("top_clusters", lambda c: c.risk_level == "CRITICAL")
    quiet = (F.col("cluster_count") == 0) | (F.col("anomaly_percentage") < 5.0)
    verdict = F.when(quiet, K.VERDICTS["stable"]).when(critical, K.VERDICTS["critical"]).otherwise(K.VERDICTS["local"])
    return joined.select(
        *KEYS,
        "valid_pixels",
        F.col("anomalous_pixels").alias("total_anomalous_pixels"),
        F.round("anomalous_area_ha", 3).alias("total_anomalous_area_ha"),
        F.round("anomaly_percentage", 2).alias("anomaly_percentage"),
        "cluster_count",
        "top_clusters",
        "field_metrics_summary",
        F.coalesce("ndre_before_ndwi", F.lit(False)).alias("historical_ndre_before_ndwi_drop"),
        F.concat("crop_name", verdict).alias("overall_health_verdict"),
    )
