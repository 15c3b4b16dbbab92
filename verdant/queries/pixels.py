"""Pixel projections and zonal statistics over the pixel stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant import constants as K
from verdant.functions import spectral as S
from verdant.operators import zonal
from verdant.queries import standins as st
from verdant.queries.registry import query
from verdant.session import cut_lineage


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def sql_r6(*names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


KEYS = zonal.KEYS


@query("valid_pixel_mask", f"WITH {st.PIXELS} SELECT field_id, acquisition_id, \"row\", col, valid FROM masked")
def _(spark, sf):
    px = st.pixels(spark, sf)
    return px.select(*zonal.PIXEL, S.valid_pixel().alias("valid"))


@query("safe_ratio_forms", f"""WITH {st.PIXELS}
SELECT field_id, acquisition_id, "row", col,
  CASE WHEN valid AND B03 - B02 - 0.05::DOUBLE <> 0
       THEN greatest(-1::DOUBLE, least(1::DOUBLE, (B08 - B11) / (B03 - B02 - 0.05::DOUBLE))) END AS as_null,
  CASE WHEN valid AND B03 - B02 - 0.05::DOUBLE <> 0
       THEN (B08 - B11) / (B03 - B02 - 0.05::DOUBLE) ELSE 1::DOUBLE END AS as_fill
FROM masked""")
def _(spark, sf):
    px = st.pixels(spark, sf).withColumn("valid", S.valid_pixel())
    num, den, ok = F.col("B08") - F.col("B11"), F.col("B03") - F.col("B02") - 0.05, F.col("valid")
    return px.select(
        *zonal.PIXEL,
        S.ratio(num, den, ok).alias("as_null"),
        S.ratio_or(num, den, ok, 1.0).alias("as_fill"),
    )


@query("core_indices", f"""WITH {st.PIXELS}, {st.CORE}
SELECT field_id, acquisition_id, "row", col, valid, {", ".join(K.CORE_INDICES)} FROM core""")
def _(spark, sf):
    df = zonal.core_index_pixels(st.pixels(spark, sf))
    return df.select(*zonal.PIXEL, "valid", *K.CORE_INDICES)


@query("biophysical_indices", f"""WITH {st.PIXELS}, {st.BIO}
SELECT field_id, acquisition_id, "row", col, valid, {", ".join(K.BIOPHYSICAL_INDICES)} FROM bio""")
def _(spark, sf):
    df = zonal.biophysical_pixels(st.pixels(spark, sf))
    return df.select(*zonal.PIXEL, "valid", *K.BIOPHYSICAL_INDICES)


STATS = ("min_value", "mean_value", "median_value", "max_value")


@query("zonal_statistics", f"""WITH {st.PIXELS}, {st.CORE}
SELECT field_id, acquisition_id, index_name, round(min(value), 6) AS min_value, round(avg(value), 6) AS mean_value,
  round(median(value), 6) AS median_value, round(max(value), 6) AS max_value, count(value) AS valid_pixel_count
FROM core_long GROUP BY 1, 2, 3""")
def zonal_query(spark, sf):
    return zonal.zonal_statistics(cut_lineage(st.pixels(spark, sf))).select(
        *KEYS, "index_name", *r6(*STATS), "valid_pixel_count"
    )


@query("index_distribution", f"""WITH {st.PIXELS}, {st.BIO},
long AS (UNPIVOT bio ON {', '.join(K.BIOPHYSICAL_INDICES)} INTO NAME index_name VALUE value)
SELECT field_id, acquisition_id, index_name,
  coalesce(round(min(value) FILTER (valid), 3), 0) AS min_value, coalesce(round(avg(value) FILTER (valid), 3), 0) AS mean_value,
  coalesce(round(median(value) FILTER (valid), 3), 0) AS median_value, coalesce(round(max(value) FILTER (valid), 3), 0) AS max_value,
  coalesce(round(stddev_pop(value) FILTER (valid), 3), 0) AS std_value
FROM long GROUP BY 1, 2, 3""")
def _(spark, sf):
    return zonal.index_distribution(cut_lineage(st.pixels(spark, sf)))


@query("anomalous_pixels", f"""WITH {st.PIXELS}, {st.BIO}, {st.FLAGGED}
SELECT field_id, acquisition_id, "row", col, anomalous FROM flagged""")
def _(spark, sf):
    return zonal.flag_anomalies(st.pixels(spark, sf)).select(*zonal.PIXEL, "anomalous")


@query("anomaly_totals", f"""WITH {st.PIXELS}, {st.BIO}, {st.FLAGGED},
agg AS (SELECT field_id, acquisition_id, count(*) AS v, count(*) FILTER (anomalous) AS a FROM flagged GROUP BY 1, 2)
SELECT field_id, acquisition_id, coalesce(v, 0) AS valid_pixels, coalesce(a, 0) AS anomalous_pixels,
  round(coalesce(a * 0.01::DOUBLE, 0), 6) AS anomalous_area_ha, round(coalesce(a / v * 100.0::DOUBLE, 0), 6) AS anomaly_percentage
FROM (SELECT DISTINCT field_id, acquisition_id FROM pixels) LEFT JOIN agg USING (field_id, acquisition_id)""")
def _(spark, sf):
    return zonal.anomaly_totals(st.pixels(spark, sf)).select(
        *KEYS, "valid_pixels", "anomalous_pixels", *r6("anomalous_area_ha", "anomaly_percentage")
    )


@query("quality_class_histogram", f"""WITH {st.PIXELS}
SELECT field_id, acquisition_id, CASE WHEN scl = 3 THEN 'shadow' WHEN scl IN (8, 9, 10) THEN 'cloud'
  WHEN scl IN (0, 1, 11) THEN 'invalid' ELSE 'clear' END AS quality, count(*) AS pixels
FROM pixels WHERE data_mask GROUP BY 1, 2, 3""")
def _(spark, sf):
    return zonal.quality_histogram(st.pixels(spark, sf))


@query("severity_band_histogram", f"""WITH {st.PIXELS}, {st.CORE},
n AS (SELECT field_id, acquisition_id, index_name AS layer_name,
  greatest(0::DOUBLE, least(1::DOUBLE, CASE WHEN index_name IN ('NDVI', 'NDRE', 'EVI') THEN coalesce(value, 0) / 0.85::DOUBLE
    WHEN index_name = 'NDMI' THEN (coalesce(value, 0) + 0.2::DOUBLE) / 0.8::DOUBLE
    ELSE (coalesce(value, 0) + 0.3::DOUBLE) / 0.8::DOUBLE END)) AS norm FROM core_long WHERE valid)
SELECT field_id, acquisition_id, layer_name,
  CASE WHEN layer_name IN ('NDVI', 'NDRE', 'EVI') THEN CASE WHEN norm < 0.4 THEN 0 WHEN norm < 0.7 THEN 1 ELSE 2 END
       WHEN norm < 0.5 THEN 0 ELSE 1 END AS band, count(*) AS pixels
FROM n GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    return zonal.severity_histogram(st.pixels(spark, sf))


@query("ndre_hotspots", f"""WITH {st.PIXELS}, {st.CORE}, {st.FIELDS},
low AS (SELECT field_id, acquisition_id, "row", col, NDRE FROM core WHERE NDRE IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY field_id, acquisition_id ORDER BY NDRE, "row", col) = 1)
SELECT field_id, acquisition_id, round(NDRE, 6) AS ndre,
  round(latitude + (15 - "row") / 15.0::DOUBLE * 0.25::DOUBLE, 6) AS lat, round(longitude + col / 15.0::DOUBLE * 0.125::DOUBLE, 6) AS lon
FROM low JOIN fields USING (field_id)""")
def _(spark, sf):
    px = st.pixels(spark, sf)
    grids = px.select(*KEYS).distinct().join(st.fields(spark, sf), "field_id").select(
        *KEYS,
        F.lit(16).alias("width"),
        F.lit(16).alias("height"),
        F.col("longitude").alias("min_lon"),
        F.col("latitude").alias("min_lat"),
        (F.col("longitude") + 0.125).alias("max_lon"),
        (F.col("latitude") + 0.25).alias("max_lat"),
    )
    return zonal.hotspots(px, grids).select(*KEYS, *r6("ndre"), "lat", "lon")
