"""Anomaly clusters, diagnosis and advice over the pixel stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant import constants as K
from verdant.operators import advice, anomaly, zonal
from verdant.queries import standins as st
from verdant.queries.registry import query
from verdant.session import cut_lineage

KEYS = zonal.KEYS
TILE = 8  # the stand-in grids are 16 x 16; small tiles make the contraction step work

# Components: pixel pairs that touch, closed under reachability, then numbered by first pixel.
COMPONENTS = f"""
{st.PIXELS}, {st.BIO}, {st.FLAGGED},
a AS (SELECT acquisition_id, "row" * 16 + col AS p, "row" AS r, col AS c FROM flagged WHERE anomalous),
pairs AS (SELECT x.acquisition_id, x.p, y.p AS q FROM a x JOIN a y
  ON x.acquisition_id = y.acquisition_id AND abs(x.r - y.r) <= 1 AND abs(x.c - y.c) <= 1),
reach AS (SELECT acquisition_id, p, q FROM pairs UNION
  SELECT r.acquisition_id, r.p, s.q FROM reach r JOIN pairs s ON r.acquisition_id = s.acquisition_id AND r.q = s.p),
roots AS (SELECT acquisition_id, p, min(q) AS root FROM reach GROUP BY 1, 2),
numbered AS (SELECT acquisition_id, p, dense_rank() OVER (PARTITION BY acquisition_id ORDER BY root) AS cluster_id FROM roots),
clustered AS (SELECT flagged.*, cluster_id FROM flagged JOIN numbered
  ON flagged.acquisition_id = numbered.acquisition_id AND "row" * 16 + col = p WHERE anomalous)"""

AGGREGATES = f"""{COMPONENTS},
g AS (SELECT field_id, acquisition_id, cluster_id, count(*) AS pixel_count, avg("row") AS centroid_row, avg(col) AS centroid_col,
    var_samp("row") AS vr, var_samp(col) AS vc, covar_samp("row", col) AS cv,
    {', '.join(f'avg({n}) AS {a}' for n, a in anomaly.MEANS.items())}
  FROM clustered GROUP BY 1, 2, 3 HAVING count(*) >= 2),
shaped AS (SELECT *, CASE WHEN pixel_count < 3 THEN 1.0::DOUBLE ELSE round(sqrt(
    greatest(0::DOUBLE, (vr + vc) / 2 + sqrt(((vr - vc) / 2) * ((vr - vc) / 2) + cv * cv))
    / (greatest(0::DOUBLE, (vr + vc) / 2 - sqrt(((vr - vc) / 2) * ((vr - vc) / 2) + cv * cv)) + 1e-4::DOUBLE)), 2) END AS e_anisotropy
  FROM g)"""


def stored_pixels(spark, sf):
    """The pixels written once: flags, means, clusters and centres each read them."""
    return cut_lineage(st.pixels(spark, sf))


def clustered(spark, sf):
    return anomaly.cluster_pixels(stored_pixels(spark, sf), TILE)


# The closure of all pixel pairs is quadratic per cluster, so SQL states it on whole tables only
# where its run time stays in minutes; the Spark job itself never builds pairs.
@query("connected_components", f"""WITH RECURSIVE {COMPONENTS}
SELECT field_id, acquisition_id, "row", col, cluster_id FROM clustered""")
def _(spark, sf):
    return clustered(spark, sf).select(*zonal.PIXEL, "cluster_id")


MEAN_COLUMNS = list(anomaly.MEANS.values())


@query("cluster_aggregates", f"""WITH RECURSIVE {AGGREGATES}
SELECT field_id, acquisition_id, cluster_id, pixel_count, pixel_count * 100.0::DOUBLE AS area_m2, round(pixel_count * 0.01::DOUBLE, 3) AS area_ha,
  round(centroid_row, 6) AS centroid_row, round(centroid_col, 6) AS centroid_col, e_anisotropy,
  CASE WHEN e_anisotropy > 3 THEN 'linear_furrow' ELSE 'concentric_radial' END AS orientation_type,
  {', '.join(f'round({a}, 6) AS {a}' for a in MEAN_COLUMNS)} FROM shaped""")
def _(spark, sf):
    df = anomaly.cluster_aggregates(clustered(spark, sf))
    rounded = [F.round(c, 6).alias(c) for c in ["centroid_row", "centroid_col", *MEAN_COLUMNS]]
    return df.select(*KEYS, "cluster_id", "pixel_count", "area_m2", "area_ha", "e_anisotropy", "orientation_type", *rounded)


def zonal_history(pixels):
    """NDRE and NDWI means per acquisition, the history behind the drop-order flag."""
    px = zonal.biophysical_pixels(pixels, keep_invalid=False)
    long = px.unpivot(KEYS, ["NDRE", "NDWI"], "index_name", "value")
    return long.groupBy(*KEYS, "index_name").agg(F.avg("value").alias("mean_value")).withColumn(
        "acquired_at", F.col("acquisition_id") % 10000
    )


FLAG = """
hist AS (SELECT field_id, acquisition_id, avg(NDRE) AS e, avg(NDWI) AS w FROM bio WHERE valid GROUP BY 1, 2),
two AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY acquisition_id DESC) AS rn FROM hist),
flag AS (SELECT field_id, coalesce(max(e) FILTER (rn = 2) - max(e) FILTER (rn = 1) > 0.08
    AND max(w) FILTER (rn = 2) - max(w) FILTER (rn = 1) < 0.04, false) AS ndre_before_ndwi
  FROM two WHERE rn <= 2 GROUP BY 1)"""


@query("ndre_drop_before_ndwi", f"WITH {st.PIXELS}, {st.BIO}, {FLAG} SELECT * FROM flag")
def _(spark, sf):
    return anomaly.drop_order_flag(zonal_history(st.pixels(spark, sf)))


def _diagnosis_case() -> str:
    return """CASE WHEN mean_ndsi >= 0.38 AND mean_savi < 0.30 THEN 'SALINITY_OSMOTIC_STRESS'
    WHEN mean_ndre < 0.45 AND mean_bri > 1.20 AND mean_ndwi >= 0.38 THEN 'EARLY_FUNGAL_INFECTION'
    WHEN mean_ndwi < 0.25 AND mean_ndre < 0.40 THEN CASE WHEN ndre_before_ndwi THEN 'XYLEM_BLOCKADE_ADVANCED_PATHOGEN' ELSE 'HYDRO_STRESS_IRRIGATION_DEFICIT' END
    WHEN mean_ndre < 0.35 AND mean_ndwi >= 0.30 THEN 'NUTRIENT_NITROGEN_DEFICIENCY'
    WHEN mean_ndvi < 0.45 THEN 'MODERATE_VEGETATION_DECLINE' ELSE 'LOCAL_DEVIATION' END"""


_SECTOR = "degrees(atan2(centre_row - centroid_row, centroid_col - centre_col))"
_DIAGNOSES = ", ".join(
    "(" + ", ".join("NULL" if v is None else st.sql_text(v) for v in row) + ")" for row in K.DIAGNOSES
)
DIAGNOSED = f"""{AGGREGATES}, {FLAG}, {st.FIELDS},
centres AS (SELECT field_id, acquisition_id, avg("row") AS centre_row, avg(col) AS centre_col FROM masked WHERE valid GROUP BY 1, 2),
texts(diagnosis_code, crop_group, risk_level, diagnosis_title, pathogen_name, recommended_treatment, agrotechnical_action) AS (VALUES {_DIAGNOSES}),
coded AS (SELECT shaped.*, fields.crop_name, {_diagnosis_case()} AS diagnosis_code,
    CASE WHEN sqrt((centre_row - centroid_row) ** 2 + (centroid_col - centre_col) ** 2) < 1.5 THEN '{K.COMPASS_CENTRE}'
      ELSE [{st.sql_list(K.COMPASS_SECTORS)}][(floor(((CASE WHEN {_SECTOR} < 0 THEN {_SECTOR} + 360 ELSE {_SECTOR} END) + 22.5) / 45)::INTEGER % 8) + 1] END AS compass_sector
  FROM shaped JOIN fields USING (field_id) JOIN flag USING (field_id) JOIN centres USING (field_id, acquisition_id)),
diagnosed AS (SELECT coded.*, risk_level, diagnosis_title, pathogen_name, recommended_treatment, agrotechnical_action
  FROM coded JOIN texts ON coded.diagnosis_code = texts.diagnosis_code AND texts.crop_group = CASE WHEN coded.diagnosis_code <> 'EARLY_FUNGAL_INFECTION' THEN 'any'
    WHEN lower(crop_name) LIKE '%paxta%' OR lower(crop_name) LIKE '%cotton%' THEN 'cotton'
    WHEN lower(crop_name) LIKE '%bug''doy%' OR lower(crop_name) LIKE '%g''alla%' OR lower(crop_name) LIKE '%wheat%' THEN 'wheat' ELSE 'other' END),
ranked AS (SELECT *, count(*) OVER (PARTITION BY acquisition_id) AS cluster_count, row_number() OVER (PARTITION BY acquisition_id ORDER BY
    CASE risk_level WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MODERATE' THEN 1 ELSE 0 END DESC, pixel_count DESC, cluster_id) AS cluster_rank
  FROM diagnosed)"""


def diagnosed(spark, sf):
    px = stored_pixels(spark, sf)
    return anomaly.anomaly_clusters(px, st.fields(spark, sf), anomaly.drop_order_flag(zonal_history(px)), TILE)


@query("cluster_compass_sectors", f"WITH RECURSIVE {DIAGNOSED} SELECT field_id, acquisition_id, cluster_id, compass_sector FROM diagnosed")
def _(spark, sf):
    px = stored_pixels(spark, sf)
    located = anomaly.located_clusters(px, anomaly.cluster_aggregates(anomaly.cluster_pixels(px, TILE)))
    return located.select(*KEYS, "cluster_id", "compass_sector")


@query("differential_diagnosis", f"""WITH RECURSIVE {DIAGNOSED} SELECT field_id, acquisition_id, cluster_id, diagnosis_code, risk_level,
  diagnosis_title, pathogen_name, recommended_treatment, agrotechnical_action FROM diagnosed""")
def _(spark, sf):
    return diagnosed(spark, sf).select(
        *KEYS, "cluster_id", "diagnosis_code", "risk_level", "diagnosis_title", "pathogen_name",
        "recommended_treatment", "agrotechnical_action",
    )


@query("worst_clusters", f"""WITH RECURSIVE {DIAGNOSED} SELECT field_id, acquisition_id, cluster_id, cluster_rank, cluster_count, risk_level, pixel_count
FROM ranked WHERE cluster_rank <= 5""")
def _(spark, sf):
    return anomaly.rank_clusters(diagnosed(spark, sf)).select(
        *KEYS, "cluster_id", "cluster_rank", "cluster_count", "risk_level", "pixel_count"
    )


_VERDICT = f"""CASE WHEN coalesce(n, 0) = 0 OR coalesce(a / v * 100, 0) < 5 THEN {st.sql_text(K.VERDICTS['stable'])}
  WHEN critical THEN {st.sql_text(K.VERDICTS['critical'])} ELSE {st.sql_text(K.VERDICTS['local'])} END"""


# Every field of the report as text, numbers as whole numbers of their last digit, so that both engines write them alike.
_MEANS_TOLD = ("mean_ndvi", "mean_savi", "mean_ndre", "mean_bri", "mean_ndwi", "mean_ndsi")
_SCALED = {"area_m2": 10, "area_ha": 1000, "centroid_row": 10, "centroid_col": 10, "e_anisotropy": 100, **dict.fromkeys(_MEANS_TOLD, 1000), "mean_delta_t": 100}
_TOLD = (
    "cluster_rank", "cluster_id", "pixel_count", "area_m2", "area_ha", "risk_level", "compass_sector", "centroid_row", "centroid_col", "e_anisotropy",
    "orientation_type", "orientation_label", "diagnosis_title", "diagnosis_code", "pathogen_name", "recommended_treatment", "agrotechnical_action", *_MEANS_TOLD, "mean_delta_t",
)
_CLUSTER_TEXT = "concat_ws(':', " + ", ".join(f"CAST(round(round({c}, {len(str(_SCALED[c])) - 1}) * {_SCALED[c]}) AS BIGINT)" if c in _SCALED else c for c in _TOLD) + ")"
_SUMMARY_TEXT = "index_name || ':' || " + " || ':' || ".join(
    f"CAST(coalesce(round(round({a}, 3) * 1000), 0) AS BIGINT)"
    for a in ("min(value) FILTER (valid)", "avg(value) FILTER (valid)", "median(value) FILTER (valid)", "max(value) FILTER (valid)", "stddev_pop(value) FILTER (valid)")
)


@query("anomaly_report", f"""WITH RECURSIVE {DIAGNOSED},
agg AS (SELECT field_id, acquisition_id, count(*) AS v, count(*) FILTER (anomalous) AS a FROM flagged GROUP BY 1, 2),
told AS (SELECT *, pixel_count * 100.0::DOUBLE AS area_m2, pixel_count * 0.01::DOUBLE AS area_ha,
    CASE WHEN e_anisotropy > 3 THEN 'linear_furrow' ELSE 'concentric_radial' END AS orientation_type,
    CASE WHEN e_anisotropy > 3 THEN {st.sql_text(K.SHAPE_LABELS['linear_furrow'])} ELSE {st.sql_text(K.SHAPE_LABELS['concentric_radial'])} END AS orientation_label FROM ranked WHERE cluster_rank <= 5),
tops AS (SELECT acquisition_id, max(cluster_count) AS n, bool_or(risk_level = 'CRITICAL') AS critical, string_agg({_CLUSTER_TEXT}, '|' ORDER BY cluster_rank) AS top_list FROM told GROUP BY 1),
long AS (UNPIVOT bio ON {', '.join(K.BIOPHYSICAL_INDICES)} INTO NAME index_name VALUE value),
each AS (SELECT field_id, acquisition_id, index_name, {_SUMMARY_TEXT} AS one FROM long GROUP BY 1, 2, 3),
summary AS (SELECT field_id, acquisition_id, string_agg(one, '|' ORDER BY index_name) AS field_metrics FROM each GROUP BY 1, 2)
SELECT field_id, acquisition_id, coalesce(v, 0) AS valid_pixels, coalesce(a, 0) AS total_anomalous_pixels,
  coalesce(round(a * 0.01::DOUBLE, 3), 0) AS total_anomalous_area_ha, coalesce(round(a / v * 100::DOUBLE, 2), 0) AS anomaly_percentage,
  coalesce(n, 0) AS cluster_count, coalesce(top_list, '') AS top_list, field_metrics,
  coalesce(ndre_before_ndwi, false) AS historical_ndre_before_ndwi_drop, crop_name || {_VERDICT} AS overall_health_verdict
FROM (SELECT DISTINCT field_id, acquisition_id FROM pixels) LEFT JOIN agg USING (field_id, acquisition_id)
LEFT JOIN tops USING (acquisition_id) LEFT JOIN fields USING (field_id) LEFT JOIN flag USING (field_id) LEFT JOIN summary USING (field_id, acquisition_id)""")
def report_query(spark, sf):
    px = st.pixels(spark, sf)
    flag = anomaly.drop_order_flag(zonal_history(px))
    report = anomaly.anomaly_report(px, st.fields(spark, sf), flag, TILE)
    whole = lambda c, scale: F.round(c * scale).cast("long").cast("string")
    entry = F.transform("top_clusters", lambda c: F.concat_ws(":", *[whole(c[n], _SCALED[n]) if n in _SCALED else c[n].cast("string") for n in _TOLD]))
    metrics = F.transform(F.map_entries("field_metrics_summary"), lambda m: F.concat_ws(":", m.key, *[whole(m.value[n], 1000) for n in ("min", "mean", "median", "max", "std")]))
    return report.select(
        *KEYS, "valid_pixels", "total_anomalous_pixels", "total_anomalous_area_ha", "anomaly_percentage", "cluster_count",
        F.coalesce(F.array_join(entry, "|"), F.lit("")).alias("top_list"),
        F.array_join(metrics, "|").alias("field_metrics"),
        "historical_ndre_before_ndwi_drop", "overall_health_verdict",
    )
