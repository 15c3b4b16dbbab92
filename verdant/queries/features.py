"""Monthly features and yield scoring over order (weather, radar) and line item (optical) stand-ins."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.operators import features as fx
from verdant.operators import store
from verdant.operators import yields as yx
from verdant.plans import yield_job
from verdant.queries import standins as st
from verdant.queries import weather as wq
from verdant.queries.registry import query, table
from verdant.session import cut_lineage

YEAR = 1995


def _season(df):
    return df.withColumn("harvest_date", F.lit("1995-10-15").cast("date")).withColumnRenamed("planted_on", "planting_date")


def weather(spark, sf):
    place = _season(st.fields(spark, sf)).select("field_id", "latitude", "longitude", "planting_date", "harvest_date")
    return fx.with_crop_time(wq.daily(spark, sf).join(place, "field_id"))


CROP_TIME = f"""{wq.DAILY}, {st.FIELDS},
wx AS (SELECT daily.*, strftime(date, '%Y-%m') AS year_month, latitude, longitude, weather_total_precipitation - weather_evapotranspiration_et0 AS weather_water_balance,
  greatest(date_diff('day', planted_on, date), 0) AS crop_age_days, greatest(date_diff('day', date, DATE '1995-10-15'), 0) AS days_to_harvest,
  least(1::DOUBLE, greatest(date_diff('day', planted_on, date), 0) / greatest(date_diff('day', planted_on, DATE '1995-10-15'), 1)) AS season_progress_ratio,
  CASE WHEN weather_total_precipitation >= 0.1 THEN 1 ELSE 0 END AS is_rainy_day FROM daily JOIN fields USING (field_id))"""


def optical(spark, sf):
    """Bands per five suppliers and shipping day; prime divisors. A fifth of a field's months has no bands."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    low, high, thin, thick = F.min(n), F.max(n), F.min(q), F.max(q)
    bands = [(low + 2) / 127.0, (high + 4) / 127.0, (high + 2) / 127.0, (high + 8) / 127.0, (thin + 16) / 251.0, (thin + 24) / 251.0,
             (thick + 32) / 251.0, (thick + 34) / 251.0, (thick + 16) / 509.0, (thick + 8) / 509.0]
    cloud = (F.max("l_partkey") % 100).cast("double")
    days = (
        table(spark, sf, "lineitem")
        .groupBy(F.expr("l_suppkey div 5").alias("field_id"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(*[b.alias(c) for b, c in zip(bands, K.OPTICAL_BANDS, strict=True)], cloud.alias("s2_cloud_percentage"), (cloud * 0.8).alias("s2_cloud_probability"))
    )
    return days.withColumns({c: F.when(_measured(5), F.col(c)) for c in K.OPTICAL_BANDS})


def _measured(every: int):
    """False for one month of ``every`` of a field."""
    return (F.col("field_id") * 12 + F.year("date") * 7 + F.month("date")) % every != 0


def _measured_sql(every: int) -> str:
    return f"(field_id * 12 + year(date) * 7 + month(date)) % {every} <> 0"


_BANDS = ["(min(l_linenumber) + 2) / 127.0", "(max(l_linenumber) + 4) / 127.0", "(max(l_linenumber) + 2) / 127.0", "(max(l_linenumber) + 8) / 127.0",
          "(min(l_quantity) + 16) / 251.0", "(min(l_quantity) + 24) / 251.0", "(max(l_quantity) + 32) / 251.0", "(max(l_quantity) + 34) / 251.0",
          "(max(l_quantity) + 16) / 509.0", "(max(l_quantity) + 8) / 509.0"]
_N = "b08 - b04"
_INDEX = {
    "s2_ndvi": "(b08 - b04) / (b08 + b04 + e)", "s2_evi": "2.5::DOUBLE * ((b08 - b04) / (b08 + 6::DOUBLE * b04 - 7.5::DOUBLE * b02 + 1::DOUBLE + e))",
    "s2_gndvi": "(b08 - b03) / (b08 + b03 + e)", "s2_savi": "1.5::DOUBLE * ((b08 - b04) / (b08 + b04 + 0.5::DOUBLE + e))",
    "s2_msavi": "(2::DOUBLE * b08 + 1 - sqrt(greatest(0::DOUBLE, (2::DOUBLE * b08 + 1) * (2::DOUBLE * b08 + 1) - 8::DOUBLE * (b08 - b04)))) / 2",
    "s2_osavi": "(b08 - b04) / (b08 + b04 + 0.16::DOUBLE + e)", "s2_ndre": "(b08 - b05) / (b08 + b05 + e)", "s2_ci_red_edge": "b08 / (b05 + e) - 1",
    "s2_ndwi": "(b03 - b08) / (b03 + b08 + e)", "s2_ndmi": "(b08 - b11) / (b08 + b11 + e)",
}
OPTICAL = f"""
op00 AS (SELECT l_suppkey // 5 AS field_id, CAST(l_shipdate AS DATE) AS date, {', '.join(f'{b}::DOUBLE AS {c}' for b, c in zip(_BANDS, K.OPTICAL_BANDS, strict=True))},
  (max(l_partkey) % 100)::DOUBLE AS s2_cloud_percentage, (max(l_partkey) % 100)::DOUBLE * 0.8::DOUBLE AS s2_cloud_probability
  FROM lineitem GROUP BY 1, 2),
op0 AS (SELECT field_id, date, s2_cloud_percentage, s2_cloud_probability, {', '.join(f'CASE WHEN {_measured_sql(5)} THEN {c} END AS {c}' for c in K.OPTICAL_BANDS)} FROM op00),
op1 AS (SELECT *, strftime(date, '%Y-%m') AS year_month, s2_b02_blue AS b02, s2_b03_green AS b03, s2_b04_red AS b04, s2_b05_red_edge_1 AS b05, s2_b08_nir AS b08,
  s2_b11_swir_1 AS b11, 1e-8::DOUBLE AS e FROM op0),
op AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _INDEX.items())} FROM op1)"""


def radar(spark, sf):
    """Backscatter per fifty customers and order day; a third of a field's months has none."""
    w = F.floor(F.max("o_totalprice")).cast("long")
    days = (
        table(spark, sf, "orders")
        .groupBy(F.expr("o_custkey div 50").alias("field_id"), F.col("o_orderdate").cast("date").alias("date"))
        .agg((w % 64 / 61.0 - 12.0).alias("s1_vv"), (w % 96 / 61.0 - 17.0).alias("s1_vh"))
    )
    return days.withColumns({c: F.when(_measured(3), F.col(c)) for c in ("s1_vv", "s1_vh")})


RADAR = """
ra0 AS (SELECT o_custkey // 50 AS field_id, CAST(o_orderdate AS DATE) AS date, CAST(floor(max(o_totalprice)) AS BIGINT) AS w0 FROM orders GROUP BY 1, 2),
ra1 AS (SELECT field_id, date, CASE WHEN """ + _measured_sql(3) + """ THEN w0 END AS w FROM ra0),
ra AS (SELECT field_id, date, strftime(date, '%Y-%m') AS year_month, (w % 64) / 61.0::DOUBLE - 12 AS s1_vv, (w % 96) / 61.0::DOUBLE - 17 AS s1_vh,
  ((w % 64) / 61.0::DOUBLE - 12) - ((w % 96) / 61.0::DOUBLE - 17) AS s1_vv_vh_ratio FROM ra1)"""

_HOW = {"mean": "avg({})", "min": "min({})", "max": "max({})", "sum": "coalesce(sum({}), 0)", "std": "stddev_samp({})"}


def _sql_aggs(spec):
    return ", ".join(f"{_HOW[h].format(c)} AS {c}_{h}" for c, hs in spec for h in hs)


MONTHLY_W = f"""mw AS (SELECT field_id, year_month, min_by(longitude, date) AS longitude, min_by(latitude, date) AS latitude,
  {', '.join(f'round(avg({c}), 2) AS {c}' for c in fx.CROP_TIME)}, {_sql_aggs(fx.WEATHER_MONTHLY)}, sum(is_rainy_day)::BIGINT AS weather_rainy_days_count,
  max(weather_temperature_2m) - min(weather_temperature_2m) AS weather_temperature_2m_range FROM wx GROUP BY 1, 2)"""
MONTHLY_O = f"mo AS (SELECT field_id, year_month, {_sql_aggs(fx.OPTICAL_MONTHLY)} FROM op GROUP BY 1, 2)"
MONTHLY_R = f"mr AS (SELECT field_id, year_month, {_sql_aggs(fx.RADAR_MONTHLY)} FROM ra GROUP BY 1, 2)"


def _r6(names):
    return [F.round(c, 9).alias(c) for c in names]


def _s6(names):
    return ", ".join(f"round({c}, 9) AS {c}" for c in names)


@query("crop_calendar", f"""WITH {st.FIELDS}, n AS (SELECT field_id, lower(crop_name) AS c, planted_on FROM fields)
SELECT field_id, CASE WHEN c LIKE '%paxta%' OR c LIKE '%g''o''za%' THEN 'cotton' WHEN c LIKE '%bug''doy%' OR c LIKE '%bug‘doy%' OR c LIKE '%arpa%' THEN 'wheat' ELSE 'cotton' END AS crop,
  strftime(planted_on, '%Y-%m-%d') AS planting, CASE WHEN c LIKE '%paxta%' OR c LIKE '%g''o''za%' OR c = 'kartoshka' THEN '2026-10-15' ELSE '2026-06-25' END AS harvest FROM n""")
def _(spark, sf):
    df = fx.with_calendar(st.fields(spark, sf))
    return df.select("field_id", "crop", F.date_format("planting_date", "yyyy-MM-dd").alias("planting"), F.date_format("harvest_date", "yyyy-MM-dd").alias("harvest"))


@query("crop_time_features", f"""WITH {CROP_TIME} SELECT field_id, {wq.DAY}, weather_water_balance, crop_age_days, days_to_harvest,
  season_progress_ratio, is_rainy_day FROM wx""")
def _(spark, sf):
    return weather(spark, sf).select(
        "field_id", wq.day(), "weather_water_balance", "crop_age_days", "days_to_harvest", "season_progress_ratio", "is_rainy_day"
    )


@query("monthly_model_indices", f"WITH {OPTICAL} SELECT field_id, {wq.DAY}, {', '.join(K.OPTICAL_INDICES)} FROM op")
def _(spark, sf):
    return fx.with_optical_indices(optical(spark, sf)).select("field_id", wq.day(), *K.OPTICAL_INDICES)


@query("radar_ratio", f"WITH {RADAR} SELECT field_id, {wq.DAY}, s1_vv, s1_vh, s1_vv_vh_ratio FROM ra")
def _(spark, sf):
    return fx.with_radar_ratio(radar(spark, sf)).select("field_id", wq.day(), "s1_vv", "s1_vh", "s1_vv_vh_ratio")


@query("monthly_weather", f"WITH {CROP_TIME}, {MONTHLY_W} SELECT field_id, year_month, {_s6(fx.WEATHER_COLUMNS)} FROM mw")
def _(spark, sf):
    return fx.monthly_weather(weather(spark, sf)).select(*fx.MONTH, *_r6(fx.WEATHER_COLUMNS))


_OPT, _RAD = fx.SATELLITE_COLUMNS[:72], fx.SATELLITE_COLUMNS[72:]


@query("monthly_optical", f"WITH {OPTICAL}, {MONTHLY_O} SELECT field_id, year_month, {_s6(_OPT)} FROM mo")
def _(spark, sf):
    return fx.monthly_optical(fx.with_optical_indices(optical(spark, sf))).select(*fx.MONTH, *_r6(_OPT))


@query("monthly_radar", f"WITH {RADAR}, {MONTHLY_R} SELECT field_id, year_month, {_s6(_RAD)} FROM mr")
def _(spark, sf):
    return fx.monthly_radar(fx.with_radar_ratio(radar(spark, sf))).select(*fx.MONTH, *_r6(_RAD))


def _gap(c):
    return (
        f"coalesce({c}, lb_{c} + (fa_{c} - lb_{c}) / (fi_{c} - li_{c}) * (i - li_{c}), lb_{c}, fa_{c}, 0) AS {c}"
    )


def _bounds(c):
    return (
        f"last_value({c} IGNORE NULLS) OVER back AS lb_{c}, last_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER back AS li_{c}, "
        f"first_value({c} IGNORE NULLS) OVER ahead AS fa_{c}, first_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER ahead AS fi_{c}"
    )


MATRIX = f"""{CROP_TIME}, {OPTICAL}, {RADAR}, {MONTHLY_W}, {MONTHLY_O}, {MONTHLY_R},
merged AS (SELECT * FROM mw LEFT JOIN mo USING (field_id, year_month) LEFT JOIN mr USING (field_id, year_month)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY year_month) AS i FROM merged),
bounds AS (SELECT *, {', '.join(_bounds(c) for c in fx.SATELLITE_COLUMNS)} FROM numbered
  WINDOW back AS (PARTITION BY field_id ORDER BY year_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY field_id ORDER BY year_month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT field_id, year_month, {', '.join(fx.WEATHER_COLUMNS)}, {', '.join(_gap(c) for c in fx.SATELLITE_COLUMNS)} FROM bounds),
years AS (SELECT *, CAST(substr(year_month, 1, 4) AS INTEGER) AS y, CAST(substr(year_month, 6, 2) AS INTEGER) AS m FROM filled),
kept AS (SELECT * FROM years QUALIFY y = {YEAR} OR NOT bool_or(y = {YEAR}) OVER (PARTITION BY field_id)),
matrix AS (SELECT field_id, year_month, {', '.join(c if c == 'weather_rainy_days_count' else f'round({c}, 2) AS {c}' for c in [*fx.WEATHER_COLUMNS, *fx.SATELLITE_COLUMNS])},
  round(round(sin({2 * math.pi!r}::DOUBLE * m / 12), 4), 2) AS month_sin, round(round(cos({2 * math.pi!r}::DOUBLE * m / 12), 4), 2) AS month_cos FROM kept)"""


@query("gap_filled_months", f"WITH {MATRIX} SELECT field_id, year_month, {_s6(fx.SATELLITE_COLUMNS)} FROM filled")
def _(spark, sf):
    merged = fx.merge_months(
        fx.monthly_weather(weather(spark, sf)),
        fx.monthly_optical(fx.with_optical_indices(optical(spark, sf))),
        fx.monthly_radar(fx.with_radar_ratio(radar(spark, sf))),
    )
    return fx.fill_gaps(merged).select(*fx.MONTH, *_r6(fx.SATELLITE_COLUMNS))


def matrix(spark, sf):
    return fx.monthly_features(weather(spark, sf), optical(spark, sf), radar(spark, sf), YEAR)


@query("monthly_feature_matrix", f"WITH {MATRIX} SELECT field_id, year_month, {', '.join(fx.FEATURES)} FROM matrix")
def _(spark, sf):
    return matrix(spark, sf)


_MONTHS = """
po AS (SELECT field_id, month(date) AS month, avg(s2_ndvi) AS ndvi, avg(s2_evi) AS evi, avg(s2_ndre) AS ndre, avg(s2_ndmi) AS ndmi FROM op GROUP BY 1, 2),
pr AS (SELECT field_id, month(date) AS month, avg(s1_vh) AS s1_vh, avg(s1_vv_vh_ratio) AS s1_vv_vh FROM ra GROUP BY 1, 2),
pw AS (SELECT field_id, month(date) AS month, avg(weather_temperature_2m) AS temp_mean, sum(weather_total_precipitation) AS rain_sum, avg(weather_soil_moisture_0_7cm) AS soil_moisture FROM wx GROUP BY 1, 2)"""


@query("phenology_timeline", f"""WITH {CROP_TIME}, {OPTICAL}, {RADAR}, {_MONTHS},
j AS (SELECT * FROM (SELECT * FROM po FULL JOIN pw USING (field_id, month)) LEFT JOIN pr USING (field_id, month)),
bare AS (SELECT field_id, unnest([4, 5, 6, 7, 8, 9, 10]) AS month FROM (SELECT o_custkey AS field_id FROM orders UNION SELECT field_id FROM fields) WHERE field_id NOT IN (SELECT field_id FROM j))
SELECT field_id, month::INTEGER AS month, {', '.join(f'coalesce(round({n}, 3), {d}::DOUBLE) AS {n}' for n, d in K.PHENOLOGY_DEFAULTS.items())} FROM j
UNION ALL SELECT field_id, month::INTEGER, {', '.join(f'coalesce(round({n}, 3), {d}::DOUBLE)' if n.startswith('s1') else f'{d}::DOUBLE' for n, d in K.PHENOLOGY_DEFAULTS.items())}
FROM bare LEFT JOIN pr USING (field_id, month)""")
def _(spark, sf):
    every = table(spark, sf, "orders").select(F.col("o_custkey").alias("field_id")).union(st.fields(spark, sf).select("field_id")).distinct()
    seen = fx.with_optical_indices(optical(spark, sf))
    return fx.phenology(seen, fx.with_radar_ratio(radar(spark, sf)), weather(spark, sf), every)


_B = {"x": "greatest(0.06::DOUBLE, 0.05::DOUBLE * (1 + ndvi) / greatest(0.01::DOUBLE, 1 - ndvi))"}


@query("optical_from_index_means", f"""WITH {st.STORE},
p AS (SELECT a.acquisition_id, a.field_id, CAST(acquired_at AS DATE) AS date, coalesce(max(mean_value) FILTER (index_name = 'NDVI'), 0.65::DOUBLE) AS ndvi,
  coalesce(max(mean_value) FILTER (index_name = 'NDRE'), 0.45::DOUBLE) AS ndre, coalesce(max(mean_value) FILTER (index_name = 'NDMI'), 0.35::DOUBLE) AS ndmi,
  CASE WHEN cloud_coverage IS NULL OR cloud_coverage = 0 THEN 10 ELSE cloud_coverage END AS cc
  FROM acquisitions a JOIN index_values v ON a.acquisition_id = v.acquisition_id GROUP BY ALL),
b AS (SELECT *, {_B['x']} AS b08 FROM p), c AS (SELECT *, greatest(0.06::DOUBLE, b08 * 1.05::DOUBLE) AS b8a FROM b),
d AS (SELECT *, greatest(0.04::DOUBLE, b8a * (1 - ndre) / greatest(0.01::DOUBLE, 1 + ndre)) AS b05, greatest(0.03::DOUBLE, b08 * (1 - ndmi) / greatest(0.01::DOUBLE, 1 + ndmi)) AS b11 FROM c)
SELECT field_id, strftime(date, '%Y-%m-%d') AS date, round(b05, 4) AS s2_b05_red_edge_1, round(b05 * 1.4::DOUBLE, 4) AS s2_b06_red_edge_2, round(b05 * 1.8::DOUBLE, 4) AS s2_b07_red_edge_3,
  round(b08, 4) AS s2_b08_nir, round(b8a, 4) AS s2_b8a_nir_narrow, round(b11, 4) AS s2_b11_swir_1, round(b11 * 0.6::DOUBLE, 4) AS s2_b12_swir_2,
  cc AS s2_cloud_percentage, cc * 0.8::DOUBLE AS s2_cloud_probability FROM d""")
def _(spark, sf):
    points = store.series(st.acquisitions(spark, sf), st.index_values(spark, sf))
    built = fx.optical_from_means(points)
    return built.select("field_id", wq.day(), *K.OPTICAL_BANDS[3:], "s2_cloud_percentage", "s2_cloud_probability")


@query("baseline_observation_spine", f"""WITH {st.FIELDS}, c AS (SELECT field_id, CASE WHEN lower(crop_name) LIKE '%paxta%' OR lower(crop_name) LIKE '%g''o''za%' OR crop_name = 'Kartoshka' THEN DATE '2026-04-01' ELSE DATE '2025-10-01' END AS s,
  CASE WHEN lower(crop_name) LIKE '%paxta%' OR lower(crop_name) LIKE '%g''o''za%' OR crop_name = 'Kartoshka' THEN DATE '2026-10-31' ELSE DATE '2026-06-30' END AS e FROM fields WHERE field_id NOT IN (SELECT o_custkey // 50 * 2 FROM orders))
SELECT field_id, strftime(unnest(generate_series(s, e, INTERVAL 12 DAY)), '%Y-%m-%d') AS date, -11.5::DOUBLE AS s1_vv, -16.2::DOUBLE AS s1_vh FROM c""")
def _(spark, sf):
    planned = fx.with_calendar(st.fields(spark, sf))
    # radar for fields with even ids; the others get the baseline
    return fx.baseline_spine(planned, radar(spark, sf).withColumn("field_id", F.col("field_id") * 2), 12, K.RADAR_BASELINE).select("field_id", wq.day(), "s1_vv", "s1_vh")


_SEASONS = f"""{st.FIELDS}, c AS (SELECT field_id, CASE WHEN lower(crop_name) LIKE '%paxta%' OR lower(crop_name) LIKE '%g''o''za%' OR crop_name = 'Kartoshka' THEN DATE '2026-04-01' ELSE DATE '2025-10-01' END AS s,
  CASE WHEN lower(crop_name) LIKE '%paxta%' OR lower(crop_name) LIKE '%g''o''za%' OR crop_name = 'Kartoshka' THEN DATE '2026-10-31' ELSE DATE '2026-06-30' END AS e FROM fields)"""


@query("baseline_weather_spine", f"""WITH {_SEASONS} SELECT field_id, strftime(unnest(generate_series(s, e, INTERVAL 1 DAY)), '%Y-%m-%d') AS date, 24.0::DOUBLE AS weather_temperature_2m, 23.5::DOUBLE AS weather_apparent_temperature,
  0.5::DOUBLE AS weather_total_precipitation, 0.5::DOUBLE AS weather_rain, 22.0::DOUBLE AS weather_shortwave_radiation, 12.0::DOUBLE AS weather_wind_speed_10m, 4.5::DOUBLE AS weather_evapotranspiration_et0,
  22.0::DOUBLE AS weather_soil_temperature_0_7cm, 0.22::DOUBLE AS weather_soil_moisture_0_7cm, 0.25::DOUBLE AS weather_soil_moisture_7_28cm, 0.28::DOUBLE AS weather_soil_moisture_28_100cm
FROM c WHERE field_id NOT IN (SELECT o_custkey // 50 * 2 FROM orders)""")
def _(spark, sf):
    # weather for fields with even ids; the others get the baseline
    planned = fx.with_calendar(st.fields(spark, sf))
    known = table(spark, sf, "orders").select(F.expr("o_custkey div 50 * 2").alias("field_id"))
    return fx.baseline_spine(planned, known, 1, K.BASELINE_WEATHER).select("field_id", wq.day(), *K.BASELINE_WEATHER)


@query("feature_alignment", f"""WITH {MATRIX} SELECT field_id, year_month, coalesce(s2_ndvi_mean, 0) AS s2_ndvi_mean, 0::DOUBLE AS not_measured, coalesce(s1_vv_mean, 0) AS s1_vv_mean,
  weather_rainy_days_count::DOUBLE AS weather_rainy_days_count FROM matrix""")
def _(spark, sf):
    return yx.align_features(matrix(spark, sf), ["s2_ndvi_mean", "not_measured", "s1_vv_mean", "weather_rainy_days_count"])


def estimates(spark, sf):
    """One estimate per order, standing in for monthly model output."""
    return table(spark, sf, "orders").select(
        F.expr("o_custkey div 50").alias("field_id"), (F.floor("o_totalprice") / 65536.0).alias("prediction")
    )


@query("yield_ensemble", f"""WITH {st.FIELDS}, g AS (SELECT o_custkey // 50 AS field_id, greatest(0.01::DOUBLE, avg(floor(o_totalprice) / 65536.0::DOUBLE)) AS m,
  stddev_pop(floor(o_totalprice) / 65536.0::DOUBLE) AS s, count(*) AS n FROM orders GROUP BY 1),
h AS (SELECT *, round(greatest(0.1::DOUBLE, CASE WHEN n > 1 THEN s ELSE m * 0.15::DOUBLE END), 2) AS margin FROM g),
e AS (SELECT field_id, round(m, 2) AS predicted_yield_t_ha, round(greatest(0.01::DOUBLE, m - margin), 2) AS yield_min_expected, round(m + margin, 2) AS yield_max_expected FROM h)
SELECT e.*, area_hectares AS field_area_ha, round(predicted_yield_t_ha * area_hectares, 2) AS total_expected_yield_tons,
  round(yield_min_expected * area_hectares, 2) AS total_yield_min_tons, round(yield_max_expected * area_hectares, 2) AS total_yield_max_tons FROM e JOIN fields USING (field_id)""")
def _(spark, sf):
    return yx.ensemble(estimates(spark, sf), st.fields(spark, sf))


_STD = ", ".join(f"stddev_samp(coalesce({c}, 0)) AS {c}" for c in fx.FEATURES)


@query("spread_factors", f"""WITH {MATRIX}, sd AS (SELECT field_id, {_STD} FROM matrix GROUP BY 1),
long AS (SELECT * FROM sd UNPIVOT INCLUDE NULLS (spread FOR feature IN ({', '.join(fx.FEATURES)}))),
top AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY round(spread, 9) DESC NULLS LAST, feature) AS rank FROM long QUALIFY rank <= 10)
SELECT field_id, rank, feature, round(spread / CASE WHEN sum(spread) OVER (PARTITION BY field_id) > 0 THEN sum(spread) OVER (PARTITION BY field_id) ELSE 1 END, 4) AS importance FROM top""")
def _(spark, sf):
    return yx.spread_factors(matrix(spark, sf)).select("field_id", "rank", "feature", "importance")


def labels(spark, sf):
    return estimates(spark, sf).groupBy("field_id").agg(F.avg("prediction").alias("yield_t_ha"))


# Tree models have no SQL form; compared is what must hold of them whatever the trees are.
@query("yield_model_scoring", f"WITH {MATRIX} SELECT field_id, year_month, true AS within_labels FROM matrix")
def _(spark, sf):
    """A forest's estimate is a mean of labels, so it lies between the lowest and the highest it learned from."""
    months = cut_lineage(matrix(spark, sf))
    known = labels(spark, sf).join(months.select("field_id").distinct(), "field_id")
    low, high = (known.agg(f("yield_t_ha").alias("x")).scalar() for f in (F.min, F.max))
    scored = yx.score(yx.train(months, labels(spark, sf)), months).withColumns({"low": low, "high": high})
    return scored.select("field_id", "year_month", F.col("prediction").between(F.col("low") - 1e-9, F.col("high") + 1e-9).alias("within_labels"))


_CROP = """CASE WHEN c LIKE '%paxta%' OR c LIKE '%g''o''za%' THEN 'cotton' WHEN c LIKE '%bug''doy%' OR c LIKE '%bug‘doy%' OR c LIKE '%arpa%' THEN 'wheat' ELSE 'cotton' END"""
_ASKED = "CASE field_id % 4 WHEN 0 THEN 'random' WHEN 1 THEN 'gradient_boosting' WHEN 2 THEN 'no such model' END"


def crops(spark, sf):
    return st.fields(spark, sf).select("field_id", fx.normalised_crop(F.col("crop_name")).alias("crop"))


def wheat_high(spark, sf):
    """Labels of wheat lie a hundred above those of cotton."""
    known = labels(spark, sf).join(crops(spark, sf), "field_id")
    return known.select("field_id", (F.col("yield_t_ha") + F.when(F.col("crop") == "wheat", 100.0).otherwise(0.0)).alias("yield_t_ha"))


# A crop's models learned only from that crop, so their estimates lie among its labels, far from the other's.
@query("yield_models_by_crop", f"""WITH {MATRIX}, n AS (SELECT field_id, lower(crop_name) AS c FROM fields), a AS (SELECT field_id, {_CROP} AS crop, {_ASKED} AS asked FROM n)
SELECT field_id, year_month, crop || CASE WHEN asked = 'gradient_boosting' THEN '_gradient_boosting_0001' ELSE '_random_forest_0002' END AS model, crop = 'wheat' AS among_wheat FROM matrix JOIN a USING (field_id)""")
def _(spark, sf):
    months = cut_lineage(matrix(spark, sf))
    high, grown = cut_lineage(wheat_high(spark, sf)), crops(spark, sf)
    registry = yx.train_models(months, high, grown, ("random_forest", "gradient_boosting")) + yx.train_models(months, high, grown, version=2)
    choice = grown.select("field_id", yx.chosen_model(registry, F.col("crop"), F.expr(_ASKED)).alias("model"))
    return yx.score_each(registry, months, choice).select("field_id", "year_month", "model", (F.col("prediction") > 50).alias("among_wheat"))


@query("yield_model_factors", f"""WITH {MATRIX}, n AS (SELECT lower(crop_name) AS c FROM fields WHERE field_id IN (SELECT field_id FROM matrix)),
m AS (SELECT DISTINCT {_CROP} || '_gradient_boosting_0001' AS model FROM n)
SELECT model, rank, true AS by_weight, true AS as_trained, true AS described FROM m, (SELECT unnest(generate_series(1, 10)) AS rank)""")
def _(spark, sf):
    """The ten factors of each model against the weights in the model itself."""
    months = cut_lineage(matrix(spark, sf))
    registry = yx.train_models(months, labels(spark, sf), crops(spark, sf), ("gradient_boosting",))
    weights = [(m.label, name, float(w)) for m in registry for name, w in zip(fx.FEATURES, m.model.stages[-1].featureImportances.toArray(), strict=True)]
    trained = spark.createDataFrame(weights, "model string, feature string, weight double")
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("weight"), "feature"))  # 122 rows a model
    found = yx.factors_of_models(registry, months).join(trained.withColumn("place", place), ["model", "feature"])
    return found.select(
        "model", "rank", (F.col("place") == F.col("rank")).alias("by_weight"), (F.abs(F.col("weight") - F.col("importance")) < 5.1e-5).alias("as_trained"), (F.length("description") > 0).alias("described")
    )


@query("yield_job", f"""WITH {st.FIELDS}, n AS (SELECT field_id, lower(crop_name) AS c FROM fields)
SELECT field_id, {_CROP} AS crop, {_CROP} || '_random_forest_0001' AS model_name, {_CROP} = 'wheat' AS among_wheat,
  true AS total_is_area_times_estimate, true AS inside_interval, 10 AS factors, true AS has_months FROM n""")
def yield_query(spark, sf):
    points = store.series(st.acquisitions(spark, sf), st.index_values(spark, sf))
    measured = wq.daily(spark, sf).drop("w")
    planned, wx_rows, op_rows, ra_rows = yield_job.observations(st.fields(spark, sf).drop("planted_on"), [measured], points)
    registry = yx.train_models(matrix(spark, sf), wheat_high(spark, sf), crops(spark, sf))
    records = yield_job.estimate_yields(planned, wx_rows, op_rows, ra_rows, registry, YEAR)
    total = F.abs(F.col("total_expected_yield_tons") - F.col("predicted_yield_t_ha") * F.col("field_area_ha"))
    return records.select(
        "field_id", "crop", "model_name", (F.col("predicted_yield_t_ha") > 50).alias("among_wheat"), (total <= 0.0051).alias("total_is_area_times_estimate"),
        F.col("predicted_yield_t_ha").between(F.col("yield_min_expected"), F.col("yield_max_expected")).alias("inside_interval"),
        F.size("top_features").alias("factors"), F.size("phenology_timeline").between(1, 12).alias("has_months"),
    )
