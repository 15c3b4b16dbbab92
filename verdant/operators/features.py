"""Monthly feature matrix per field: crop calendar, monthly aggregates, gap fill, 122 columns."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.functions.spectral import monthly_indices

MONTH = ["field_id", "year_month"]


def normalised_crop(name: Column) -> Column:
    """D3: cotton words first, then wheat words, cotton when neither is found."""
    lowered = F.lower(F.trim(name))

    def has(words: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        return hit

    return F.when(has(K.COTTON_WORDS), "cotton").when(has(K.WHEAT_WORDS), "wheat").otherwise("cotton")


def crop_calendar(df: DataFrame) -> DataFrame:
    rows = df.sparkSession.createDataFrame(
        list(K.CROP_CALENDAR),
        "crop string, crop_display_name string, planting string, harvest string, season_from string, season_to string",
    )
    days = {"planting_date": "planting", "harvest_date": "harvest", "season_start": "season_from", "season_end": "season_to"}
    return rows.select("crop", "crop_display_name", *[F.to_date(c).alias(n) for n, c in days.items()])


def with_calendar(fields: DataFrame) -> DataFrame:
    """D3: crop and its calendar; a field's own planting date goes before the calendar's."""
    # two constant rows: the broadcast cannot grow
    joined = fields.withColumn("crop", normalised_crop(F.col("crop_name"))).join(F.broadcast(crop_calendar(fields)), "crop")
    if "planted_on" in fields.columns:
        joined = joined.withColumn("planting_date", F.coalesce("planted_on", "planting_date"))
    return joined


def optical_from_means(points: DataFrame) -> DataFrame:
    """Bands rebuilt from stored index means; an unknown or zero cloud share counts as 10."""
    ndvi, ndre, ndmi = (
        F.coalesce(c, F.lit(d)) for c, d in (("NDVI", 0.65), ("NDRE", 0.45), ("NDMI", 0.35))
    )

    def at_least(low: float, c: Column) -> Column:
        return F.greatest(F.lit(low), c)

    b04 = F.lit(0.05)
    built = points.withColumn("_b08", at_least(0.06, b04 * (1.0 + ndvi) / at_least(0.01, 1.0 - ndvi)))
    built = built.withColumn("_b8a", at_least(0.06, F.col("_b08") * 1.05)).withColumns(
        {
            "_b05": at_least(0.04, F.col("_b8a") * (1.0 - ndre) / at_least(0.01, 1.0 + ndre)),
            "_b11": at_least(0.03, F.col("_b08") * (1.0 - ndmi) / at_least(0.01, 1.0 + ndmi)),
            "_cc": F.coalesce(F.when(F.col("cloud_coverage") != 0, F.col("cloud_coverage")), F.lit(10.0)),
        }
    )
    bands = {
        "s2_b02_blue": F.lit(0.04),
        "s2_b03_green": F.lit(0.07),
        "s2_b04_red": F.round(b04, 4),
        "s2_b05_red_edge_1": F.round("_b05", 4),
        "s2_b06_red_edge_2": F.round(F.col("_b05") * 1.4, 4),
        "s2_b07_red_edge_3": F.round(F.col("_b05") * 1.8, 4),
        "s2_b08_nir": F.round("_b08", 4),
        "s2_b8a_nir_narrow": F.round("_b8a", 4),
        "s2_b11_swir_1": F.round("_b11", 4),
        "s2_b12_swir_2": F.round(F.col("_b11") * 0.6, 4),
        "s2_cloud_percentage": F.col("_cc"),
        "s2_cloud_probability": F.col("_cc") * 0.8,
    }
    return built.select("field_id", F.to_date("acquired_at").alias("date"), *[c.alias(n) for n, c in bands.items()])


def baseline_spine(fields: DataFrame, known: DataFrame | None, step_days: int, values: dict[str, float]) -> DataFrame:
    """Evenly spaced constant observations over the season, for fields without any of their own."""
    missing = fields if known is None else fields.join(known.select("field_id").distinct(), "field_id", "left_anti")
    days = F.sequence("season_start", "season_end", F.expr(f"INTERVAL {step_days} DAYS"))
    spine = missing.select("field_id", F.explode(days).alias("date"))
    return spine.select("field_id", "date", *[F.lit(v).alias(n) for n, v in values.items()])


def with_optical_indices(optical: DataFrame) -> DataFrame:
    """P6 on optical observations."""
    return optical.withColumns(monthly_indices(optical.columns)).withColumn("year_month", F.date_format("date", "yyyy-MM"))


def with_radar_ratio(radar: DataFrame) -> DataFrame:
    """VV − VH; constants for all three when a polarisation is absent."""
    if {"s1_vv", "s1_vh"} <= set(radar.columns):
        radar = radar.withColumn("s1_vv_vh_ratio", F.col("s1_vv") - F.col("s1_vh"))
    else:
        radar = radar.withColumns({"s1_vv": F.lit(-11.0), "s1_vh": F.lit(-16.0), "s1_vv_vh_ratio": F.lit(5.0)})
    return radar.withColumn("year_month", F.date_format("date", "yyyy-MM"))


def with_crop_time(weather: DataFrame) -> DataFrame:
    """Water balance, crop age, days to harvest, season progress and rainy days.

    ``weather`` carries planting_date and harvest_date of its field.
    """
    season = F.greatest(F.datediff("harvest_date", "planting_date"), F.lit(1))
    age = F.greatest(F.datediff("date", "planting_date"), F.lit(0))
    rain = F.col("weather_total_precipitation")
    return weather.withColumns(
        {
            "weather_water_balance": rain - F.col("weather_evapotranspiration_et0"),
            "crop_age_days": age,
            "days_to_harvest": F.greatest(F.datediff("harvest_date", "date"), F.lit(0)),
            "season_progress_ratio": F.least(F.lit(1.0), age / season),
            "is_rainy_day": F.coalesce((rain >= 0.1).cast("int"), F.lit(0)),
            "year_month": F.date_format("date", "yyyy-MM"),
        }
    )




def _sum(c: str) -> Column:
    """A month without any value sums to 0."""
    return F.coalesce(F.sum(c), F.lit(0.0))


AGGREGATES = {"mean": F.avg, "min": F.min, "max": F.max, "sum": _sum, "std": F.stddev_samp}
WEATHER_MONTHLY = (
    ("weather_temperature_2m", ("mean", "min", "max")),
    ("weather_apparent_temperature", ("mean", "min", "max")),
    ("weather_total_precipitation", ("sum", "max", "mean")),
    ("weather_rain", ("sum", "max", "mean")),
    ("weather_shortwave_radiation", ("sum", "mean")),
    ("weather_wind_speed_10m", ("mean", "max")),
    ("weather_soil_temperature_0_7cm", ("mean", "min", "max")),
    ("weather_soil_moisture_0_7cm", ("mean", "min", "max")),
    ("weather_soil_moisture_7_28cm", ("mean", "min", "max")),
    ("weather_soil_moisture_28_100cm", ("mean", "min", "max")),
    ("weather_evapotranspiration_et0", ("sum", "mean")),
    ("weather_water_balance", ("sum", "mean")),
)
CROP_TIME = ("crop_age_days", "days_to_harvest", "season_progress_ratio")
OPTICAL_MONTHLY = (
    *[(c, ("mean", "max", "min", "std")) for c in K.OPTICAL_INDICES],
    *[(c, ("mean", "max", "min")) for c in K.OPTICAL_BANDS],
    ("s2_cloud_percentage", ("mean",)),
    ("s2_cloud_probability", ("mean",)),
)
RADAR_MONTHLY = tuple((c, ("mean", "max", "min")) for c in ("s1_vv", "s1_vh", "s1_vv_vh_ratio"))


def _aggregates(spec) -> list[Column]:
    return [AGGREGATES[how](c).alias(f"{c}_{how}") for c, hows in spec for how in hows]


def _names(spec) -> list[str]:
    return [f"{c}_{how}" for c, hows in spec for how in hows]


WEATHER_COLUMNS = [
    "longitude", "latitude", *CROP_TIME, *_names(WEATHER_MONTHLY[:1]), "weather_temperature_2m_range",
    *_names(WEATHER_MONTHLY[1:4]), "weather_rainy_days_count", *_names(WEATHER_MONTHLY[4:]),
]
SATELLITE_COLUMNS = [*_names(OPTICAL_MONTHLY), *_names(RADAR_MONTHLY)]
FEATURES = [*WEATHER_COLUMNS, *SATELLITE_COLUMNS, "month_sin", "month_cos"]


def monthly_weather(weather: DataFrame) -> DataFrame:
    """One aggregation per field and month, 39 columns."""
    first = lambda c: F.min_by(c, "date").alias(c)
    grouped = weather.groupBy(*MONTH).agg(
        first("longitude"),
        first("latitude"),
        *[F.round(F.avg(c), 2).alias(c) for c in CROP_TIME],
        *_aggregates(WEATHER_MONTHLY),
        F.sum("is_rainy_day").alias("weather_rainy_days_count"),
    )
    spread = F.col("weather_temperature_2m_max") - F.col("weather_temperature_2m_min")
    return grouped.withColumn("weather_temperature_2m_range", spread).select(*MONTH, *WEATHER_COLUMNS)


def monthly_optical(optical: DataFrame) -> DataFrame:
    """72 columns.

    Observations go to their month as they are: a field's month has few, and sums of 72 columns take more room than they do.
    """
    return optical.repartition(*MONTH).groupBy(*MONTH).agg(*_aggregates(OPTICAL_MONTHLY))


def monthly_radar(radar: DataFrame) -> DataFrame:
    """9 columns."""
    return radar.groupBy(*MONTH).agg(*_aggregates(RADAR_MONTHLY))


def merge_months(weather: DataFrame, optical: DataFrame, radar: DataFrame) -> DataFrame:
    """Months of the weather, with what the satellites saw in them."""
    return weather.join(optical, MONTH, "left").join(radar, MONTH, "left")


def _filled(months: pa.Array) -> pa.Array:
    """Per field a list of months, each the values of all columns: the gaps of every column filled along the months."""
    flat = months.flatten()
    width = len(flat[0]) if len(flat) else 0
    values = flat.flatten()
    known = ~values.is_null().to_numpy(zero_copy_only=False).reshape(len(flat), width)
    values = values.to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), width)
    lengths = months.value_lengths().to_numpy().astype(np.int64)
    ends = np.cumsum(lengths)
    first, last = (np.repeat(x, lengths)[:, None] for x in (ends - lengths, ends - 1))
    at = np.arange(len(flat))[:, None]
    before = np.maximum.accumulate(np.where(known, at, -1), axis=0)
    after = np.minimum.accumulate(np.where(known, at, len(flat))[::-1], axis=0)[::-1]
    early, late = before < first, after > last  # no known month of the field on that side
    column = np.arange(width)
    low, high = (values[np.clip(x, 0, len(flat) - 1), column] for x in (before, after))
    between = low + (high - low) / np.maximum(after - before, 1) * (at - before)
    out = np.where(known, values, np.where(early & late, 0.0, np.where(early, high, np.where(late, low, between))))
    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * width, pa.int32()), pa.array(out.ravel(), pa.float64()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), rows)


def fill_gaps(merged: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Linear by position between known months, flat beyond them, 0 where a field has none.

    A field's months go through one exchange, all columns side by side, and are filled in its row: a field has at
    most one row per calendar month, so a row stays small.
    """
    columns = SATELLITE_COLUMNS if columns is None else columns
    rest = [c for c in merged.columns if c not in {"field_id", *columns}]
    values = F.array(*[F.col(c).cast("double") for c in columns])
    month = F.struct("year_month", *[c for c in rest if c != "year_month"], values.alias("_v"))
    fields = merged.select("field_id", month.alias("_m")).groupBy("field_id").agg(F.sort_array(F.collect_list("_m")).alias("_m"))
    filled = fields.withColumn("_x", F.arrow_udf(_filled, "array<array<double>>")(F.col("_m._v")))
    rows = filled.select("field_id", F.inline(F.arrays_zip("_m", "_x")))
    found = {c: F.col(f"_m.{c}") for c in rest} | {"field_id": F.col("field_id")}
    return rows.select(*[found[c].alias(c) for c in merged.columns if c in found], *[F.get("_x", F.lit(k)).alias(c) for k, c in enumerate(columns)])


def finish_features(filled: DataFrame, target_year: int) -> DataFrame:
    """The target year where a field has it, cyclic month, two digits; columns in fixed order."""
    year = F.substring("year_month", 1, 4).cast("int")
    month = F.substring("year_month", 6, 2).cast("double")
    has_year = F.max(year == target_year).over(Window.partitionBy("field_id"))
    angle = F.lit(2 * math.pi) * month / 12.0
    kept = filled.withColumn("_has", has_year).filter(~F.col("_has") | (year == target_year))
    kept = kept.withColumns({"month_sin": F.round(F.sin(angle), 4), "month_cos": F.round(F.cos(angle), 4)})
    doubles = {f.name for f in kept.schema.fields if f.dataType.simpleString() == "double"}
    return kept.select(*MONTH, *[F.round(c, 2).alias(c) if c in doubles else F.col(c) for c in FEATURES])


def monthly_features(weather: DataFrame, optical: DataFrame, radar: DataFrame, target_year: int = 2026) -> DataFrame:
    """The 122-column matrix, one row per field and month."""
    merged = merge_months(
        monthly_weather(weather), monthly_optical(with_optical_indices(optical)), monthly_radar(with_radar_ratio(radar))
    )
    return finish_features(fill_gaps(merged), target_year)


def phenology(optical: DataFrame, radar: DataFrame, weather: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per field and calendar month that optics or weather cover, rounded, with defaults.

    ``optical`` and ``radar`` carry their indices; a field with neither optics nor weather gets the
    seven months of the season.
    """
    month = F.month("date").alias("month")
    keys = ["field_id", "month"]
    seen = optical.groupBy("field_id", month).agg(*[F.avg(f"s2_{n}").alias(n) for n in ("ndvi", "evi", "ndre", "ndmi")])
    echo = radar.groupBy("field_id", month).agg(F.avg("s1_vh").alias("s1_vh"), F.avg("s1_vv_vh_ratio").alias("s1_vv_vh"))
    felt = weather.groupBy("field_id", month).agg(
        F.avg("weather_temperature_2m").alias("temp_mean"),
        F.sum("weather_total_precipitation").alias("rain_sum"),
        F.avg("weather_soil_moisture_0_7cm").alias("soil_moisture"),
    )
    both = seen.join(felt, keys, "full_outer")
    season = F.explode(F.array(*[F.lit(m) for m in K.PHENOLOGY_MONTHS]))
    bare = fields.select("field_id").join(both.select("field_id").distinct(), "field_id", "left_anti")
    both = both.unionByName(bare.select("field_id", season.alias("month")), allowMissingColumns=True)
    joined = both.join(echo, keys, "left")

    def safe(name: str, default: float) -> Column:
        c = F.col(name)
        real = F.abs(c) < F.lit(math.inf)
        return F.when(F.coalesce(real, F.lit(False)), F.round(c, 3)).otherwise(F.lit(default)).alias(name)

    return joined.select(*keys, *[safe(n, d) for n, d in K.PHENOLOGY_DEFAULTS.items()])
