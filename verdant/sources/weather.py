"""Daily weather: provider payloads to rows, the provider cascade, climatology for what is left."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.functions.weather import reference_et0, solar_radiation

COLUMNS = list(K.DAILY_WEATHER_COLUMNS.values())


def column_payload(payloads: DataFrame, column: str = "body") -> DataFrame:
    """A3: one JSON body per request with parallel daily arrays → one row per day.

    A variable the provider left out becomes NULL, and so does a missing tail of an array.
    """
    fields = ", ".join(f"`{raw}`: array<double>" for raw in K.DAILY_WEATHER_COLUMNS)
    parsed = payloads.withColumn("_d", F.from_json(column, f"struct<daily: struct<time: array<string>, {fields}>>")["daily"])
    parsed = parsed.filter(F.size("_d.time") > 0)
    days = parsed.select(*payloads.columns, "_d", F.posexplode("_d.time").alias("_i", "_time"))
    values = [F.get(F.col("_d")[raw], F.col("_i")).alias(name) for raw, name in K.DAILY_WEATHER_COLUMNS.items()]
    keep = [c for c in payloads.columns if c != column]
    return days.select(*keep, F.to_date("_time").alias("date"), *values)


def parameter_payload(payloads: DataFrame, column: str = "body") -> DataFrame:
    """A4: one JSON body per request with a date-keyed map per parameter → one row per day.

    The days are those of the mean temperature; a parameter without a value for a day gets its default.
    """
    kind = "struct<properties: struct<parameter: map<string, map<string, double>>>>"
    parsed = payloads.withColumn("_p", F.from_json(column, kind)["properties"]["parameter"])
    days = parsed.withColumn("_day", F.explode(F.map_keys(F.try_element_at("_p", F.lit("T2M")))))

    def value(name: str, default: Column | float) -> Column:
        found = F.try_element_at(F.try_element_at("_p", F.lit(name)), F.col("_day"))
        return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))

    def at_least(low: float, c: Column) -> Column:
        return F.greatest(F.lit(low), c)

    mean = value("T2M", 22.0)
    read = days.withColumns(
        {
            "_mean": mean,
            "_high": value("T2M_MAX", mean + 5.0),
            "_low": value("T2M_MIN", mean - 5.0),
            "_rain": at_least(0.0, value("PRECTOTCORR", 0.0)),
            "_sun": at_least(0.0, value("ALLSKY_SFC_SW_DWN", 20.0)),
            "_wind": at_least(0.0, value("WS10M", 10.0)),
        }
    )
    t, rain, sun = F.col("_mean"), F.col("_rain"), F.col("_sun")
    out = {
        "weather_temperature_2m": t,
        "weather_apparent_temperature": t - 0.5,
        "weather_total_precipitation": rain,
        "weather_rain": rain,
        "weather_shortwave_radiation": sun,
        "weather_wind_speed_10m": F.col("_wind"),
        "weather_evapotranspiration_et0": F.round(reference_et0(t, F.col("_high"), F.col("_low"), sun), 2),
        "weather_soil_temperature_0_7cm": t,
        "weather_soil_moisture_0_7cm": F.round(rain * 0.02 + 0.20, 3),
        "weather_soil_moisture_7_28cm": F.round(rain * 0.01 + 0.24, 3),
        "weather_soil_moisture_28_100cm": F.lit(0.28),
    }
    keep = [c for c in payloads.columns if c != column]
    return read.select(*keep, F.to_date("_day", "yyyyMMdd").alias("date"), *[c.alias(n) for n, c in out.items()])


def climatology(requests: DataFrame) -> DataFrame:
    """S3: days of each request (…, latitude, start_date, end_date) with modelled weather."""
    days = requests.withColumn("date", F.explode(F.sequence("start_date", "end_date")))
    keep = [c for c in requests.columns if c not in ("start_date", "end_date")]
    doy = F.dayofyear("date").cast("double")
    days = days.select(*keep, "date", doy.alias("_doy"), solar_radiation(F.col("latitude"), doy).alias("_ra"))
    wave = 22.0 + 12.0 * F.sin(F.lit(2 * math.pi / 365) * (F.col("_doy") - 105.0))
    days = days.withColumn("_t", F.round(wave + F.sin(F.col("_doy") * 0.7) * 2.0, 1))
    t, ra = F.col("_t"), F.col("_ra")
    rain = F.when(F.col("_doy") % 15 == 0, 0.5).otherwise(0.0)
    out = {
        "weather_temperature_2m": t,
        "weather_apparent_temperature": F.round(t - 0.8, 1),
        "weather_total_precipitation": rain,
        "weather_rain": rain,
        "weather_shortwave_radiation": F.round(ra * 0.72, 1),
        "weather_wind_speed_10m": F.lit(11.5),
        "weather_evapotranspiration_et0": F.round(0.0023 * (t + 17.8) * F.sqrt((t + 6.0) - (t - 6.0)) * (ra * 0.408), 2),
        "weather_soil_temperature_0_7cm": F.round(t + 1.2, 1),
        "weather_soil_moisture_0_7cm": F.lit(0.22),
        "weather_soil_moisture_7_28cm": F.lit(0.25),
        "weather_soil_moisture_28_100cm": F.lit(0.28),
    }
    return days.select(*keep, "date", *[c.alias(n) for n, c in out.items()])


def stale_requests(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """K2: requests (cache_key, …) without a non-empty entry younger than three days.

    ``cache``: (cache_key, stored_at, rows).
    """
    age = F.unix_seconds(now) - F.unix_seconds("stored_at")
    fresh = cache.filter((F.col("rows") > 0) & (age < K.CACHE_FRESH_SECONDS))
    return requests.join(fresh.select("cache_key"), "cache_key", "left_anti")


def cascade(sources: list[DataFrame], key: str) -> DataFrame:
    """All rows of the first source that has any for a request; sources are in order of preference."""
    rows = None
    for priority, source in enumerate(sources):
        tagged = source.withColumn("priority", F.lit(priority))
        rows = tagged if rows is None else rows.unionByName(tagged, allowMissingColumns=True)
    best = rows.groupBy(key).agg(F.min("priority").alias("priority"))
    return rows.join(best, [key, "priority"])


def with_climatology(requests: DataFrame, sources: list[DataFrame], key: str) -> DataFrame:
    """R11 + S3: requests no provider answered are filled from climatology."""
    found = cascade(sources, key)
    empty = requests.join(found.select(key).distinct(), key, "left_anti")
    modelled = climatology(empty).withColumn("priority", F.lit(len(sources)))
    columns = [key, "date", "priority", *COLUMNS]
    return found.select(*columns).unionByName(modelled.select(*columns))


def newest_per_day(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per request and day where a payload repeats days."""
    w = Window.partitionBy(key, "date").orderBy(F.col(order).desc())
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
