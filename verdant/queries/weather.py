"""Weather sources over the order stand-in."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from verdant import constants as K
from verdant.functions.weather import reference_et0, solar_radiation
from verdant.queries import standins as st
from verdant.queries.registry import query, table
from verdant.sources import weather as wx

W = wx.COLUMNS


def daily(spark, sf):
    """One row per 50 customers and order day; the prime divisors keep rounded results free of ties."""
    w = (
        table(spark, sf, "orders")
        .groupBy(F.expr("o_custkey div 50").alias("field_id"), F.col("o_orderdate").cast("date").alias("date"))
        .agg(F.floor(F.max("o_totalprice")).cast("long").alias("w"))
    )

    def part(m, d=61.0, base=0.0):
        return F.col("w") % m / d + base

    values = [part(1920, base=5.0), part(1920, base=4.5), part(448), part(448, 122.0), part(832, base=10.0), part(704),
              part(320), part(1920, base=6.0), part(16, 122.0, 0.125), part(8, 122.0, 0.25), part(4, 122.0, 0.25)]
    return w.select("field_id", "date", "w", *[v.alias(n) for v, n in zip(values, W, strict=True)])


_PARTS = ["(w % 1920) / 61.0::DOUBLE + 5", "(w % 1920) / 61.0::DOUBLE + 4.5::DOUBLE", "(w % 448) / 61.0::DOUBLE", "(w % 448) / 122.0::DOUBLE",
          "(w % 832) / 61.0::DOUBLE + 10", "(w % 704) / 61.0::DOUBLE", "(w % 320) / 61.0::DOUBLE", "(w % 1920) / 61.0::DOUBLE + 6",
          "(w % 16) / 122.0::DOUBLE + 0.125::DOUBLE", "(w % 8) / 122.0::DOUBLE + 0.25::DOUBLE", "(w % 4) / 122.0::DOUBLE + 0.25::DOUBLE"]
DAILY = f"""
w0 AS (SELECT o_custkey // 50 AS field_id, CAST(o_orderdate AS DATE) AS date, CAST(floor(max(o_totalprice)) AS BIGINT) AS w FROM orders GROUP BY 1, 2),
daily AS (SELECT field_id, date, w, {', '.join(f'{p} AS {n}' for p, n in zip(_PARTS, W, strict=True))} FROM w0)"""
DAY = "strftime(date, '%Y-%m-%d') AS date"


def day():
    return F.date_format("date", "yyyy-MM-dd").alias("date")


@query("weather_column_payload", f"""WITH {DAILY} SELECT field_id, {DAY}, {', '.join(W[:-1])}, CAST(NULL AS DOUBLE) AS {W[-1]} FROM daily""")
def _(spark, sf):
    """Bodies per field and month with parallel arrays; the deepest soil layer is left out."""
    names = [(raw, n) for raw, n in K.DAILY_WEATHER_COLUMNS.items()][:-1]
    rows = F.sort_array(F.collect_list(F.struct(F.date_format("date", "yyyy-MM-dd").alias("time"), *[F.col(n).alias(raw) for raw, n in names])))
    bodies = daily(spark, sf).groupBy("field_id", F.date_format("date", "yyyy-MM").alias("month")).agg(rows.alias("r"))
    arrays = F.struct(*[F.col("r")[c].alias(c) for c in ["time", *[raw for raw, _ in names]]])
    bodies = bodies.select("field_id", F.to_json(F.struct(arrays.alias("daily"))).alias("body"))
    return wx.column_payload(bodies).select("field_id", day(), *W)


@query("weather_parameter_payload", f"""WITH {DAILY},
x AS (SELECT field_id, date, weather_temperature_2m AS t, CASE WHEN w % 3 = 0 THEN weather_temperature_2m + 5 ELSE weather_temperature_2m + 7 END AS hi,
  weather_temperature_2m - 5 AS lo, CASE WHEN w % 5 = 0 THEN 0 ELSE greatest(0::DOUBLE, weather_total_precipitation - 1) END AS p, weather_shortwave_radiation AS r FROM daily)
SELECT field_id, {DAY}, t AS weather_temperature_2m, t - 0.5::DOUBLE AS weather_apparent_temperature, p::DOUBLE AS weather_total_precipitation, p::DOUBLE AS weather_rain,
  r AS weather_shortwave_radiation, 10::DOUBLE AS weather_wind_speed_10m,
  round(0.0023::DOUBLE * (t + 17.8::DOUBLE) * sqrt(greatest(1::DOUBLE, hi - lo)) * (r * 0.408::DOUBLE), 2) AS weather_evapotranspiration_et0,
  t AS weather_soil_temperature_0_7cm, round(p * 0.02::DOUBLE + 0.20::DOUBLE, 3) AS weather_soil_moisture_0_7cm, round(p * 0.01::DOUBLE + 0.24::DOUBLE, 3) AS weather_soil_moisture_7_28cm,
  0.28::DOUBLE AS weather_soil_moisture_28_100cm FROM x""")
def _(spark, sf):
    key = F.date_format("date", "yyyyMMdd")

    def by_day(c, cond=None):
        entry = F.struct(key, c)
        return F.map_from_entries(F.collect_list(entry if cond is None else F.when(cond, entry)))

    t, w = F.col(W[0]), F.col("w")
    bodies = daily(spark, sf).groupBy("field_id", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.map_from_arrays(
            F.array(*[F.lit(n) for n in ("T2M", "T2M_MAX", "PRECTOTCORR", "ALLSKY_SFC_SW_DWN")]),
            F.array(by_day(t), by_day(t + 7.0, w % 3 != 0), by_day(F.col(W[2]) - 1.0, w % 5 != 0), by_day(F.col(W[4]))),
        ).alias("parameter")
    )
    bodies = bodies.select("field_id", F.to_json(F.struct(F.struct("parameter").alias("properties"))).alias("body"))
    return wx.parameter_payload(bodies).select("field_id", day(), *W)


@query("reference_evapotranspiration", f"""WITH {DAILY} SELECT field_id, {DAY},
  round(0.0023::DOUBLE * (weather_temperature_2m + 17.8::DOUBLE) * sqrt(greatest(1::DOUBLE, weather_wind_speed_10m - weather_total_precipitation)) * (weather_shortwave_radiation * 0.408::DOUBLE), 6) AS et0 FROM daily""")
def _(spark, sf):
    et0 = reference_et0(F.col(W[0]), F.col(W[5]), F.col(W[2]), F.col(W[4]))
    return daily(spark, sf).select("field_id", day(), F.round(et0, 6).alias("et0"))


_TURN = f"({2 * math.pi / 365!r}::DOUBLE * doy)"
SOLAR = f"""
s0 AS (SELECT *, 0.409::DOUBLE * sin({_TURN} - 1.39::DOUBLE) AS decl, radians(latitude) AS phi, 1 + 0.033::DOUBLE * cos({_TURN}) AS dist FROM days),
s1 AS (SELECT *, acos(greatest(-1::DOUBLE, least(1::DOUBLE, -tan(phi) * tan(decl)))) AS ws FROM s0),
solar AS (SELECT *, greatest(10::DOUBLE, least(45::DOUBLE, {24 * 60 / math.pi!r}::DOUBLE * 0.0820::DOUBLE * dist * (ws * sin(phi) * sin(decl) + cos(phi) * cos(decl) * sin(ws)))) AS ra FROM s1)"""


@query("solar_radiation", f"""WITH days AS (SELECT DISTINCT o_custkey % 60 + 5.0::DOUBLE AS latitude, dayofyear(o_orderdate)::DOUBLE AS doy FROM orders), {SOLAR}
SELECT latitude, doy, round(ra, 6) AS ra FROM solar""")
def _(spark, sf):
    days = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 60 + 5.0).alias("latitude"), F.dayofyear(F.col("o_orderdate").cast("date")).cast("double").alias("doy")
    ).distinct()
    return days.select("latitude", "doy", F.round(solar_radiation(F.col("latitude"), F.col("doy")), 6).alias("ra"))


CLIMATE = f"""{SOLAR},
c0 AS (SELECT *, round(22::DOUBLE + 12::DOUBLE * sin({2 * math.pi / 365!r}::DOUBLE * (doy - 105)) + sin(doy * 0.7::DOUBLE) * 2, 1) AS t FROM solar),
climate AS (SELECT field_id, date, t AS {W[0]}, round(t - 0.8::DOUBLE, 1) AS {W[1]}, CASE WHEN doy % 15 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS {W[2]},
  CASE WHEN doy % 15 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS {W[3]}, round(ra * 0.72::DOUBLE, 1) AS {W[4]}, 11.5::DOUBLE AS {W[5]},
  round(0.0023::DOUBLE * (t + 17.8::DOUBLE) * sqrt((t + 6) - (t - 6)) * (ra * 0.408::DOUBLE), 2) AS {W[6]}, round(t + 1.2::DOUBLE, 1) AS {W[7]},
  0.22::DOUBLE AS {W[8]}, 0.25::DOUBLE AS {W[9]}, 0.28::DOUBLE AS {W[10]} FROM c0)"""
REQUESTS = f"""{st.FIELDS}, days AS (SELECT field_id, latitude, d::DATE AS date, dayofyear(d)::DOUBLE AS doy
  FROM fields, LATERAL (SELECT unnest(generate_series(DATE '1995-04-01', DATE '1995-10-31', INTERVAL 1 DAY)) AS d))"""


def requests(spark, sf):
    return st.fields(spark, sf).select(
        "field_id", "latitude", F.lit("1995-04-01").cast("date").alias("start_date"), F.lit("1995-10-31").cast("date").alias("end_date")
    )


@query("climatology_weather", f"WITH {REQUESTS}, {CLIMATE} SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date) FROM climate")
def _(spark, sf):
    return wx.climatology(requests(spark, sf)).select("field_id", day(), *W)


# two providers: one answers for fields with ids 0, 3, 6, .., the other for 1, 4, 7, ..; the rest is climatology
@query("weather_provider_cascade", f"""WITH {DAILY}, {REQUESTS}, {CLIMATE},
rows_in AS (SELECT 0 AS priority, field_id * 3 AS field_id, date, {', '.join(W)} FROM daily
  UNION ALL SELECT 1, field_id * 3 + 1, date, {', '.join(W)} FROM daily),
best AS (SELECT field_id, min(priority) AS priority FROM rows_in GROUP BY 1),
found AS (SELECT rows_in.* FROM rows_in JOIN best USING (field_id, priority))
SELECT field_id, {DAY}, priority, {', '.join(W)} FROM found WHERE field_id IN (SELECT field_id FROM fields)
UNION ALL SELECT field_id, strftime(date, '%Y-%m-%d'), 2, {', '.join(W)} FROM climate WHERE field_id NOT IN (SELECT field_id FROM found)""")
def _(spark, sf):
    rows = daily(spark, sf)
    known = st.fields(spark, sf).select("field_id")
    first = rows.withColumn("field_id", F.col("field_id") * 3).join(known, "field_id", "left_semi")
    second = rows.withColumn("field_id", F.col("field_id") * 3 + 1).join(known, "field_id", "left_semi")
    return wx.with_climatology(requests(spark, sf), [first.drop("w"), second.drop("w")], "field_id").select("field_id", day(), "priority", *W)


@query("stale_weather_requests", """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c_custkey
  AND CAST(json_extract_string(props, '$.k') AS INTEGER) > 0 AND epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) < 259200)""")
def _(spark, sf):
    asked = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("cache_key"))
    cache = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("cache_key"), F.col("ts").cast("timestamp").alias("stored_at"), st.events_k().alias("rows")
    )
    return wx.stale_requests(asked, cache, F.lit("2024-01-31").cast("timestamp")).select("c_custkey")
