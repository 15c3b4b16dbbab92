"""Key expressions over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.functions import keys
from verdant.queries.registry import query, table


@query("revision_keys", """SELECT event_id, substr(sha256('{"created":null,"id":"' || event_id || '","processing_baseline":"' || event_type ||
  '","product_uri":"' || replace(props, '"', '\\"') || '","updated":"' || strftime(ts, '%Y-%m-%d') || '"}'), 1, 24) AS revision_key FROM events""")
def _(spark, sf):
    key = keys.revision_key(
        id=F.col("event_id").cast("string"),
        updated=F.date_format("ts", "yyyy-MM-dd"),
        created=F.lit(None).cast("string"),
        product_uri=F.col("props"),
        processing_baseline=F.col("event_type"),
    )
    return table(spark, sf, "events").select("event_id", key.alias("revision_key"))


@query("weather_request_keys", """SELECT c_custkey, md5((c_nationkey * 0.125::DOUBLE + 38)::DOUBLE || '_' || (c_nationkey * 0.25::DOUBLE + 56)::DOUBLE || '_2026-04-01_2026-10-31') AS cache_key FROM customer""")
def _(spark, sf):
    lat, lon = F.col("c_nationkey") * 0.125 + 38.0, F.col("c_nationkey") * 0.25 + 56.0
    key = keys.weather_key(lat, lon, F.lit("2026-04-01"), F.lit("2026-10-31"))
    return table(spark, sf, "customer").select("c_custkey", key.alias("cache_key"))


# one id per supplier, letter by letter
@query("public_ids", """WITH d AS (SELECT s_suppkey, sha256(s_name) AS h FROM supplier),
i AS (SELECT s_suppkey, array_to_string(list_transform(range(0, 8), lambda i: substr('abcdefghijklmnopqrstuvwxyz0123456789', CAST(CAST('0x' || substr(h, CAST(i * 8 + 1 AS BIGINT), 8) AS UBIGINT) % 36 + 1 AS BIGINT), 1)), '') AS public_id FROM d)
SELECT s_suppkey, public_id, count(*) OVER (PARTITION BY public_id) AS copies FROM i""")
def _(spark, sf):
    ids = table(spark, sf, "supplier").select("s_suppkey", keys.public_id(F.col("s_name")).alias("public_id"))
    return ids.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("public_id")))


_SEG = "substr(regexp_replace({0}, '[^A-Za-z0-9_.-]', '_', 'g'), 1, 48) || '-' || substr(sha256({0}), 1, 10)"


@query("layer_paths", f"""SELECT page_id, 'field-' || page_id || '/' || {_SEG.format("url")} || '/' || {_SEG.format("'r' || page_id")} || '/{K.RENDER_VERSION}/NDVI.png' AS layer_path,
  'field-' || page_id || '/' || {_SEG.format("url")} || '/' || {_SEG.format("'r' || page_id")} || '/{K.RENDER_VERSION}/values/NDVI.npy' AS values_path FROM pages""")
def _(spark, sf):
    parts = (F.col("page_id"), F.col("url"), F.concat(F.lit("r"), F.col("page_id").cast("string")), F.lit("NDVI"))
    return table(spark, sf, "pages").select(
        "page_id", keys.layer_path(*parts).alias("layer_path"), keys.layer_path(*parts, values=True).alias("values_path")
    )


_UTC = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime({0}, '%f') = '000000' THEN '' ELSE '.' || strftime({0}, '%f') END || 'Z'"


@query("observation_windows", f"SELECT event_id, {_UTC.format('ts')} AS window_from, {_UTC.format('(ts + INTERVAL 1 SECOND)')} AS window_to FROM events")
def _(spark, sf):
    start, end = keys.observation_window(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", start.alias("window_from"), end.alias("window_to"))
