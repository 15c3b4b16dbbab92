"""Store operators over the event stand-ins for acquisitions, index values and layers."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.operators import store, validation
from verdant.queries import standins as st
from verdant.queries.registry import query, table
from verdant.session import shared_folder
from verdant.sources import versions


def at(c="acquired_at"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


AT = "strftime(acquired_at, '%Y-%m-%d %H:%M:%S.%f') AS acquired_at"
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY acquired_at DESC, acquisition_id DESC) AS rn FROM acquisitions)"


@query("newest_acquisitions", f"WITH {st.ACQUISITIONS}, {RANKED} SELECT field_id, acquisition_id, {AT}, rn FROM ranked WHERE rn <= 5")
def _(spark, sf):
    return store.newest_acquisitions(st.acquisitions(spark, sf)).select("field_id", "acquisition_id", at(), F.col("rn").cast("long").alias("rn"))


@query("retention_split", f"""WITH {st.STORE}, {RANKED}
SELECT field_id, acquisition_id, layer_name, relative_path FROM layers JOIN ranked USING (acquisition_id) WHERE rn > 5""")
def _(spark, sf):
    df = store.retention_split(st.acquisitions(spark, sf), st.layers(spark, sf))
    return df.select("field_id", "acquisition_id", "layer_name", "relative_path")


@query("select_latest_acquisition", f"""WITH {st.STORE}
SELECT field_id, acquisition_id, {AT} FROM acquisitions WHERE processed_at IS NOT NULL AND acquisition_id IN (SELECT acquisition_id FROM index_values)
QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY acquisitions.acquired_at DESC, acquisition_id DESC) = 1""")
def _(spark, sf):
    df = store.select_acquisition(st.acquisitions(spark, sf), st.index_values(spark, sf))
    return df.select("field_id", "acquisition_id", at())


@query("select_cloud_free_acquisition", f"""WITH {st.STORE}
SELECT field_id, acquisition_id, {AT}, cloud_coverage FROM acquisitions WHERE processed_at IS NOT NULL AND valid_pixel_count > 0
  AND cloud_coverage <= 20 AND acquisition_id IN (SELECT acquisition_id FROM index_values)
QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY acquisitions.acquired_at DESC, acquisition_id DESC) = 1""")
def _(spark, sf):
    df = store.select_acquisition(st.acquisitions(spark, sf), st.index_values(spark, sf), K.CLOUD_FREE_PERCENT)
    return df.select("field_id", "acquisition_id", at(), "cloud_coverage")


@query("index_history", f"""WITH {st.STORE}, {RANKED}
SELECT field_id, acquisition_id, strftime(acquired_at, '%Y-%m-%d %H:%M:%S.%f') AS acquired_at, index_name, mean_value, min_value, median_value, max_value, v.valid_pixel_count
FROM ranked JOIN index_values v USING (acquisition_id) WHERE rn <= 30""")
def _(spark, sf):
    df = store.index_history(st.acquisitions(spark, sf), st.index_values(spark, sf), 30)
    return df.select("field_id", "acquisition_id", at(), "index_name", "mean_value", "min_value", "median_value", "max_value", "valid_pixel_count")


@query("observation_range", f"""WITH {st.ACQUISITIONS} SELECT field_id, acquisition_id, {AT} FROM acquisitions
WHERE year(acquisitions.acquired_at) = 2024 AND CAST(acquisitions.acquired_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def _(spark, sf):
    import datetime

    df = store.in_range(st.acquisitions(spark, sf), 2024, datetime.date(2024, 1, 5), datetime.date(2024, 1, 20))
    return df.select("field_id", "acquisition_id", at())


@query("layers_with_statistics", f"""WITH {st.STORE}
SELECT field_id, l.acquisition_id, layer_name, relative_path, mean_value, min_value, median_value, max_value, v.valid_pixel_count AS layer_valid_pixel_count
FROM layers l JOIN acquisitions a ON a.acquisition_id = l.acquisition_id
LEFT JOIN index_values v ON v.acquisition_id = l.acquisition_id AND v.index_name = l.layer_name WHERE render_version = '{K.RENDER_VERSION}'""")
def _(spark, sf):
    df = store.layer_statistics(st.layers(spark, sf), st.acquisitions(spark, sf), st.index_values(spark, sf))
    return df.select(
        "field_id", "acquisition_id", "layer_name", "relative_path", "mean_value", "min_value", "median_value", "max_value", "layer_valid_pixel_count"
    )


@query("processed_acquisitions", f"""WITH {st.STORE}
SELECT field_id, acquisition_id, {AT} FROM acquisitions WHERE processed_at IS NOT NULL
  AND EXISTS (SELECT 1 FROM index_values v WHERE v.acquisition_id = acquisitions.acquisition_id)
  AND EXISTS (SELECT 1 FROM layers l WHERE l.acquisition_id = acquisitions.acquisition_id AND render_version = '{K.RENDER_VERSION}')""")
def _(spark, sf):
    df = store.processed_acquisitions(st.acquisitions(spark, sf), st.index_values(spark, sf), st.layers(spark, sf))
    return df.select("field_id", "acquisition_id", at())


# Creation times derive from the ids, with ties; every seventh is not known.
_MADE = "CASE WHEN {0} % 7 <> 3 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * ({0} * 37 % 101) END"


def _made(key: str):
    hours = F.make_interval(hours=(F.col(key) * 37 % 101).cast("int"))
    return F.when(F.col(key) % 7 != 3, F.to_timestamp(F.lit("2024-01-01 00:00:00")) + hours).alias("created_at")


def _listing_sql(key: str, columns: str, source: str) -> str:
    return f"""l AS (SELECT {columns}, row_number() OVER (ORDER BY {_MADE.format(key)} DESC NULLS LAST, {key}) AS place FROM {source})
SELECT *, CAST((place + 49) // 50 AS BIGINT) AS page FROM l"""


@query("field_listing", f"WITH {st.FIELDS}, {_listing_sql('field_id', 'field_id, public_id, crop_name', 'fields')}")
def _(spark, sf):
    return store.listed(st.fields(spark, sf).select("field_id", "public_id", "crop_name", _made("field_id")), "field_id").drop("created_at")


@query("document_listing", f"""WITH docs AS (SELECT doc_id AS document_id, source || '-' || doc_id AS name FROM documents),
{_listing_sql('document_id', 'document_id, name', 'docs')}""")
def _(spark, sf):
    return store.listed(st.documents(spark, sf).select("document_id", "name", _made("document_id")), "document_id").drop("created_at")


@query("acquisition_listing", f"""WITH {st.STORE}, done AS (SELECT field_id, acquisition_id, product_id, acquired_at FROM acquisitions WHERE processed_at IS NOT NULL
  AND acquisition_id IN (SELECT acquisition_id FROM index_values) AND acquisition_id IN (SELECT acquisition_id FROM layers WHERE render_version = '{K.RENDER_VERSION}')),
l AS (SELECT field_id, acquisition_id, product_id, row_number() OVER (PARTITION BY field_id ORDER BY acquired_at DESC, acquisition_id) AS place FROM done)
SELECT *, CAST((place + 49) // 50 AS BIGINT) AS page FROM l""")
def _(spark, sf):
    done = store.processed_acquisitions(st.acquisitions(spark, sf), st.index_values(spark, sf), st.layers(spark, sf))
    return store.listed(done, "acquisition_id", "acquired_at", "field_id").select("field_id", "acquisition_id", "product_id", "place", "page")


COMPLETE = f"""
iv AS (SELECT acquisition_id, count(*) AS n FROM index_values GROUP BY 1),
ly AS (SELECT acquisition_id, count(DISTINCT layer_name) AS n FROM layers WHERE render_version = '{K.RENDER_VERSION}' GROUP BY 1)"""


@query("completeness_flags", f"""WITH {st.STORE}, {COMPLETE}
SELECT acquisition_id, coalesce(iv.n, 0) = 5 AS has_index_values, coalesce(ly.n, 0) = 7 AS has_layers
FROM acquisitions LEFT JOIN iv USING (acquisition_id) LEFT JOIN ly USING (acquisition_id)""")
def _(spark, sf):
    df = store.completeness(st.acquisitions(spark, sf), st.index_values(spark, sf), st.layers(spark, sf))
    return df.select("acquisition_id", "has_index_values", "has_layers")


# incoming = every event; already stored = what was acquired before the middle of the month
STORED = "stored AS (SELECT * FROM acquisitions WHERE acquired_at < TIMESTAMP '2024-01-15')"
FIRST = """first AS (SELECT * FROM acquisitions QUALIFY row_number() OVER (PARTITION BY field_id, product_id, revision_key ORDER BY acquired_at, acquisition_id) = 1),
inserted AS (SELECT first.*, NOT EXISTS (SELECT 1 FROM stored s WHERE s.field_id = first.field_id AND s.product_id = first.product_id
  AND s.revision_key = first.revision_key) AS created FROM first)"""


def inserted(spark, sf):
    acq = st.acquisitions(spark, sf)
    return store.insert_if_new(acq, acq.filter("acquired_at < timestamp'2024-01-15'"))


@query("insert_if_new", f"WITH {st.ACQUISITIONS}, {STORED}, {FIRST} SELECT field_id, product_id, revision_key, acquisition_id, created FROM inserted")
def _(spark, sf):
    return inserted(spark, sf).select("field_id", "product_id", "revision_key", "acquisition_id", "created")


PENDING = """pending AS (SELECT field_id, acquisition_id, created FROM inserted LEFT JOIN iv USING (acquisition_id) LEFT JOIN ly USING (acquisition_id)
  WHERE created OR processed_at IS NULL OR coalesce(iv.n, 0) <> 5 OR coalesce(ly.n, 0) <> 7)"""


@query("pending_work", f"WITH {st.STORE}, {STORED}, {FIRST}, {COMPLETE}, {PENDING} SELECT * FROM pending")
def _(spark, sf):
    df = store.pending_work(inserted(spark, sf), st.index_values(spark, sf), st.layers(spark, sf))
    return df.select("field_id", "acquisition_id", "created")


@query("load_report", f"""WITH {st.STORE}, {STORED}, {FIRST}, {COMPLETE}, {PENDING},
bad AS (SELECT acquisition_id FROM acquisitions WHERE product_id = 'error')
SELECT f.field_id, count(*) AS acquisitions_found,
  count(*) FILTER (p.acquisition_id IS NOT NULL AND f.product_id <> 'error') AS new_acquisitions_processed,
  count(*) FILTER (p.acquisition_id IS NOT NULL AND f.product_id = 'error') AS failed
FROM inserted f LEFT JOIN pending p ON p.acquisition_id = f.acquisition_id GROUP BY 1""")
def _(spark, sf):
    found = inserted(spark, sf)
    pending = store.pending_work(found, st.index_values(spark, sf), st.layers(spark, sf))
    return store.load_report(found, pending, st.acquisitions(spark, sf).filter("product_id = 'error'"))


POINTS = """points AS (SELECT field_id, a.acquisition_id, acquired_at, cloud_coverage, fully_cloudy,
  max(mean_value) FILTER (index_name = 'NDVI') AS NDVI, max(mean_value) FILTER (index_name = 'NDMI') AS NDMI,
  max(mean_value) FILTER (index_name = 'NDRE') AS NDRE, max(mean_value) FILTER (index_name = 'EVI') AS EVI,
  max(mean_value) FILTER (index_name = 'BSI') AS BSI
FROM acquisitions a JOIN index_values v ON v.acquisition_id = a.acquisition_id GROUP BY ALL)"""


@query("annual_series", f"WITH {st.STORE}, {POINTS} SELECT * REPLACE (strftime(acquired_at, '%Y-%m-%d %H:%M:%S.%f') AS acquired_at) FROM points WHERE year(points.acquired_at) = 2024")
def _(spark, sf):
    df = store.series(st.acquisitions(spark, sf), st.index_values(spark, sf), year=2024)
    return df.withColumn("acquired_at", at())


@query("historical_series", f"WITH {st.STORE}, {POINTS} SELECT * REPLACE (strftime(acquired_at, '%Y-%m-%d %H:%M:%S.%f') AS acquired_at) FROM points WHERE points.acquired_at >= TIMESTAMP '2024-01-20'")
def _(spark, sf):
    import datetime

    df = store.series(st.acquisitions(spark, sf), st.index_values(spark, sf), from_date=datetime.date(2024, 1, 20))
    return df.withColumn("acquired_at", at())


# a recomputed mean stands in for pixel values: the mean of the other indices of the acquisition
@query("metric_points", f"""WITH {st.STORE},
re AS (SELECT acquisition_id, avg(mean_value) AS m FROM index_values GROUP BY 1),
filled AS (SELECT v.* REPLACE (coalesce(mean_value, CASE WHEN valid_pixel_count <> 0 THEN round(m, 6) END) AS mean_value) FROM index_values v JOIN re USING (acquisition_id))
SELECT acquisition_id, max(mean_value) FILTER (index_name = 'NDVI') AS NDVI, max(mean_value) FILTER (index_name = 'NDMI') AS NDMI,
  max(mean_value) FILTER (index_name = 'NDRE') AS NDRE, max(mean_value) FILTER (index_name = 'EVI') AS EVI, max(mean_value) FILTER (index_name = 'BSI') AS BSI
FROM filled GROUP BY 1""")
def _(spark, sf):
    values = st.index_values(spark, sf)
    mean = values.groupBy("acquisition_id").agg(F.round(F.avg("mean_value"), 6).alias("mean"))
    recomputed = values.select("acquisition_id", "index_name").join(mean, "acquisition_id")
    history = store.index_history(st.acquisitions(spark, sf), values, None)
    return store.metric_points(history, recomputed).select("acquisition_id", *K.CORE_INDICES)


def yields(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("prediction_id"),
        (F.col("o_custkey") % 150).alias("field_id"),
        F.lit("cotton").alias("crop"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (F.col("o_totalprice") / 100000.0).alias("predicted_yield_t_ha"),
        (F.col("o_totalprice") / 100000.0 - 0.5).alias("yield_min_expected"),
        (F.col("o_totalprice") / 100000.0 + 0.5).alias("yield_max_expected"),
        (F.col("o_custkey") % 7).cast("double").alias("field_area_ha"),
    )


YIELDS = """yields AS (SELECT o_orderkey AS prediction_id, o_custkey % 150 AS field_id, 'cotton' AS crop, o_orderdate AS created_at,
  o_totalprice / 100000.0::DOUBLE AS predicted_yield_t_ha, o_totalprice / 100000.0::DOUBLE - 0.5::DOUBLE AS yield_min_expected,
  o_totalprice / 100000.0::DOUBLE + 0.5::DOUBLE AS yield_max_expected, (o_custkey % 7)::DOUBLE AS field_area_ha FROM orders),
last_yield AS (SELECT * FROM yields QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY created_at DESC, prediction_id DESC) = 1)"""


@query("field_overview", f"""WITH {st.STORE}, {st.FIELDS}, {YIELDS},
latest AS (SELECT * FROM acquisitions WHERE processed_at IS NOT NULL AND acquisition_id IN (SELECT acquisition_id FROM index_values)
  QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY acquired_at DESC, acquisition_id DESC) = 1)
SELECT f.field_id, f.public_id, f.crop_name, l.acquisition_id AS latest_acquisition_id, l.cloud_coverage, CASE WHEN f.crop_name = 'Paxta' THEN 'ok' END AS recommendation,
  y.predicted_yield_t_ha, round(coalesce(yield_min_expected, 0) * CASE WHEN field_area_ha = 0 THEN 1 ELSE field_area_ha END, 2) AS total_yield_min_tons,
  round(coalesce(yield_max_expected, 0) * CASE WHEN field_area_ha = 0 THEN 1 ELSE field_area_ha END, 2) AS total_yield_max_tons
FROM fields f LEFT JOIN latest l USING (field_id) LEFT JOIN last_yield y USING (field_id)""")
def _(spark, sf):
    fields = st.fields(spark, sf)
    latest = store.select_acquisition(st.acquisitions(spark, sf), st.index_values(spark, sf))
    advice = fields.filter("crop_name = 'Paxta'").select("field_id", F.lit("ok").alias("content"))
    return store.field_overview(fields, latest, advice, yields(spark, sf)).select(
        "field_id", "public_id", "crop_name", "latest_acquisition_id", "cloud_coverage", "recommendation",
        "predicted_yield_t_ha", "total_yield_min_tons", "total_yield_max_tons",
    )


@query("latest_yield", f"WITH {YIELDS} SELECT field_id, prediction_id, predicted_yield_t_ha FROM last_yield")
def _(spark, sf):
    order = (F.col("created_at").desc(), F.col("prediction_id").desc())
    return store.newest(yields(spark, sf), ["field_id"], order, 1).select("field_id", "prediction_id", "predicted_yield_t_ha")


@query("field_lookup", f"""WITH {st.FIELDS}, req AS (SELECT c_custkey AS request_id, CASE WHEN c_nationkey < 12 THEN '' ELSE 'f' END || (c_custkey % 400) AS wanted FROM customer)
SELECT DISTINCT request_id, wanted, field_id, public_id FROM req JOIN fields ON wanted = public_id OR wanted = CAST(field_id AS VARCHAR)""")
def _(spark, sf):
    requests = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.concat(F.when(F.col("c_nationkey") < 12, "").otherwise("f"), (F.col("c_custkey") % 400).cast("string")).alias("wanted"),
    )
    return store.lookup_fields(st.fields(spark, sf), requests)


# changes = values measured again by every later event of the same field and index
@query("latest_wins_upsert", f"""WITH {st.STORE}, j AS (SELECT a.field_id, v.index_name, a.acquired_at, a.acquisition_id, v.mean_value
  FROM index_values v JOIN acquisitions a USING (acquisition_id))
SELECT field_id, index_name, acquisition_id, mean_value FROM j
QUALIFY row_number() OVER (PARTITION BY field_id, index_name ORDER BY acquired_at >= TIMESTAMP '2024-01-15' DESC, acquired_at DESC, acquisition_id DESC) = 1""")
def _(spark, sf):
    rows = st.index_values(spark, sf).join(st.acquisitions(spark, sf).select("acquisition_id", "field_id", "acquired_at"), "acquisition_id")
    rows = rows.select("field_id", "index_name", "acquisition_id", "mean_value", "acquired_at")
    old = F.col("acquired_at") < F.lit("2024-01-15").cast("timestamp")
    best = store.latest_wins(rows.filter(old), rows.filter(~old), ["field_id", "index_name"], "acquired_at")
    return best.drop("acquired_at")


@query("acquisition_completion", f"""WITH {st.STORE},
ndvi AS (SELECT acquisition_id * 2 AS acquisition_id, valid_pixel_count AS n FROM index_values WHERE index_name = 'NDVI')
SELECT acquisition_id, coalesce(n, valid_pixel_count) AS valid_pixel_count, CASE WHEN n IS NULL THEN fully_cloudy ELSE n = 0 END AS fully_cloudy,
  strftime(CASE WHEN n IS NULL THEN processed_at ELSE TIMESTAMP '2024-02-01' END, '%Y-%m-%d') AS processed_on,
  CASE WHEN n IS NULL AND product_id = 'error' THEN substr(repeat('failed ', 100), 1, 500) END AS processing_error
FROM acquisitions LEFT JOIN ndvi USING (acquisition_id)""")
def _(spark, sf):
    acq = st.acquisitions(spark, sf)
    failures = acq.filter("product_id = 'error'").select("acquisition_id", F.repeat(F.lit("failed "), F.lit(100)).alias("message"))
    # statistics for acquisitions with even ids; the others were not measured
    stats = st.index_values(spark, sf).withColumn("acquisition_id", F.col("acquisition_id") * 2)
    done = store.complete_acquisitions(acq, stats, failures, F.lit("2024-02-01").cast("timestamp"))
    return done.select(
        "acquisition_id", "valid_pixel_count", "fully_cloudy", F.date_format("processed_at", "yyyy-MM-dd").alias("processed_on"), "processing_error"
    )


@query("catalogue_page_merge", f"""WITH {st.ACQUISITIONS}
SELECT field_id, product_id, revision_key, acquisition_id, k AS page_no FROM acquisitions JOIN ev ON event_id = acquisition_id
QUALIFY row_number() OVER (PARTITION BY field_id, product_id, revision_key ORDER BY k DESC, acquired_at DESC, acquisition_id DESC) = 1""")
def _(spark, sf):
    pages = st.acquisitions(spark, sf).withColumn("page_no", F.col("valid_pixel_count"))
    return store.merge_pages(pages).select("field_id", "product_id", "revision_key", "acquisition_id", "page_no")


@query("cascade_delete", f"""WITH {st.STORE}, {st.FIELDS}, gone AS (SELECT field_id FROM fields WHERE crop_name = 'Paxta'),
a AS (SELECT * FROM acquisitions WHERE field_id NOT IN (SELECT field_id FROM gone))
SELECT 'fields' AS table_name, concat_ws('|', field_id) AS key FROM fields WHERE field_id NOT IN (SELECT field_id FROM gone)
UNION ALL SELECT 'acquisitions', concat_ws('|', acquisition_id, field_id, product_id, revision_key) FROM a
UNION ALL SELECT 'index_values', concat_ws('|', acquisition_id, index_name, valid_pixel_count) FROM index_values WHERE acquisition_id IN (SELECT acquisition_id FROM a)
UNION ALL SELECT 'artifacts', concat_ws('|', acquisition_id, layer_name, render_version) FROM layers WHERE acquisition_id IN (SELECT acquisition_id FROM a)""")
def _(spark, sf):
    fields = st.fields(spark, sf)
    tables = {
        "fields": fields, "acquisitions": st.acquisitions(spark, sf),
        "index_values": st.index_values(spark, sf), "artifacts": st.layers(spark, sf),
    }
    keys = {
        "fields": ["field_id"], "acquisitions": ["acquisition_id", "field_id", "product_id", "revision_key"],
        "index_values": ["acquisition_id", "index_name", "valid_pixel_count"], "artifacts": ["acquisition_id", "layer_name", "render_version"],
    }
    left = store.cascade_delete(tables, "fields", "field_id", fields.filter("crop_name = 'Paxta'"))
    parts = [df.select(F.lit(n).alias("table_name"), F.concat_ws("|", *[F.col(c).cast("string") for c in keys[n]]).alias("key")) for n, df in left.items()]
    return reduce(DataFrame.unionByName, parts)


_VALUES = "acquisition_id long, index_name string, valid_pixel_count long, mean_value double, version int"


@query("stored_upserts", f"""WITH {st.STORE} SELECT acquisition_id, index_name, valid_pixel_count,
  mean_value + CASE WHEN acquisition_id % 50 = 7 THEN 4 WHEN acquisition_id % 30 = 0 THEN 2 ELSE 0 END AS mean_value,
  CASE WHEN acquisition_id % 50 = 7 THEN 3 WHEN acquisition_id % 30 = 0 THEN 2 ELSE 1 END AS version FROM index_values WHERE acquisition_id % 4 <> 1 OR acquisition_id % 50 = 7 OR acquisition_id % 30 = 0""")
def _(spark, sf):
    """Stored in three batches; the second and the first are tried again after the third and add nothing."""
    values = st.index_values(spark, sf).select("acquisition_id", "index_name", F.col("valid_pixel_count").cast("long"), "mean_value")
    folder = f"{shared_folder(spark)}/values-{uuid.uuid4().hex}"
    merge = lambda stored, new: store.latest_wins(stored, new, ["acquisition_id", "index_name"], "version")

    def batch(name: str, rows: str, more: float, version: int) -> None:
        changed = values.filter(rows).withColumn("mean_value", F.col("mean_value") + more).withColumn("version", F.lit(version))
        versions.change(changed, folder, _VALUES, "acquisition_id", name, merge)

    for name in ("first", "second", "third", "second", "first"):
        rows, more, version = {"first": ("acquisition_id % 4 <> 1", 0.0, 1), "second": ("acquisition_id % 30 = 0", 2.0, 2), "third": ("acquisition_id % 50 = 7", 4.0, 3)}[name]
        batch(name, rows, more, version)
    return versions.read(spark, folder, _VALUES)


@query("duplicate_keys", f"""WITH {st.ACQUISITIONS} SELECT field_id, product_id, revision_key, count(*) AS copies
FROM acquisitions GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def _(spark, sf):
    return validation.duplicate_keys(st.acquisitions(spark, sf), store.ACQUISITION_KEY)


@query("missing_parents", f"""WITH {st.ACQUISITIONS}, {st.FIELDS} SELECT field_id, count(*) AS rows FROM acquisitions
WHERE field_id NOT IN (SELECT field_id FROM fields) GROUP BY 1""")
def _(spark, sf):
    return validation.missing_parents(st.acquisitions(spark, sf), "field_id", st.fields(spark, sf))


@query("row_validation", """SELECT c_custkey, concat_ws(',', CASE WHEN NOT c_acctbal > 0 THEN 'area_hectares' END,
  CASE WHEN NOT length(trim(substr(c_mktsegment, 1, c_nationkey))) BETWEEN 1 AND 120 THEN 'crop_name' END,
  CASE WHEN NOT length(trim(repeat(c_name, c_nationkey))) BETWEEN 1 AND 120 THEN 'growth_stage' END) AS violations FROM customer""")
def _(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey",
        F.col("c_acctbal").alias("area_hectares"),
        F.substring(F.col("c_mktsegment"), F.lit(1), F.col("c_nationkey")).alias("crop_name"),
        F.repeat(F.col("c_name"), F.col("c_nationkey")).alias("growth_stage"),
        F.lit("2024-04-01").cast("date").alias("planted_on"),
    )
    checked = validation.check_fields(rows)
    return checked.select("c_custkey", F.array_join("violations", ",").alias("violations"))


# Dates before today, far ahead and missing; languages and modes that are allowed, missing and not allowed.
_FROM = "CASE conv_id % 5 WHEN 0 THEN DATE '2999-12-31' WHEN 1 THEN DATE '2020-02-29' WHEN 2 THEN DATE '1970-01-01' END"
_TONGUE = "CASE turn % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'ru' WHEN 2 THEN 'fr' WHEN 3 THEN 'uz-latn' WHEN 4 THEN 'EN' END"
_MODE = "CASE (conv_id + turn) % 8 WHEN 0 THEN 'advanced' WHEN 1 THEN 'graph' WHEN 2 THEN 'fast' WHEN 3 THEN 'naive' WHEN 4 THEN 'auto' WHEN 5 THEN 'direct_llm' WHEN 6 THEN 'all_in_one' END"


@query("request_validation", f"""WITH n AS (SELECT conv_id, count(*) AS messages FROM conversations GROUP BY 1), r AS (SELECT *, {_FROM} AS from_date, {_TONGUE} AS language, {_MODE} AS mode FROM conversations)
SELECT conv_id, turn, concat_ws(',', CASE WHEN from_date > current_date THEN 'from_date' END, CASE WHEN messages > 10 THEN 'messages' END, CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' END,
  CASE WHEN length(text) NOT BETWEEN 1 AND 3000 THEN 'content' END, CASE WHEN language NOT IN ('uz-latn', 'uz-cyrl', 'ru', 'en') THEN 'language' END,
  CASE WHEN mode IS NULL OR mode NOT IN ('advanced', 'all_in_one', 'graph', 'naive', 'direct_llm', 'auto') THEN 'mode' END) AS violations FROM r JOIN n USING (conv_id)""")
def _(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("request_id"), "turn", "role", F.col("text").alias("content"),
        F.expr(_FROM).alias("from_date"), F.expr(_TONGUE).alias("language"), F.expr(_MODE).alias("mode"),
    )
    checked = validation.check_requests(rows, F.current_date())
    return checked.select(F.col("request_id").alias("conv_id"), "turn", F.array_join("violations", ",").alias("violations"))


@query("document_toggle", """SELECT doc_id AS document_id, CASE WHEN quality IS NOT NULL THEN quality = 1 ELSE true END AS is_active
FROM documents LEFT JOIN labels USING (doc_id)""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.lit(True).alias("is_active"))
    asked = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), (F.col("quality") == 1).alias("active"))
    return store.toggle_document(docs, asked).select("document_id", "is_active")


def _listed(*checks: tuple[str, str]) -> str:
    """Names of the failing checks, in order, as SQL."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{name}' END" for name, ok in checks) + ")"


@query("acquisition_validation", f"""WITH {st.ACQUISITIONS}, a AS (SELECT acquisition_id, cloud_coverage * 1.25::DOUBLE - 10 AS c, valid_pixel_count - 3 AS n, CASE WHEN acquisition_id % 7 > 0 THEN fully_cloudy END AS f FROM acquisitions)
SELECT acquisition_id, {_listed(('cloud_coverage', 'c IS NULL OR c BETWEEN 0 AND 100'), ('valid_pixel_count', 'n IS NULL OR n >= 0'), ('fully_cloudy', 'f IS NOT NULL'))} AS violations FROM a""")
def _(spark, sf):
    rows = st.acquisitions(spark, sf).withColumns(
        {
            "cloud_coverage": F.col("cloud_coverage") * 1.25 - 10, "valid_pixel_count": F.col("valid_pixel_count") - 3,
            "fully_cloudy": F.when(F.col("acquisition_id") % 7 > 0, F.col("fully_cloudy")),
        }
    )
    return validation.check_acquisitions(rows).select("acquisition_id", F.array_join("violations", ",").alias("violations"))


@query("layer_validation", f"""WITH {st.STORE} SELECT relative_path, {_listed(('width', 'acquisition_id % 4 > 0'), ('height', 'CASE WHEN acquisition_id % 6 > 0 THEN acquisition_id % 5 > 0 END'))} AS violations FROM layers""")
def _(spark, sf):
    rows = st.layers(spark, sf).withColumns({"width": F.col("acquisition_id") % 4, "height": F.when(F.col("acquisition_id") % 6 > 0, F.col("acquisition_id") % 5)})
    return validation.check_layers(rows).select("relative_path", F.array_join("violations", ",").alias("violations"))


@query("message_validation", f"""SELECT conv_id, turn, {_listed(('role', "role IN ('user', 'assistant')"), ('content', 'turn % 3 <> 2 AND text IS NOT NULL'))} AS violations FROM conversations""")
def _(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("content", F.when(F.col("turn") % 3 != 2, F.col("text")))
    return validation.check_messages(rows).select("conv_id", "turn", F.array_join("violations", ",").alias("violations"))


# a table of the store per given table, with repeated keys and missing parents made by key arithmetic
_KEYED = {
    "fields": ("customer", {"field_id": "c_custkey", "public_id": "concat('p', c_custkey % 100)", "geometry_hash": "md5(c_mktsegment)"}),
    "acquisitions": ("orders", {"acquisition_id": "o_orderkey", "field_id": "o_custkey * 2", "product_id": "o_orderpriority", "revision_key": "o_orderstatus"}),
    "index_values": ("lineitem", {"acquisition_id": "l_orderkey + 1", "index_name": "l_returnflag", "relative_path": "concat(l_orderkey, '/', l_linenumber)"}),
    "artifacts": ("lineitem", {"artifact_id": "l_orderkey * 8 + l_linenumber", "acquisition_id": "l_orderkey", "layer_name": "l_linestatus", "render_version": "l_returnflag", "relative_path": "concat('x', l_partkey)"}),
    "recommendations": ("orders", {"field_id": "o_custkey", "acquisition_id": "o_orderkey * 3"}),
    "chat_messages": ("conversations", {"message_id": "conv_id * 4 + turn", "field_id": "conv_id"}),
    "chat_summaries": ("conversations", {"field_id": "conv_id + turn"}),
    "documents": ("documents", {"document_id": "doc_id % 150"}),
    "chunks": ("embeddings", {"chunk_id": "vec_id", "document_id": "vec_id - 20"}),
    "yield_predictions": ("part", {"prediction_id": "p_partkey % 90", "field_id": "p_size * 100"}),
}


def _keyed(spark, sf):
    return {name: table(spark, sf, given).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()]) for name, (given, columns) in _KEYED.items()}


def _keyed_sql(name: str) -> str:
    given, columns = _KEYED[name]
    return "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {given})"


# the declared keys and references, as literals
_KEY_LIST = [
    ("fields", "field_id"), ("fields", "public_id"), ("fields", "geometry_hash"), ("acquisitions", "acquisition_id"), ("acquisitions", "field_id,product_id,revision_key"),
    ("index_values", "acquisition_id,index_name"), ("index_values", "relative_path"), ("artifacts", "artifact_id"), ("artifacts", "relative_path"),
    ("artifacts", "acquisition_id,layer_name,render_version"), ("recommendations", "field_id"), ("chat_messages", "message_id"), ("chat_summaries", "field_id"),
    ("documents", "document_id"), ("chunks", "chunk_id"), ("yield_predictions", "prediction_id"),
]
_REFERENCE_LIST = [
    ("acquisitions", "field_id", "fields"), ("index_values", "acquisition_id", "acquisitions"), ("artifacts", "acquisition_id", "acquisitions"),
    ("recommendations", "field_id", "fields"), ("recommendations", "acquisition_id", "acquisitions"), ("chat_messages", "field_id", "fields"),
    ("chat_summaries", "field_id", "fields"), ("chunks", "document_id", "documents"), ("yield_predictions", "field_id", "fields"),
]


@query("declared_keys", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{k}' AS key_columns, concat_ws('|', {k}) AS key, count(*) AS copies FROM {_keyed_sql(t)} GROUP BY {k} HAVING count(*) > 1" for t, k in _KEY_LIST
))
def _(spark, sf):
    return validation.key_report(_keyed(spark, sf))


@query("declared_references", " UNION ALL ".join(
    f"SELECT '{c}' AS table_name, '{k}' AS column_name, {k} AS value, count(*) AS rows FROM {_keyed_sql(c)} WHERE {k} NOT IN (SELECT {k} FROM {_keyed_sql(p)}) GROUP BY {k}" for c, k, p in _REFERENCE_LIST
))
def _(spark, sf):
    return validation.reference_report(_keyed(spark, sf))


@query("latest_layer", f"""WITH {st.STORE}, twice AS (SELECT acquisition_id // 2 AS acquisition_id, layer_name, render_version, relative_path, created_at FROM layers)
SELECT acquisition_id, layer_name, relative_path FROM twice WHERE render_version <> 'v1' QUALIFY row_number() OVER (PARTITION BY acquisition_id, layer_name ORDER BY created_at DESC, relative_path) = 1""")
def _(spark, sf):
    """Two drawings per acquisition and layer, those of neighbouring events."""
    return store.latest_layer(st.layers(spark, sf).withColumn("acquisition_id", F.expr("acquisition_id div 2"))).select("acquisition_id", "layer_name", "relative_path")
