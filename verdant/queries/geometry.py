"""Polygons built from customers; sources and the table store over the given tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.functions import geo
from verdant.operators import advice, chat
from verdant.operators import fields as fx
from verdant.operators import store as operators_store
from verdant.queries import chat as chat_queries
from verdant.queries import standins as st
from verdant.queries.registry import query, table
from verdant.session import cut_lineage, shared_folder
from verdant.sources import catalogue, corpus, library, raster, store


def customers(spark, sf):
    """The customers over all tasks: a file of few bytes and many rows would be one, and work on a polygon is long."""
    return table(spark, sf, "customer").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")


def polygons(spark, sf):
    """One square per customer, as GeoJSON text; the key decides which of ten forms it has."""
    c = customers(spark, sf)
    x = (F.expr("c_custkey div 10") % 1000 + 560.0) / 10.0
    y = (F.col("c_nationkey") + 380.0) / 10.0
    side = (F.expr("c_custkey div 10") % 5 + 10.0) / 1000.0
    c = c.select("c_custkey", "c_mktsegment", x.alias("x"), y.alias("y"), (x + side).alias("u"), (y + side).alias("v"), (y + side + 0.5).alias("w"))

    def ring(*points):
        return F.array(*[F.array(F.col(a) if isinstance(a, str) else F.lit(a), F.col(b) if isinstance(b, str) else F.lit(b)) for a, b in points])

    a, b, cc, d = ("x", "y"), ("u", "y"), ("u", "v"), ("x", "v")
    form = F.col("c_custkey") % 10
    rings = (
        F.when(form == 0, F.array(ring(a, b, cc, d, a)))
        .when(form == 1, F.array(ring(cc, d, a, b, cc)))
        .when(form == 2, F.array(ring(a, d, cc, b, a)))
        .when(form == 3, F.array(ring(a, b, cc, d)))
        .when(form == 4, F.array(ring(a, (181.0, "y"), cc, d, a)))
        .when(form == 5, F.array(ring(a, b, ("u", 91.0), d, a)))
        .when(form == 6, F.array(ring(a, b, cc, d, a)))
        .when(form == 7, F.array(ring(a, cc, b, ("x", "w"), a)))
        .when(form == 8, F.array(ring(a, b, a)))
        .otherwise(F.array(ring(a, b, cc, d, a)))
    )
    kind = F.when(form == 6, "Point").otherwise("Polygon")
    text = F.to_json(F.struct(kind.alias("type"), rings.alias("coordinates")))
    text = F.when(form == 9, F.regexp_replace(text, r"\[\[\[[0-9.]+", "[[[true")).otherwise(text)
    return c.select(F.col("c_custkey").alias("request_id"), "c_mktsegment", text.alias("geometry_json"), "x", "y", "u", "v")


SQUARES = """sq0 AS (SELECT c_custkey AS request_id, c_mktsegment, c_custkey % 10 AS form, ((c_custkey // 10) % 1000 + 560.0::DOUBLE) / 10 AS x, (c_nationkey + 380.0::DOUBLE) / 10 AS y,
  ((c_custkey // 10) % 5 + 10.0::DOUBLE) / 1000 AS side FROM customer),
squares AS (SELECT *, x + side AS u, y + side AS v FROM sq0)"""
_E = {3: "closed", 4: "longitude", 5: "latitude", 6: "type", 7: "crossing", 8: "ring", 9: "number"}
_MESSAGE = "CASE form " + " ".join(f"WHEN {n} THEN {st.sql_text(K.POLYGON_ERRORS[e])}" for n, e in _E.items()) + " END"


@query("polygon_validation", f"WITH {SQUARES} SELECT request_id, {_MESSAGE} AS message, form < 3 AS valid FROM squares")
def _(spark, sf):
    return fx.check_geometry(polygons(spark, sf)).select("request_id", "message", "valid")


# holes per customer, as (left, bottom, right, top) in tenths of a unit square; the key decides which
_HOLES = {
    0: [(2, 2, 4, 4)], 1: [(20, 20, 21, 21)], 2: [(8, 8, 12, 12)], 3: [(2, 2, 6, 6), (4, 4, 8, 8)], 4: [(2, 2, 8, 8), (3, 3, 4, 4)],
    5: [(0, 2, 4, 4)], 6: [(2, 2, 4, 4), (4, 4, 6, 6)], 7: [(2, 2, 4, 4), (6, 6, 8, 8)], 8: [(-2, 3, 12, 6)], 9: [(0, 0, 10, 10)],
    10: [(4, 2, 6, 4), (6, 4, 8, 6), (4, 6, 6, 8), (2, 4, 4, 6)], 11: [(4, 2, 6, 4), (6, 4, 8, 6), (4, 6, 6, 8)],
}
_HOLE_ERRORS = {1: "hole", 2: "hole", 3: "hole", 4: "hole", 5: "hole", 8: "hole", 9: "area", 10: "hole"}


@query("polygon_holes", f"""SELECT c_custkey AS request_id, CASE c_custkey % 12 {' '.join(f'WHEN {n} THEN {st.sql_text(K.POLYGON_ERRORS[e])}' for n, e in _HOLE_ERRORS.items())} END AS message,
  c_custkey % 12 IN (0, 6, 7, 11) AS valid FROM customer""")
def _(spark, sf):
    """Inside, outside, crossing, overlapping, nested, along a side, touching in one point, apart, across, all of it, four around
    a middle that they cut off, three that leave it open."""
    at = F.col("c_custkey") % 100 + 100

    def square(left, bottom, right, top):
        points = ((left, bottom), (right, bottom), (right, top), (left, top), (left, bottom))
        return F.array(*[F.array((at * 10 + a * 5) / 16.0 - 60.0, F.lit(b * 5) / 16.0) for a, b in points])

    kinds = [F.array(square(0, 0, 10, 10), *[square(*h) for h in _HOLES[n]]) for n in range(len(_HOLES))]
    rings = F.get(F.array(*kinds), (F.col("c_custkey") % len(_HOLES)).cast("int"))
    rows = customers(spark, sf).select(F.col("c_custkey").alias("request_id"), F.to_json(F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))).alias("geometry_json"))
    return fx.check_geometry(rows).select("request_id", "message", "valid")


def valid_rings(spark, sf):
    return fx.check_geometry(polygons(spark, sf)).filter("valid")


def _q(lat: str) -> str:
    e2 = geo.WGS84_F * (2 - geo.WGS84_F)
    e = e2**0.5
    s = f"sin(radians({lat}))"
    return f"({1 - e2!r}::DOUBLE * ({s} / (1 - {e2!r}::DOUBLE * {s} * {s}) - ln((1 - {e!r}::DOUBLE * {s}) / (1 + {e!r}::DOUBLE * {s})) / {2 * e!r}::DOUBLE))"


# a square between two meridians and parallels: width times the difference of the authalic heights
@query("geodesic_area", f"""WITH {SQUARES} SELECT request_id, round(radians(u - x) * ({_q('v')} - {_q('y')}) * {geo.WGS84_A**2!r}::DOUBLE / 2 / 10000, 4) AS hectares FROM squares WHERE form < 3""")
def _(spark, sf):
    return valid_rings(spark, sf).select("request_id", F.round(geo.area_hectares(F.col("rings")), 4).alias("hectares"))


def _pt(a, b):
    return f"'[' || round({a}, 7) || ',' || round({b}, 7) || ']'"


_CANON = "'{\"coordinates\":[[' || " + " || ',' || ".join(_pt(*p) for p in (("x", "y"), ("u", "y"), ("u", "v"), ("x", "v"), ("x", "y"))) + " || ']],\"type\":\"Polygon\"}'"


@query("canonical_polygons", f"WITH {SQUARES} SELECT request_id, sha256({_CANON}) AS geometry_hash FROM squares WHERE form < 3")
def _(spark, sf):
    return fx.with_geometry(valid_rings(spark, sf)).select("request_id", "geometry_hash")


@query("duplicate_fields", f"""WITH {SQUARES}, h AS (SELECT request_id, sha256({_CANON}) AS geometry_hash FROM squares WHERE form < 3)
SELECT request_id, request_id <> min(request_id) OVER (PARTITION BY geometry_hash) AS duplicate FROM h""")
def _(spark, sf):
    rows = cut_lineage(fx.with_geometry(valid_rings(spark, sf)))
    return fx.split_duplicates(rows, rows.limit(0), "request_id").select("request_id", "duplicate")


@query("field_registration", f"""WITH {SQUARES}, h AS (SELECT request_id, sha256({_CANON}) AS geometry_hash FROM squares WHERE form < 3 AND c_mktsegment <> 'MACHINERY'),
m AS (SELECT request_id, request_id <> min(request_id) OVER (PARTITION BY geometry_hash) AS duplicate FROM h)
SELECT request_id, CASE WHEN duplicate THEN 'duplicate' ELSE 'accepted' END AS outcome, CAST(NULL AS VARCHAR) AS reason FROM m
UNION ALL SELECT request_id, 'rejected', CASE WHEN form >= 3 THEN {_MESSAGE} ELSE 'crop_name' END FROM squares WHERE form >= 3 OR c_mktsegment = 'MACHINERY'""")
def _(spark, sf):
    crop = F.when(F.col("c_mktsegment") == "MACHINERY", "  ").otherwise(F.col("c_mktsegment"))
    requests = polygons(spark, sf).select(
        "request_id", "geometry_json", crop.alias("crop_name"), F.lit("2026-04-01").cast("date").alias("planted_on"), F.lit("bahor").alias("growth_stage")
    )
    none = spark.createDataFrame([], "geometry_hash string")
    out = fx.register_fields(requests, none, F.current_timestamp())
    empty = F.lit(None).cast("string").alias("reason")
    return (
        out["accepted"].select("request_id", F.lit("accepted").alias("outcome"), empty)
        .unionByName(out["duplicates"].select("request_id", F.lit("duplicate").alias("outcome"), empty))
        .unionByName(out["rejected"].select("request_id", F.lit("rejected").alias("outcome"), "reason"))
    )


@query("web_mercator", f"""WITH {SQUARES} SELECT request_id, round(list_min(xs), 4) AS min_x, round(list_max(ys), 4) AS max_y FROM (SELECT request_id, [radians(x) * 6378137, radians(u) * 6378137] AS xs,
  [ln(tan(radians(y) / 2 + pi() / 4)) * 6378137, ln(tan(radians(v) / 2 + pi() / 4)) * 6378137] AS ys FROM squares WHERE form < 3)""")
def _(spark, sf):
    flat = valid_rings(spark, sf).select("request_id", geo.web_mercator(F.col("rings"))[0].alias("r"))
    return flat.select(
        "request_id", F.round(F.array_min(F.transform("r", lambda p: p[0])), 4).alias("min_x"), F.round(F.array_max(F.transform("r", lambda p: p[1])), 4).alias("max_y")
    )


@query("bounding_boxes", f"""WITH {SQUARES} SELECT request_id, x AS min_lon, y AS min_lat, u AS max_lon, v AS max_lat,
  round(CASE WHEN form = 1 THEN (2 * x + 3 * u) / 5 ELSE (3 * x + 2 * u) / 5 END, 9) AS centre_lon, round(CASE WHEN form = 1 THEN (2 * y + 3 * v) / 5 ELSE (3 * y + 2 * v) / 5 END, 9) AS centre_lat FROM squares WHERE form < 3""")
def _(spark, sf):
    box = geo.bounding_box(F.col("rings"))
    rows = valid_rings(spark, sf)
    return rows.select(
        "request_id", *[box[i].alias(n) for i, n in enumerate(("min_lon", "min_lat", "max_lon", "max_lat"))],
        F.round(geo.vertex_mean(F.col("rings"), 0), 9).alias("centre_lon"), F.round(geo.vertex_mean(F.col("rings"), 1), 9).alias("centre_lat"),
    )


# sources ---------------------------------------------------------------------------------------


@query("catalogue_features", """SELECT user_id AS field_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS acquired_at, CASE WHEN event_type = 'view' THEN 'id' || event_id ELSE event_type END AS product_id,
  CASE WHEN event_type <> 'click' THEN value END AS cloud_coverage, substr(sha256('{"created":null,"id":"id' || event_id || '","processing_baseline":"05","product_uri":' ||
  CASE WHEN event_type = 'view' THEN 'null' ELSE '"' || event_type || '"' END || ',"updated":null}'), 1, 24) AS revision_key FROM events WHERE event_type <> 'error'""")
def _(spark, sf):
    rows = _catalogue(spark, sf)
    return rows.select("field_id", F.date_format("acquired_at", "yyyy-MM-dd HH:mm:ss").alias("acquired_at"), "product_id", "cloud_coverage", "revision_key")


def _catalogue(spark, sf):
    """Bodies of at most 50 features; errors lack a time, views a product name, clicks a numeric cloud share."""
    kind = F.col("event_type")
    stamp = F.when(kind != "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    properties = F.struct(
        stamp.alias("datetime"), F.when(kind == "click", "n/a").otherwise(F.col("value").cast("string")).alias("eo:cloud_cover"),
        F.when(kind != "view", kind).alias("s2:product_uri"), F.lit("05").alias("s2:processing_baseline"),
    )
    feature = F.struct(F.concat(F.lit("id"), F.col("event_id").cast("string")).alias("id"), properties.alias("properties"))
    bodies = table(spark, sf, "events").groupBy(F.col("user_id").alias("field_id"), F.expr("event_id div 50").alias("page")).agg(F.collect_list(feature).alias("features"))
    return catalogue.acquisitions(catalogue.parse_bodies(bodies.select("field_id", F.to_json(F.struct("features")).alias("body"))))


@query("raster_lines_to_pixels", f"""WITH {st.PIXELS}, bad AS (SELECT DISTINCT acquisition_id FROM pixels WHERE "row" = 3 AND col = 5 AND scl = 9),
n AS (SELECT *, row_number() OVER (PARTITION BY acquisition_id, "row" ORDER BY col) - 1 AS c FROM pixels WHERE acquisition_id NOT IN (SELECT acquisition_id FROM bad))
SELECT field_id, acquisition_id, "row", c AS col, B02, B03, B04, B05, B08, B8A, B11, scl, data_mask FROM n""")
def _(spark, sf):
    """Lines gathered from pixels, at most 16 per line; a cloudy pixel (3, 5) breaks its line's mask."""
    entry = F.struct("col", *K.BANDS, "scl", F.col("data_mask").cast("int").alias("data_mask"))
    broken = F.max(((F.col("row") == 3) & (F.col("col") == 5) & (F.col("scl") == 9)).cast("int"))
    lines = st.pixels(spark, sf).groupBy("field_id", "acquisition_id", "row").agg(F.sort_array(F.collect_list(entry)).alias("p"), broken.alias("broken"))
    arrays = [F.col("p")[name].alias(name) for name in K.BANDS] + [F.col("p.scl").alias("scl")]
    mask = F.when(F.col("broken") == 1, F.slice("p.data_mask", 2, F.size("p") - 1)).otherwise(F.col("p.data_mask"))
    return raster.pixels(lines.select("field_id", "acquisition_id", "row", *arrays, mask.alias("data_mask")))


@query("json_column_decode", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(spark, sf):
    rows = table(spark, sf, "events").withColumnRenamed("props", "props_json")
    return store.decode_json_columns(rows, props="struct<k: int>").select("event_id", "props.k")


def _job_outputs(spark, sf):
    """What the jobs hand to each of the ten tables."""
    history = operators_store.index_history(st.acquisitions(spark, sf), st.index_values(spark, sf), None)
    advised = advice.advice_json(advice.expert_advice(st.fields(spark, sf), advice.latest_means(history)))
    said = chat_queries.messages(spark, sf)
    return {
        "fields": st.fields(spark, sf),
        "acquisitions": _catalogue(spark, sf),
        "index_values": st.index_values(spark, sf),
        "artifacts": st.layers(spark, sf),
        "recommendations": advised.withColumn("acquisition_id", F.col("field_id") * 10),
        "chat_messages": said,
        "chat_summaries": chat.summary_records(said, F.current_timestamp()),
        "documents": st.documents(spark, sf),
        "chunks": st.chunks(spark, sf),
        "yield_predictions": table(spark, sf, "orders").select(F.col("o_orderkey").alias("prediction_id"), F.col("o_custkey").alias("field_id"), F.lit("paxta").alias("crop")),
    }


def _stored(name):
    """What tells a stored row of a table."""
    return {
        "fields": F.concat_ws("|", "field_id", "public_id", "crop_name"),
        "acquisitions": F.concat_ws("|", "field_id", "product_id", "revision_key", F.col("source_metadata")["product_id"], F.col("source_metadata")["processing_baseline"]),
        "index_values": F.concat_ws("|", "acquisition_id", "index_name", "valid_pixel_count"),
        "artifacts": F.concat_ws("|", "acquisition_id", "layer_name", "relative_path"),
        "recommendations": F.concat_ws("|", "field_id", "acquisition_id", "content", F.array_join("advice.red", ";"), F.array_join("advice.yellow", ";"), F.array_join("advice.green", ";")),
        "chat_messages": F.concat_ws("|", "field_id", "message_id", "role"),
        "chat_summaries": F.concat_ws("|", "field_id", "last_message_id"),
        "documents": F.concat_ws("|", "document_id", "name"),
        "chunks": F.concat_ws("|", "chunk_id", "document_id", "chunk_index", F.md5("chunk_text")),
        "yield_predictions": F.concat_ws("|", "prediction_id", "field_id", "crop"),
    }[name]


@query("table_store", f"""WITH RECURSIVE {st.STORE}, {st.FIELDS}, {st.CHUNKS}, {chat_queries.MESSAGES},
history AS (SELECT a.field_id, a.acquired_at, v.* FROM acquisitions a JOIN index_values v USING (acquisition_id)), {chat_queries.LATEST}, {chat_queries.RULES},
f AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN 'id' || event_id ELSE event_type END AS product, substr(sha256('{{"created":null,"id":"id' || event_id || '","processing_baseline":"05","product_uri":' ||
  CASE WHEN event_type = 'view' THEN 'null' ELSE '"' || event_type || '"' END || ',"updated":null}}'), 1, 24) AS revision FROM events WHERE event_type <> 'error')
SELECT 'fields' AS table_name, field_id || '|' || public_id || '|' || crop_name AS stored FROM fields
UNION ALL SELECT 'acquisitions', user_id || '|' || product || '|' || revision || '|' || product || '|05' FROM f
UNION ALL SELECT 'index_values', acquisition_id || '|' || index_name || '|' || valid_pixel_count FROM index_values
UNION ALL SELECT 'artifacts', acquisition_id || '|' || layer_name || '|' || relative_path FROM layers
UNION ALL SELECT 'recommendations', field_id || '|' || field_id * 10 || '|' || content || '|' || coalesce(red, '') || '|' || coalesce(yellow, '') || '|' || replace(green, '|', ';') FROM rule_texts
UNION ALL SELECT 'chat_messages', conv_id || '|' || message_id || '|' || role FROM messages
UNION ALL SELECT 'chat_summaries', concat_ws('|', conv_id, max(message_id) FILTER (role = 'user')) FROM messages GROUP BY conv_id
UNION ALL SELECT 'documents', document_id || '|' || name FROM docs
UNION ALL SELECT 'chunks', chunk_id || '|' || document_id || '|' || chunk_index || '|' || md5(text) FROM chunks
UNION ALL SELECT 'yield_predictions', o_orderkey || '|' || o_custkey || '|paxta' FROM orders""")
def _(spark, sf):
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    parts = []
    for name, rows in _job_outputs(spark, sf).items():
        store.write_table(rows, folder, name, buckets=8)
        parts.append(store.read_table(spark, folder, name).select(F.lit(name).alias("table_name"), _stored(name).alias("stored")))
    return reduce(DataFrame.unionAll, parts)


@query("table_lookup", f"WITH {st.STORE} SELECT acquisition_id, index_name, mean_value FROM index_values WHERE acquisition_id IN (3, 14, 159)")
def _(spark, sf):
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    store.write_table(st.index_values(spark, sf), folder, "index_values")
    return store.read_rows(spark, folder, "index_values", [3, 14, 159]).select("acquisition_id", "index_name", "mean_value")


@query("corpus_export_import", f"WITH RECURSIVE {st.CHUNKS} SELECT chunk_id, document_id, chunk_index, text AS chunk_text FROM chunks")
def _(spark, sf):
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    documents = st.documents(spark, sf)
    corpus.export_corpus(documents, st.chunks(spark, sf).withColumnRenamed("text", "chunk_text"), folder)
    restored = corpus.import_corpus(spark, folder, documents.limit(0))
    return restored[1].select("chunk_id", "document_id", "chunk_index", "chunk_text")


# The listing stands for one of a folder: two documents of three have a file, and some files no document.
_FILES = """files AS (SELECT doc_id, source || '-' || doc_id AS name, n_chars * 1000 AS length, doc_id % 3 < 2 AS own FROM documents
  UNION ALL SELECT page_id, 'extra (' || page_id || ')+.pdf', page_id * 1048576, true FROM pages)"""


def listing(spark, sf):
    docs = table(spark, sf, "documents").filter("doc_id % 3 < 2").select(F.concat_ws("-", "source", "doc_id").alias("name"), (F.col("n_chars") * 1000).alias("length"))
    extra = table(spark, sf, "pages").select(F.format_string("extra (%d)+.pdf", "page_id").alias("name"), (F.col("page_id") * 1048576).alias("length"))
    return docs.unionAll(extra).withColumn("path", F.concat(F.lit("file:/library (a+b)/"), "name"))


@query("library_reconciliation", f"""WITH {_FILES}, docs AS (SELECT doc_id AS document_id, source || '-' || doc_id AS name, coalesce(quality = 1, true) AS is_active FROM documents LEFT JOIN labels USING (doc_id))
SELECT document_id, coalesce(docs.name, f.name) AS name, coalesce(round(length / (1024 * 1024), 2), 0.0) AS size_mb, CASE WHEN document_id IS NULL THEN 0 ELSE 1 END AS chunk_count,
  coalesce(is_active, false) AS is_active, document_id IS NOT NULL AS indexed, 'file:/library (a+b)/' || f.name AS file_path FROM docs FULL JOIN (SELECT * FROM files WHERE own) f ON docs.name = f.name""")
def _(spark, sf):
    documents = st.documents(spark, sf).withColumns(
        {"file_path": F.lit(None).cast("string"), "chunk_count": F.lit(1), "created_at": F.current_timestamp()}
    )
    return library.reconcile(documents, listing(spark, sf)).drop("created_at")


@query("orphan_files", f"WITH {_FILES} SELECT name AS relative_path FROM files WHERE own AND name NOT IN (SELECT source || '-' || doc_id FROM documents WHERE doc_id % 2 = 0)")
def _(spark, sf):
    """Layers of the current version for documents with even ids, of an old one for the others."""
    version = F.when(F.col("doc_id") % 2 == 0, K.RENDER_VERSION).otherwise("v1")
    known = table(spark, sf, "documents").select(F.concat_ws("-", "source", "doc_id").alias("relative_path"), version.alias("render_version"))
    return library.orphans(listing(spark, sf), known, "file:/library (a+b)")
