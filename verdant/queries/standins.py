"""Views over the given tables that stand in for field-monitoring inputs.

Each stand-in is defined twice: as a DataFrame and as a SQL common table expression, both over the
whole table, with arithmetic that is exact in either engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.queries.registry import table

CROPS = ("Paxta", "G'o'za", "Bug'doy", "Kuzgi bug‘doy", "Kartoshka", "Paxta navbatdagi", "Arpa")


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(items) -> str:
    return ", ".join(sql_text(i) if isinstance(i, str) else str(i) for i in items)


# pixels: one 16 x 16 grid per five suppliers and shipping year -------------------------------


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return (
        li.groupBy(
            F.expr("l_suppkey div 5").alias("field_id"),
            F.expr("(l_suppkey div 5) * 10000 + year(l_shipdate)").alias("acquisition_id"),
            (F.col("l_orderkey") % 16).alias("row"),
            (F.col("l_partkey") % 16).alias("col"),
        )
        .agg(
            F.max("l_discount").alias("d"),
            F.max("l_tax").alias("t"),
            F.max("l_quantity").alias("q"),
            F.min("l_quantity").alias("m"),
            F.min("l_linenumber").alias("n"),
            F.bool_or(F.col("l_returnflag") != "R").alias("data_mask"),
        )
        .select(
            "field_id", "acquisition_id", "row", "col",
            (F.col("d") + 0.02).alias("B02"),
            (F.col("d") * 1.5 + 0.03).alias("B03"),
            (F.col("t") + 0.03).alias("B04"),
            (F.col("t") + 0.04).alias("B05"),
            (F.col("q") / 100.0 + 0.20).alias("B08"),
            (F.col("q") / 100.0 + 0.19).alias("B8A"),
            (F.col("m") / 200.0 + 0.05).alias("B11"),
            F.when(F.col("n") == 7, 9).otherwise(4).alias("scl"),
            "data_mask",
        )
    )


PIXELS = """
px0 AS (
  SELECT l_suppkey // 5 AS field_id, (l_suppkey // 5) * 10000 + year(l_shipdate) AS acquisition_id,
         l_orderkey % 16 AS "row", l_partkey % 16 AS col,
         max(l_discount) AS d, max(l_tax) AS t, max(l_quantity) AS q, min(l_quantity) AS m,
         min(l_linenumber) AS n, bool_or(l_returnflag <> 'R') AS data_mask
  FROM lineitem GROUP BY 1, 2, 3, 4),
pixels AS (
  SELECT field_id, acquisition_id, "row", col, d + 0.02::DOUBLE AS B02, d * 1.5::DOUBLE + 0.03::DOUBLE AS B03,
         t + 0.03::DOUBLE AS B04, t + 0.04::DOUBLE AS B05, q / 100.0::DOUBLE + 0.20::DOUBLE AS B08,
         q / 100.0::DOUBLE + 0.19::DOUBLE AS B8A, m / 200.0::DOUBLE + 0.05::DOUBLE AS B11,
         CASE WHEN n = 7 THEN 9 ELSE 4 END AS scl, data_mask
  FROM px0),
masked AS (
  SELECT *, data_mask AND scl NOT IN (0, 1, 3, 8, 9, 10, 11) AND isfinite(B02) AND isfinite(B03) AND isfinite(B04)
    AND isfinite(B05) AND isfinite(B08) AND isfinite(B8A) AND isfinite(B11) AS valid
  FROM pixels)"""


def _sql_ratio(num: str, den: str) -> str:
    return f"CASE WHEN valid AND ({den}) <> 0 THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({num}) / ({den}))) END"


CORE = f"""
core AS (
  SELECT field_id, acquisition_id, "row", col, valid,
    {_sql_ratio("B08 - B04", "B08 + B04")} AS NDVI,
    {_sql_ratio("B08 - B11", "B08 + B11")} AS NDMI,
    {_sql_ratio("B8A - B05", "B8A + B05")} AS NDRE,
    {_sql_ratio("2.5::DOUBLE * (B08 - B04)", "B08 + 6.0::DOUBLE * B04 - 7.5::DOUBLE * B02 + 1.0::DOUBLE")} AS EVI,
    {_sql_ratio("(B11 + B04) - (B08 + B02)", "(B11 + B04) + (B08 + B02)")} AS BSI
  FROM masked),
core_long AS (
  SELECT * FROM core UNPIVOT INCLUDE NULLS (value FOR index_name IN (NDVI, NDMI, NDRE, EVI, BSI)))"""


def _sql_fill(num: str, den: str, low: float, high: float, fill: float = 0.0, times: str = "") -> str:
    return (
        f"greatest({low}::DOUBLE, least({high}::DOUBLE, "
        f"(CASE WHEN valid AND ({den}) <> 0 THEN ({num}) / ({den}) ELSE {fill}::DOUBLE END){times}))"
    )


BIO = f"""
bio0 AS (
  SELECT field_id, acquisition_id, "row", col, valid,
    {_sql_fill("B08 - B04", "B08 + B04", -1, 1)} AS NDVI,
    {_sql_fill("B08 - B04", "B08 + B04 + 0.5::DOUBLE", -1, 1.5, 0, " * 1.5::DOUBLE")} AS SAVI,
    {_sql_fill("2.5::DOUBLE * (B08 - B04)", "B08 + 6.0::DOUBLE * B04 - 7.5::DOUBLE * B02 + 1.0::DOUBLE", -1, 1.5)} AS EVI,
    {_sql_fill("B8A - B05", "B8A + B05", -1, 1)} AS NDRE,
    {_sql_fill("B02", "B04 + 1e-4::DOUBLE", 0, 5, 1)} AS BRI,
    {_sql_fill("B8A - B05", "B8A + B04 + 1e-4::DOUBLE", -1, 1)} AS LCI,
    {_sql_fill("B8A - B11", "B8A + B11", -1, 1)} AS NDWI,
    {_sql_fill("B08 - B11", "B08 + B11", -1, 1)} AS NDMI,
    {_sql_fill("B11", "B08 + 1e-4::DOUBLE", 0, 5, 1)} AS MSI,
    {_sql_fill("B03 - B11", "B03 + B11", -1, 1)} AS NDSI,
    {_sql_fill("(B11 + B04) - (B08 + B02)", "(B11 + B04) + (B08 + B02)", -1, 1)} AS BSI
  FROM masked),
bio AS (
  SELECT *, greatest(0::DOUBLE, least(8::DOUBLE, 3.618::DOUBLE * EVI - 0.118::DOUBLE)) AS LAI,
    greatest(0::DOUBLE, least(6::DOUBLE, (1::DOUBLE - NDWI) * (1::DOUBLE - NDVI) * 6::DOUBLE)) AS Delta_T
  FROM bio0)"""

FLAGGED = """
means AS (SELECT field_id, acquisition_id, round(avg(NDVI), 3) AS mean_ndvi FROM bio WHERE valid GROUP BY 1, 2),
flagged AS (
  SELECT bio.*, (NDVI < 0.55 OR NDVI < mean_ndvi - 0.10::DOUBLE OR NDRE < 0.48 OR NDWI < 0.28 OR NDSI > 0.38) AS anomalous
  FROM bio JOIN means USING (field_id, acquisition_id) WHERE valid)"""


# fields: five suppliers each ------------------------------------------------------------------


def _crop(key: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in CROPS]), (key % len(CROPS)).cast("int"))


def fields(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "supplier")
        .groupBy(F.expr("s_suppkey div 5").alias("field_id"))
        .agg(F.max("s_acctbal").alias("a"), F.min("s_nationkey").alias("n"))
        .select(
            "field_id",
            F.concat(F.lit("f"), F.col("field_id").cast("string")).alias("public_id"),
            _crop(F.col("field_id")).alias("crop_name"),
            F.when(F.col("n") < 3, "1995-03-20").otherwise("1995-04-07").cast("date").alias("planted_on"),
            (F.abs("a") / 100.0 + 1.0).alias("area_hectares"),
            (F.col("n") * 0.5 + 38.0).alias("latitude"),
            (F.col("field_id") % 200 * 0.125 + 56.0).alias("longitude"),
        )
    )


FIELDS = f"""
fields AS (
  SELECT s_suppkey // 5 AS field_id, 'f' || (s_suppkey // 5) AS public_id,
    [{sql_list(CROPS)}][(s_suppkey // 5) % {len(CROPS)} + 1] AS crop_name,
    CASE WHEN min(s_nationkey) < 3 THEN DATE '1995-03-20' ELSE DATE '1995-04-07' END AS planted_on,
    abs(max(s_acctbal)) / 100.0::DOUBLE + 1.0::DOUBLE AS area_hectares,
    min(s_nationkey) * 0.5::DOUBLE + 38.0::DOUBLE AS latitude,
    (s_suppkey // 5) % 200 * 0.125::DOUBLE + 56.0::DOUBLE AS longitude
  FROM supplier GROUP BY s_suppkey // 5)"""


# acquisitions, stored index values and layers: one per event -------------------------------------


def events_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def acquisitions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return (
        table(spark, sf, "events")
        .withColumn("k", events_k())
        .select(
            F.col("user_id").alias("field_id"),
            F.col("event_id").alias("acquisition_id"),
            F.col("ts").cast("timestamp").alias("acquired_at"),
            F.col("event_type").alias("product_id"),
            F.concat(F.lit("r"), (k % 8).cast("string")).alias("revision_key"),
            F.when(F.col("event_type") != "error", F.col("value") % 100.0).alias("cloud_coverage"),
            F.when(k >= 20, F.col("ts").cast("timestamp")).alias("processed_at"),
            k.alias("valid_pixel_count"),
            (k == 0).alias("fully_cloudy"),
        )
    )


ACQUISITIONS = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
acquisitions AS (
  SELECT user_id AS field_id, event_id AS acquisition_id, ts AS acquired_at, event_type AS product_id,
    'r' || (k % 8) AS revision_key, CASE WHEN event_type <> 'error' THEN value % 100.0::DOUBLE END AS cloud_coverage,
    CASE WHEN k >= 20 THEN ts END AS processed_at, k AS valid_pixel_count, k = 0 AS fully_cloudy
  FROM ev)"""


def index_values(spark: SparkSession, sf: str) -> DataFrame:
    """Five stored means per acquisition; an error event has no BSI row, a purchase no NDMI mean."""
    names = F.array(*[F.struct(F.lit(n).alias("index_name"), F.lit(i).alias("i")) for i, n in enumerate(K.CORE_INDICES, 1)])
    v = F.col("value") * F.col("x.i") % 197.0 / 101.0 - 0.96875
    mean = F.when(~((F.col("event_type") == "purchase") & (F.col("x.index_name") == "NDMI")), v)
    return (
        table(spark, sf, "events")
        .withColumn("x", F.explode(names))
        .filter(~((F.col("event_type") == "error") & (F.col("x.index_name") == "BSI")))
        .select(
            F.col("event_id").alias("acquisition_id"),
            F.col("x.index_name").alias("index_name"),
            events_k().alias("valid_pixel_count"),
            mean.alias("mean_value"),
            (mean - 0.125).alias("min_value"),
            mean.alias("median_value"),
            (mean + 0.125).alias("max_value"),
        )
    )


INDEX_VALUES = """
iv0 AS (
  SELECT event_id AS acquisition_id, index_name, k AS valid_pixel_count,
    CASE WHEN NOT (event_type = 'purchase' AND index_name = 'NDMI') THEN value * i % 197.0::DOUBLE / 101.0::DOUBLE - 0.96875::DOUBLE END AS mean_value
  FROM ev, (VALUES ('NDVI', 1), ('NDMI', 2), ('NDRE', 3), ('EVI', 4), ('BSI', 5)) x(index_name, i)
  WHERE NOT (event_type = 'error' AND index_name = 'BSI')),
index_values AS (
  SELECT *, mean_value - 0.125::DOUBLE AS min_value, mean_value AS median_value, mean_value + 0.125::DOUBLE AS max_value FROM iv0)"""


def layers(spark: SparkSession, sf: str) -> DataFrame:
    """Seven layers per acquisition; signups were drawn by an older version, clicks lack QA."""
    return (
        table(spark, sf, "events")
        .withColumn("layer_name", F.explode(F.array(*[F.lit(n) for n in K.LAYER_NAMES])))
        .filter(~((F.col("event_type") == "click") & (F.col("layer_name") == "QA")))
        .select(
            F.col("event_id").alias("acquisition_id"),
            "layer_name",
            F.when(F.col("event_type") == "signup", "v1").otherwise(K.RENDER_VERSION).alias("render_version"),
            F.concat(F.lit("field-"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string"),
                     F.lit("/"), F.col("layer_name"), F.lit(".png")).alias("relative_path"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )
    )


LAYERS = f"""
layers AS (
  SELECT event_id AS acquisition_id, layer_name, CASE WHEN event_type = 'signup' THEN 'v1' ELSE '{K.RENDER_VERSION}' END AS render_version,
    'field-' || user_id || '/' || event_id || '/' || layer_name || '.png' AS relative_path, ts AS created_at
  FROM ev, (SELECT unnest([{sql_list(K.LAYER_NAMES)}]) AS layer_name)
  WHERE NOT (event_type = 'click' AND layer_name = 'QA'))"""

STORE = f"{ACQUISITIONS}, {INDEX_VALUES}, {LAYERS}"


# text: every document is one page; chunks, a 26-letter profile as vector, benchmark items as queries

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letter_counts(texts):
    """Counts of the 26 letters in every text of an Arrow batch; NULLs for a text that is NULL."""
    import numpy as np
    import pyarrow as pa

    parts = []
    for low in range(0, len(texts), 1024):
        rows = [t.encode() if t is not None else b"" for t in texts.slice(low, 1024).to_pylist()]
        letters = np.frombuffer(b"".join(rows), np.uint8).astype(np.int64) - ord("a")
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        inside = (letters >= 0) & (letters < 26)
        parts.append(np.bincount(owner[inside] * 26 + letters[inside], minlength=26 * len(rows)))
    counts = np.concatenate([*parts, np.zeros(0)]).astype(float)
    missing = np.repeat(texts.is_null().to_numpy(zero_copy_only=False), 26)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * 26, pa.int32()), pa.array(counts, pa.float64(), mask=missing))


def letter_profile(text: Column) -> Column:
    """Unit vector of letter counts: a stand-in for an embedding that both engines can compute."""
    from verdant.functions.vectors import l2_normalise

    return l2_normalise(F.arrow_udf(_letter_counts, "array<double>")(F.lower(text)))


def _profile_sql(t: str) -> str:
    counts = f"[(length(lower({t})) - length(replace(lower({t}), x, '')))::DOUBLE for x in string_split('{LETTERS}', '')]"
    return f"(SELECT CASE WHEN n > 0 THEN [y / n for y in v] ELSE v END FROM (SELECT v, sqrt(list_sum([z * z for z in v])) AS n FROM (SELECT {counts} AS v)))"


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text"
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("document_id"),
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("name"),
        F.coalesce(F.col("quality") == 1, F.lit(True)).alias("is_active"),
    )


#: More than any text or conversation has.
CHUNKS_PER_DOCUMENT = TURNS_PER_CONVERSATION = 1 << 32


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    from verdant.sources.corpus import ingest_pages

    return ingest_pages(pages(spark, sf)).select(
        (F.col("document_id") * CHUNKS_PER_DOCUMENT + F.col("chunk_index")).alias("chunk_id"), "document_id", "page_number", "chunk_index", "text"
    )


def _active(spark: SparkSession, sf: str) -> DataFrame:
    from verdant.operators.search import active_chunks

    # the documents come as one file, that is one task; spread before the profiles are worked out
    return active_chunks(chunks(spark, sf), documents(spark, sf)).repartition("chunk_id")


def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Active chunks for jobs that read no vector, written once."""
    from verdant.session import cut_lineage

    return cut_lineage(_active(spark, sf))


def embedded_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Active chunks with vectors, written once so that the steps of a search do not cut them again."""
    from verdant.session import cut_lineage

    return cut_lineage(_active(spark, sf).withColumn("embedding", letter_profile(F.col("text"))))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return items.withColumn("embedding", letter_profile(F.col("text")))


_W = "substr(c, st + 1, 650)"
_OFF = (
    f"CASE WHEN strpos(reverse({_W}), ' .') > 0 AND length({_W}) - strpos(reverse({_W}), ' .') - 1 > 100 THEN length({_W}) - strpos(reverse({_W}), ' .') - 1 "
    f"WHEN strpos(reverse({_W}), ' ') > 0 AND length({_W}) - strpos(reverse({_W}), ' ') > 0 THEN length({_W}) - strpos(reverse({_W}), ' ') ELSE 650 END"
)
CHUNKS = f"""
cleaned AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents),
cuts AS (SELECT doc_id, c, 0 AS st FROM cleaned WHERE length(c) > 0
  UNION ALL SELECT doc_id, c, st + greatest({_OFF} + 1, 530) FROM cuts WHERE length(c) > st + 650 AND st + greatest({_OFF} + 1, 530) < length(c)),
pieces AS (SELECT doc_id, st, CASE WHEN length(c) <= st + 650 THEN trim(substr(c, st + 1)) ELSE trim(substr(c, st + 1, {_OFF})) END AS text FROM cuts),
numbered_chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS chunk_index, text FROM pieces WHERE text <> ''),
chunks AS (SELECT doc_id * {CHUNKS_PER_DOCUMENT} + chunk_index AS chunk_id, doc_id AS document_id, 1 AS page_number, chunk_index, text FROM numbered_chunks WHERE length(text) > 30),
docs AS (SELECT doc_id AS document_id, source || '-' || doc_id AS name, coalesce(quality = 1, true) AS is_active FROM documents LEFT JOIN labels USING (doc_id))"""
#: The same with windows that begin 120 characters before the last cut.
OVERLAPPING = CHUNKS.replace(f"greatest({_OFF} + 1, 530)", f"greatest({_OFF} - 120, 1)")
EMBEDDED = f"""{CHUNKS},
embedded AS MATERIALIZED (SELECT chunks.*, name AS document_name, {_profile_sql('text')} AS embedding FROM chunks JOIN docs USING (document_id) WHERE is_active),
questions AS MATERIALIZED (SELECT item_id AS query_id, text, {_profile_sql('text')} AS embedding FROM benchmark)"""


def tokens_sql(t: str) -> str:
    return f"list_filter(regexp_extract_all(lower({t}), {sql_text(K.TOKEN_PATTERN)}), lambda t: length(t) >= 2)"
