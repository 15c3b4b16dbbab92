"""Chat-log analytics and advice over conversations and the event stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant import constants as K
from verdant.operators import advice, chat, store
from verdant.plans import analysis
from verdant.queries import clusters as cq
from verdant.queries import standins as st
from verdant.queries.registry import query, table


def messages(spark, sf):
    """Ids in turn order; one message per hour from 2024 on."""
    stamp = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 86400 + F.col("turn") * 3600)
    return table(spark, sf, "conversations").select(
        "conv_id", (F.col("conv_id") * st.TURNS_PER_CONVERSATION + F.col("turn")).alias("message_id"), "role", F.col("text").alias("content"), stamp.alias("created_at")
    )


MESSAGES = f"""messages AS (SELECT conv_id, conv_id * {st.TURNS_PER_CONVERSATION} + turn AS message_id, role, text AS content,
  TIMESTAMP '2024-01-01' + to_seconds(conv_id * 86400 + turn * 3600) AS created_at FROM conversations)"""


@query("last_user_message", f"""WITH {MESSAGES} SELECT conv_id, coalesce(arg_max(content, message_id) FILTER (role = 'user'), '') AS last_user_message,
  max(message_id) FILTER (role = 'user') AS last_user_id FROM messages GROUP BY 1""")
def _(spark, sf):
    return chat.last_user_message(messages(spark, sf))


@query("message_listing", f"WITH {MESSAGES} SELECT conv_id, message_id, role FROM messages QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY message_id) <= 50")
def _(spark, sf):
    return chat.oldest(messages(spark, sf), K.CHAT_LISTING).select("conv_id", "message_id", "role")


LINES = f"""{MESSAGES},
numbered AS (SELECT *, substr(trim(content), 1, 180) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY message_id) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM messages),
lines AS (SELECT *, '[#' || message_id || ', ' || strftime(created_at, '%Y-%m-%d %H:%M') || '] ' || CASE WHEN role = 'user' THEN 'Foydalanuvchi' ELSE 'Yordamchi' END || ': ' || t AS line
  FROM numbered WHERE rn <= 30),
digest AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY message_id) AS transcript,
  'Asosiy xulosa: ' || string_agg(t, '; ' ORDER BY message_id) FILTER (rn > least(n, 30) - 3) AS fallback_summary, count(*) AS message_count FROM lines GROUP BY 1)"""


@query("transcript_digest", f"WITH {LINES} SELECT * FROM digest")
def _(spark, sf):
    return chat.transcript(messages(spark, sf))


@query("summary_records", f"""WITH {LINES}, last AS (SELECT conv_id, max(message_id) FILTER (role = 'user') AS last_message_id FROM messages GROUP BY 1)
SELECT conv_id, fallback_summary AS summary_text, message_count, last_message_id FROM digest JOIN last USING (conv_id)""")
def _(spark, sf):
    return chat.summary_records(messages(spark, sf), F.current_timestamp()).drop("updated_at")


_PICKED = "picked AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY acquired_at DESC, acquisition_id DESC) AS rn FROM acquisitions)"


@query("recent_metrics_context", f"""WITH {st.STORE}, {st.FIELDS}, {_PICKED},
h AS (SELECT field_id, index_name, count(*) AS n, round(avg(mean_value), 6) AS m FROM picked JOIN index_values v USING (acquisition_id) WHERE rn <= 5 GROUP BY 1, 2)
SELECT field_id, crop_name, coalesce(max(n) FILTER (index_name = 'NDVI'), 0) AS ndvi_points, max(m) FILTER (index_name = 'NDVI') AS ndvi_mean
FROM fields LEFT JOIN h USING (field_id) GROUP BY 1, 2""")
def _(spark, sf):
    df = chat.recent_metrics(st.acquisitions(spark, sf), st.index_values(spark, sf), st.fields(spark, sf))
    kind = "struct<field: struct<crop_name: string>, metrics: map<string, array<struct<mean_ndvi: double>>>>"
    read = df.withColumn("c", F.from_json("context", kind))
    points = F.coalesce(F.try_element_at("c.metrics", F.lit("NDVI")), F.expr("cast(array() as array<struct<mean_ndvi: double>>)"))
    total = F.aggregate(F.filter(points, lambda p: p.mean_ndvi.isNotNull()), F.lit(0.0), lambda t, p: t + p.mean_ndvi)
    return read.select(
        "field_id", F.col("c.field.crop_name").alias("crop_name"), F.size(points).alias("ndvi_points"),
        F.round(F.when(F.size(points) > 0, total / F.size(points)), 6).alias("ndvi_mean"),
    )


@query("rounded_history", f"""WITH {st.STORE}, {_PICKED} SELECT field_id, acquisition_id, product_id, index_name, round(cloud_coverage, 2) AS cloud_coverage, round(min_value, 2) AS min_value,
  round(mean_value, 2) AS mean_value, round(median_value, 2) AS median_value, round(max_value, 2) AS max_value FROM picked JOIN index_values USING (acquisition_id) WHERE rn <= 30""")
def _(spark, sf):
    return chat.history_rounded(st.acquisitions(spark, sf), st.index_values(spark, sf)).drop("acquired_at")


_MODE = "['advanced', 'all_in_one', 'graph', 'naive', 'direct_llm', 'auto'][conv_id % 6 + 1]"


@query("response_strategies", f"""WITH s AS (SELECT {_MODE} AS mode, length(text) > 60 AS c, turn % 2 = 0 AS g FROM conversations)
SELECT CASE WHEN mode = 'all_in_one' THEN CASE WHEN c AND g THEN 'all_in_one' WHEN c THEN 'advanced' WHEN g THEN 'graph' ELSE 'direct_llm' END
  WHEN mode = 'graph' THEN CASE WHEN g THEN 'graph' ELSE 'direct_llm' END WHEN mode = 'naive' THEN CASE WHEN c THEN 'naive' ELSE 'direct_llm' END
  WHEN mode = 'direct_llm' THEN 'direct_llm' ELSE CASE WHEN c THEN 'advanced' ELSE 'direct_llm' END END AS rag_strategy, count(*) AS messages FROM s GROUP BY 1""")
def _(spark, sf):
    mode = F.get(F.array(*[F.lit(m) for m in K.RAG_MODES]), (F.col("conv_id") % 6).cast("int"))
    found = chat.response_strategy(mode, F.length("text") > 60, F.col("turn") % 2 == 0)
    return chat.strategy_counts(table(spark, sf, "conversations").select(found.alias("rag_strategy")))


@query("message_append", f"""WITH {MESSAGES} SELECT message_id, CASE WHEN role = 'assistant' THEN 'advanced' END AS rag_strategy FROM messages""")
def _(spark, sf):
    rows = messages(spark, sf)
    asked, answered = rows.filter("role <> 'assistant'"), rows.filter("role = 'assistant'")
    both = chat.append_messages(answered.withColumn("rag_strategy", F.lit("advanced")), asked)
    return both.select("message_id", "rag_strategy")


# the first words of a document as advice; every label combination breaks the shape in its own way
@query("clean_structured_advice", """WITH a AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'no json' WHEN quality = 0 THEN '{"red":["x"],"yellow":[1],"green":[]}'
  ELSE '{"red":[" ' || doc_id || ' ",""," b","c","d"],"yellow":[],"green":["ok"]}' END AS output_text, toxic = 1 OR quality = 0 AS rejected FROM labels)
SELECT doc_id, rejected, CASE WHEN NOT rejected THEN '🔴 Zudlik bilan qilinishi shart bo''lgan ishlar:' || chr(10) || '- ' || doc_id || chr(10) || '- b' || chr(10) || '- c' || chr(10) || chr(10)
  || '🟢 Dalaning yaxshi va sog''lom rivojlanayotgan qismlari:' || chr(10) || '- ok' END AS content FROM a""")
def _(spark, sf):
    good = F.format_string('{"red":[" %d ",""," b","c","d"],"yellow":[],"green":["ok"]}', F.col("doc_id"))
    text = F.when(F.col("toxic") == 1, "no json").when(F.col("quality") == 0, '{"red":["x"],"yellow":[1],"green":[]}').otherwise(good)
    rows = table(spark, sf, "labels").select("doc_id", text.alias("output_text"))
    return advice.clean_advice(rows).select("doc_id", "rejected", "content")


def _d2(v: str) -> str:
    return f"CAST(round({v}::DECIMAL(12, 4), 2) AS DECIMAL(12, 2))"


def _t(name: str, *args: str) -> str:
    parts = K.ADVICE[name].replace("%.2f", "%s").split("%s")
    out = st.sql_text(parts[0])
    for arg, part in zip(args, parts[1:], strict=True):
        out += f" || {arg} || {st.sql_text(part)}"
    return out


RULES = f"""
rule_texts AS (SELECT field_id, {_t('content', 'crop_name')} AS content,
  CASE WHEN ndvi < 0.35 THEN {_t('red_ndvi', 'crop_name', _d2('ndvi'))} WHEN ndmi < 0.15 THEN {_t('red_ndmi')} END AS red,
  CASE WHEN ndre < 0.25 THEN {_t('yellow_ndre', _d2('ndre'))} WHEN ndvi < 0.55 THEN {_t('yellow_ndvi', _d2('ndvi'))} END AS yellow,
  concat_ws('|', CASE WHEN ndvi >= 0.55 THEN {_t('green_high', _d2('ndvi'))} ELSE {_t('green_low', _d2('ndvi'))} END,
    CASE WHEN ndmi >= 0.25 THEN {_t('green_ndmi')} END, CASE WHEN ndre >= 0.35 THEN {_t('green_ndre')} END) AS green FROM latest)"""
LATEST = """
newest AS (SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY field_id, index_name ORDER BY acquired_at DESC, acquisition_id DESC) = 1),
picked_mean AS (SELECT field_id, index_name, CASE WHEN round(mean_value, 2) <> 0 THEN round(mean_value, 2) ELSE round(median_value, 2) END AS v FROM newest),
latest AS (SELECT f.field_id, crop_name, coalesce(max(v) FILTER (index_name = 'NDVI'), 0.45) AS ndvi, coalesce(max(v) FILTER (index_name = 'NDMI'), 0.25) AS ndmi,
  coalesce(max(v) FILTER (index_name = 'NDRE'), 0.28) AS ndre FROM fields f LEFT JOIN picked_mean USING (field_id) GROUP BY 1, 2)"""


@query("expert_advice", f"""WITH {st.STORE}, {st.FIELDS}, history AS (SELECT a.field_id, a.acquired_at, v.* FROM acquisitions a JOIN index_values v USING (acquisition_id)), {LATEST}, {RULES}
SELECT field_id, content, coalesce(red, '') AS red, coalesce(yellow, '') AS yellow, green FROM rule_texts""")
def _(spark, sf):
    history = store.index_history(st.acquisitions(spark, sf), st.index_values(spark, sf), None)
    df = advice.expert_advice(st.fields(spark, sf), advice.latest_means(history))
    return df.select("field_id", "content", *[F.array_join(c, "|").alias(c) for c in ("red", "yellow", "green")])


# the pixel stand-in as catalogue: years up to 1997 are stored and measured already
@query("field_analysis", f"""WITH RECURSIVE {cq.DIAGNOSED}, {st.CORE},
fresh AS (SELECT DISTINCT field_id, acquisition_id FROM pixels WHERE acquisition_id % 10000 > 1997),
last_year AS (SELECT field_id, max(acquisition_id) AS acquisition_id, count(*) AS new_acquisitions_processed FROM fresh GROUP BY 1),
history AS (SELECT field_id, acquisition_id, acquisition_id AS acquired_at, index_name, avg(value) AS mean_value, median(value) AS median_value FROM core_long JOIN fresh USING (field_id, acquisition_id) GROUP BY 1, 2, 4),
{LATEST}, {RULES},
tops AS (SELECT field_id, count(*) FILTER (risk_level IN ('CRITICAL', 'HIGH')) AS severe, count(*) FILTER (risk_level = 'MODERATE') AS moderate
  FROM ranked JOIN last_year USING (field_id, acquisition_id) WHERE cluster_rank <= 5 GROUP BY 1)
SELECT field_id, acquisition_id, new_acquisitions_processed, content, least(3, CASE WHEN coalesce(severe, 0) > 0 THEN severe WHEN red IS NOT NULL THEN 1 ELSE 0 END) AS red,
  least(3, CASE WHEN coalesce(moderate, 0) > 0 THEN moderate WHEN yellow IS NOT NULL THEN 1 ELSE 0 END) AS yellow, green
FROM last_year JOIN rule_texts USING (field_id) LEFT JOIN tops USING (field_id)""")
def field_analysis_query(spark, sf):
    pixels = st.pixels(spark, sf)
    result = _analysed(spark, sf, pixels, F.col("acquisition_id") % 10000 > 1997)
    return result["recommendations"].join(result["counts"], "field_id").select(
        "field_id", "acquisition_id", "new_acquisitions_processed", "content", F.size("red").alias("red"), F.size("yellow").alias("yellow"),
        F.array_join("green", "|").alias("green"),
    )


def _analysed(spark, sf, pixels, is_new):
    """The pixels' acquisitions as catalogue; all but the new ones are stored and measured already."""
    seen = pixels.groupBy("field_id", "acquisition_id").agg(F.count(F.lit(1)).alias("n"))
    last = seen.groupBy("field_id").agg(F.max("acquisition_id").alias("last_id"))
    rows = seen.join(last, "field_id").select(
        "field_id", "acquisition_id", F.make_timestamp(F.col("acquisition_id") % 10000, F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("acquired_at"),
        F.col("acquisition_id").cast("string").alias("product_id"), F.lit("r1").alias("revision_key"), F.lit(10.0).alias("cloud_coverage"), is_new.alias("is_new"),
    ).withColumns(
        {
            "processed_at": F.when(~F.col("is_new"), F.col("acquired_at")), "valid_pixel_count": F.lit(1).cast("long"),
            "fully_cloudy": F.lit(False), "processing_error": F.lit(None).cast("string"),
        }
    ).drop("is_new")
    stored = rows.filter("processed_at IS NOT NULL")
    names = F.explode(F.array(*[F.lit(n) for n in K.CORE_INDICES]))
    old = stored.select("acquisition_id", names.alias("index_name"), *[F.lit(0.5).alias(c) for c in ("min_value", "mean_value", "median_value", "max_value")],
                        F.lit(1).cast("long").alias("valid_pixel_count"))
    layers = stored.select("acquisition_id", F.explode(F.array(*[F.lit(n) for n in K.LAYER_NAMES])).alias("layer_name"),
                           F.lit(K.RENDER_VERSION).alias("render_version"), F.lit("x").alias("relative_path"))
    return analysis.analyse(st.fields(spark, sf), rows, stored, old, layers, pixels, F.lit("2026-01-01").cast("timestamp"), tile=cq.TILE)


# the usual run: one new acquisition per field, compared with stored ones; red edges rise on fields with even ids
_RAISED = "t + 0.04::DOUBLE + CASE WHEN field_id % 2 = 0 AND acquisition_id = max(acquisition_id) OVER (PARTITION BY field_id) THEN 0.3::DOUBLE ELSE 0::DOUBLE END AS B05"


@query("incremental_flag", f"""WITH {st.PIXELS.replace('t + 0.04::DOUBLE AS B05', _RAISED)}, {st.BIO},
seen AS (SELECT DISTINCT field_id, acquisition_id FROM pixels),
last_two AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY acquisition_id DESC) AS rn FROM seen QUALIFY rn <= 2),
water AS (SELECT field_id, rn, avg(NDRE) AS ndre, avg(NDWI) AS ndwi FROM bio JOIN last_two USING (field_id, acquisition_id) WHERE valid GROUP BY 1, 2)
SELECT field_id, acquisition_id, coalesce(b.ndre - a.ndre > 0.08 AND b.ndwi - a.ndwi < 0.04, false) AS historical_ndre_before_ndwi_drop
FROM last_two LEFT JOIN water a USING (field_id, rn) LEFT JOIN (SELECT field_id, ndre, ndwi FROM water WHERE rn = 2) b USING (field_id) WHERE rn = 1""")
def _(spark, sf):
    pixels = st.pixels(spark, sf)
    last = pixels.groupBy("field_id").agg(F.max("acquisition_id").alias("last_id"))
    raised = F.when((F.col("field_id") % 2 == 0) & (F.col("acquisition_id") == F.col("last_id")), 0.3).otherwise(0.0)
    pixels = pixels.join(last, "field_id").withColumn("B05", F.col("B05") + raised).drop("last_id")
    report = _analysed(spark, sf, pixels, F.col("acquisition_id") == F.col("last_id"))["report"]
    return report.select("field_id", "acquisition_id", "historical_ndre_before_ndwi_drop")
