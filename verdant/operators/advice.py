"""Rule-based advice per field from the latest index means and the worst clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdant import constants as K


def latest_means(history: DataFrame) -> DataFrame:
    """(field_id, ndvi, ndmi, ndre) of the newest observation per index.

    A mean of exactly 0.0 counts as missing and falls through to the median; with neither, the
    default of the index holds.
    """
    newest = Window.partitionBy("field_id", "index_name").orderBy(
        F.col("acquired_at").desc(), F.col("acquisition_id").desc()
    )
    last = (
        history.filter(F.col("index_name").isin("NDVI", "NDMI", "NDRE"))
        .withColumn("rn", F.row_number().over(newest))
        .filter("rn = 1")
    )
    mean = F.round("mean_value", 2)
    chosen = F.when(mean != 0, mean).otherwise(F.round("median_value", 2))
    return last.groupBy("field_id").agg(
        *[F.max(F.when(F.col("index_name") == n, chosen)).alias(n.lower()) for n in ("NDVI", "NDMI", "NDRE")]
    )


def _texts(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, text) for cond, text in pairs]))


def _text(name: str, *args: Column) -> Column:
    return F.format_string(K.ADVICE[name], *args) if args else F.lit(K.ADVICE[name])


def _cluster_texts(top: str) -> tuple[Column, Column]:
    def red(c: Column) -> Column:
        head = _text(
            "red_cluster", c.cluster_rank, c.compass_sector, c.area_ha, c.e_anisotropy, c.orientation_label, c.diagnosis_title
        )
        pathogen = F.when(c.pathogen_name.isNotNull(), _text("red_pathogen", c.pathogen_name)).otherwise("")
        return F.concat(head, pathogen, _text("red_action", c.recommended_treatment, c.agrotechnical_action))

    def yellow(c: Column) -> Column:
        return _text(
            "yellow_cluster", c.cluster_rank, c.compass_sector, c.area_ha, c.e_anisotropy, c.diagnosis_title, c.recommended_treatment
        )

    severe = F.filter(top, lambda c: c.risk_level.isin("CRITICAL", "HIGH"))
    moderate = F.filter(top, lambda c: c.risk_level == "MODERATE")
    empty = F.array().cast("array<string>")
    return F.coalesce(F.transform(severe, red), empty), F.coalesce(F.transform(moderate, yellow), empty)


def expert_advice(fields: DataFrame, means: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """(field_id, content, red, yellow, green): at most three texts per group.

    ``tops``: (field_id, top_clusters) of the newest analysed acquisition, if there is one.
    """
    base = fields.select("field_id", "crop_name").join(means, "field_id", "left")
    base = base.withColumn("ndvi", F.coalesce("ndvi", F.lit(0.45)))
    base = base.withColumn("ndmi", F.coalesce("ndmi", F.lit(0.25))).withColumn("ndre", F.coalesce("ndre", F.lit(0.28)))
    if tops is None:
        empty = F.array().cast("array<string>")
        base = base.withColumn("red_found", empty).withColumn("yellow_found", empty)
    else:
        red, yellow = _cluster_texts("top_clusters")
        base = base.join(tops, "field_id", "left").withColumn("red_found", red).withColumn("yellow_found", yellow)
    crop, ndvi, ndmi, ndre = (F.col(c) for c in ("crop_name", "ndvi", "ndmi", "ndre"))
    low = ndvi < 0.35
    red_rules = _texts((low, _text("red_ndvi", crop, ndvi)), (~low & (ndmi < 0.15), _text("red_ndmi")))
    pale = ndre < 0.25
    yellow_rules = _texts((pale, _text("yellow_ndre", ndre)), (~pale & (ndvi < 0.55), _text("yellow_ndvi", ndvi)))
    green = _texts(
        (ndvi >= 0.55, _text("green_high", ndvi)),
        (ndvi < 0.55, _text("green_low", ndvi)),
        (ndmi >= 0.25, _text("green_ndmi")),
        (ndre >= 0.35, _text("green_ndre")),
    )

    def group(found: str, rules: Column) -> Column:
        return F.slice(F.when(F.size(found) > 0, F.col(found)).otherwise(rules), 1, 3)

    return base.select(
        "field_id",
        _text("content", crop).alias("content"),
        group("red_found", red_rules).alias("red"),
        group("yellow_found", yellow_rules).alias("yellow"),
        F.slice(green, 1, 3).alias("green"),
    )


def advice_json(advice: DataFrame) -> DataFrame:
    return advice.withColumn("advice_json", F.to_json(F.struct("red", "yellow", "green")))


def clean_advice(raw: DataFrame, column: str = "output_text") -> DataFrame:
    """Trims a structured answer; rows of the wrong shape get ``rejected`` = TRUE.

    Every group must be present as a list of strings; blanks go, three per group stay.
    """
    groups = ("red", "yellow", "green")
    variant = F.try_parse_json(F.col(column))
    df = raw.withColumn("_v", variant)
    shape = F.lit(True)
    for name in groups:
        path = F.try_variant_get("_v", f"$.{name}", "array<variant>")
        only_text = F.forall(path, lambda x: F.schema_of_variant(x) == "STRING")
        shape = shape & F.coalesce(only_text, F.lit(False))
    df = df.withColumn("rejected", ~F.coalesce(shape, F.lit(False)))
    for name in groups:
        items = F.try_variant_get("_v", f"$.{name}", "array<string>")
        cleaned = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
        df = df.withColumn(name, F.when(~F.col("rejected"), F.slice(cleaned, 1, 3)))

    def block(name: str) -> Column:
        lines = F.array_join(F.transform(name, lambda x: F.concat(F.lit("- "), x)), "\n")
        return F.when(F.size(name) > 0, F.concat(F.lit(f"{K.ADVICE_LABELS[name]}:\n"), lines))

    blocks = F.array_join(F.array_compact(F.array(*[block(n) for n in groups])), "\n\n")
    content = F.when(blocks == "", K.ADVICE_EMPTY).otherwise(blocks)
    return df.withColumn("content", F.when(~F.col("rejected"), content)).drop("_v")
