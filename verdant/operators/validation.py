"""Row, request, key and reference checks. Rows are never dropped silently: violations are a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.schemas import REFERENCES, UNIQUE_KEYS


def _check(ok: Column, message: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(message))


def _violations(df: DataFrame, *checks: Column) -> DataFrame:
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def between_or_null(c: str, low: float, high: float) -> Column:
    return F.col(c).isNull() | F.col(c).between(low, high)


def text_ok(c: str, longest: int = K.MAX_TEXT_FIELD) -> Column:
    return F.length(F.trim(c)).between(1, longest)


def check_fields(df: DataFrame) -> DataFrame:
    """V1 for fields."""
    return _violations(
        df,
        _check(F.col("area_hectares") > 0, "area_hectares"),
        _check(text_ok("crop_name"), "crop_name"),
        _check(text_ok("growth_stage"), "growth_stage"),
        _check(F.col("planted_on").isNotNull(), "planted_on"),
    )


def check_acquisitions(df: DataFrame) -> DataFrame:
    """V1 for acquisitions."""
    return _violations(
        df,
        _check(between_or_null("cloud_coverage", 0.0, 100.0), "cloud_coverage"),
        _check(F.col("valid_pixel_count").isNull() | (F.col("valid_pixel_count") >= 0), "valid_pixel_count"),
        _check(F.col("fully_cloudy").isNotNull(), "fully_cloudy"),
    )


def check_layers(df: DataFrame) -> DataFrame:
    """V1 for drawn layers."""
    return _violations(df, _check(F.col("width") > 0, "width"), _check(F.col("height") > 0, "height"))


def check_messages(df: DataFrame) -> DataFrame:
    """V1 for chat messages."""
    return _violations(
        df,
        _check(F.col("role").isin(*K.CHAT_ROLES), "role"),
        _check(F.col("content").isNotNull(), "content"),
    )


def check_requests(df: DataFrame, today: Column) -> DataFrame:
    """V2, one row per message of a request (request_id, from_date, role, content, language, mode).

    The message cap is counted per request by a map-side combined aggregation and joined back.
    """
    caps = df.groupBy("request_id").agg(F.count(F.lit(1)).alias("messages"))
    content = F.length("content")
    checked = _violations(
        df.join(caps, "request_id"),
        _check(F.col("from_date").isNull() | (F.col("from_date") <= today), "from_date"),
        _check(F.col("messages").between(1, K.MAX_CHAT_MESSAGES), "messages"),
        _check(F.col("role").isin(*K.CHAT_ROLES), "role"),
        _check(content.between(1, K.MAX_CHAT_MESSAGE_LENGTH), "content"),
        _check(F.col("language").isNull() | F.col("language").isin(*K.LANGUAGE_NAMES), "language"),
        _check(F.col("mode").isin(*K.RAG_MODES), "mode"),
    )
    return checked


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and quarantined rows."""
    clean = F.size("violations") == 0
    return checked.filter(clean).drop("violations"), checked.filter(~clean)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """V3: keys that occur more than once; counted per task first, so a hot key costs one row per task."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def missing_parents(child: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """V3: referencing values without a parent row, with the number of rows that use them.

    Both sides are counted per value in one aggregation, combined inside each task first: many rows of one value
    do not meet in a task, and nothing is sorted.
    """
    kind = child.schema[column].dataType
    uses = child.filter(F.col(column).isNotNull()).select(column, F.lit(1).cast("long").alias("rows"), F.lit(0).alias("_known"))
    known = parent.select(column, F.lit(0).cast("long").alias("rows"), F.lit(1).alias("_known"))
    counted = uses.unionByName(known).groupBy(column).agg(F.sum("rows").alias("rows"), F.max("_known").alias("_known"))
    return counted.filter("_known = 0").select(F.col(column).cast(kind).alias(column), "rows")


def key_report(tables: dict[str, DataFrame]) -> DataFrame:
    """V3 for every declared key of the given tables: (table_name, key_columns, key, copies) of repeated ones."""
    parts = []
    for name, keys in UNIQUE_KEYS.items():
        for key in keys if name in tables else ():
            found = duplicate_keys(tables[name], key)
            parts.append(found.select(F.lit(name).alias("table_name"), F.lit(",".join(key)).alias("key_columns"), F.concat_ws("|", *key).alias("key"), "copies"))
    return reduce(DataFrame.unionAll, parts)


def reference_report(tables: dict[str, DataFrame]) -> DataFrame:
    """V3 for every declared reference between the given tables: (table_name, column_name, value, rows) without a parent."""
    parts = []
    for ref in REFERENCES:
        if ref.child in tables and ref.parent in tables:
            found = missing_parents(tables[ref.child], ref.column, tables[ref.parent])
            parts.append(found.select(F.lit(ref.child).alias("table_name"), F.lit(ref.column).alias("column_name"), F.col(ref.column).alias("value"), "rows"))
    return reduce(DataFrame.unionAll, parts)
