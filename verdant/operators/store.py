"""Relational operators over the stored tables: selection, retention, upserts, listings, cascades."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.operators.ranks import numbered
from verdant.schemas import REFERENCES


def by_time() -> tuple[Column, Column]:
    return F.col("acquired_at").desc(), F.col("acquisition_id").desc()


def newest(df: DataFrame, keys: list[str], order: tuple[Column, ...], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows per key. Spark limits each task's groups before the shuffle, so a hot
    key sends at most ``n`` rows per task to one place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def newest_acquisitions(acquisitions: DataFrame, n: int = K.KEPT_ACQUISITIONS) -> DataFrame:
    """Newest ``n`` per field by time, then id."""
    return newest(acquisitions, ["field_id"], by_time(), n)


def retention_split(acquisitions: DataFrame, layers: DataFrame, keep: int = K.KEPT_ACQUISITIONS) -> DataFrame:
    """Layers of all but the newest ``keep`` acquisitions: the paths to remove. Statistics stay."""
    kept = newest_acquisitions(acquisitions, keep).select("acquisition_id")
    return layers.join(acquisitions.select("acquisition_id", "field_id"), "acquisition_id").join(
        kept, "acquisition_id", "left_anti"
    )


def select_acquisition(acquisitions: DataFrame, index_values: DataFrame, cloud_free: float | None = None) -> DataFrame:
    """Per field the newest processed acquisition that has index rows."""
    ready = acquisitions.filter("processed_at IS NOT NULL")
    if cloud_free is not None:
        ready = ready.filter((F.col("valid_pixel_count") > 0) & (F.col("cloud_coverage") <= cloud_free))
    ready = ready.join(index_values.select("acquisition_id"), "acquisition_id", "left_semi")
    return newest(ready, ["field_id"], by_time(), 1).drop("rn")


def in_range(
    acquisitions: DataFrame,
    year: int | None = None,
    from_date: datetime.date | None = None,
    to_date: datetime.date | None = None,
) -> DataFrame:
    """Inclusive range on the acquisition day, written as plain time bounds so that it reaches the scan."""
    at = F.col("acquired_at")
    low, high = [], []
    if year is not None:
        low.append(datetime.date(year, 1, 1))
        high.append(datetime.date(year, 12, 31))
    if from_date is not None:
        low.append(from_date)
    if to_date is not None:
        high.append(to_date)
    if low:
        acquisitions = acquisitions.filter(at >= F.lit(max(low).isoformat()).cast("timestamp"))
    if high:
        after = min(high) + datetime.timedelta(days=1)
        acquisitions = acquisitions.filter(at < F.lit(after.isoformat()).cast("timestamp"))
    return acquisitions


def index_history(
    acquisitions: DataFrame, index_values: DataFrame, n: int | None = K.HISTORY_ACQUISITIONS, **bounds
) -> DataFrame:
    """Newest ``n`` acquisitions in range first, only then their values of the five indices."""
    picked = in_range(acquisitions, **bounds)
    if n is not None:
        picked = newest_acquisitions(picked, n).drop("rn")
    values = index_values.filter(F.col("index_name").isin(*K.CORE_INDICES))
    return picked.drop("valid_pixel_count").join(values, "acquisition_id")


def layer_statistics(layers: DataFrame, acquisitions: DataFrame, index_values: DataFrame) -> DataFrame:
    """R2: layers of the current version with the statistics of the index of the same name."""
    current = layers.filter(F.col("render_version") == K.RENDER_VERSION)
    stats = index_values.select(
        "acquisition_id", F.col("index_name").alias("layer_name"), "mean_value", "min_value", "median_value",
        "max_value", F.col("valid_pixel_count").alias("layer_valid_pixel_count"),
    )
    return current.join(acquisitions.select("acquisition_id", "field_id"), "acquisition_id").join(
        stats, ["acquisition_id", "layer_name"], "left"
    )


def latest_layer(layers: DataFrame) -> DataFrame:
    """R2: the newest drawing of each layer at the current version."""
    current = layers.filter(F.col("render_version") == K.RENDER_VERSION)
    return newest(current, ["acquisition_id", "layer_name"], (F.col("created_at").desc(), F.col("relative_path")), 1).drop("rn")


def processed_acquisitions(acquisitions: DataFrame, index_values: DataFrame, layers: DataFrame) -> DataFrame:
    """Processed, with index rows and with layers of the current version."""
    current = layers.filter(F.col("render_version") == K.RENDER_VERSION)
    return (
        acquisitions.filter("processed_at IS NOT NULL")
        .join(index_values.select("acquisition_id"), "acquisition_id", "left_semi")
        .join(current.select("acquisition_id"), "acquisition_id", "left_semi")
    )


def listed(rows: DataFrame, key: str, when: str = "created_at", within: str | None = None, page: int = 50) -> DataFrame:
    """Rows with ``place`` (from 1) and ``page``, newest first, ties by ``key``; NULL times come last.

    Over the whole table (fields, documents) places are given range by range, so a listing of any length is
    sorted in parallel; ``within`` a column (the acquisitions of a field) they are counted per group.
    """
    order = (F.col(when).desc_nulls_last(), F.col(key).asc())
    if within is None:
        placed = numbered(rows, *order, name="place").withColumn("place", F.col("place") + 1)
    else:
        placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(within).orderBy(*order)).cast("long"))
    return placed.withColumn("page", F.ceil(F.col("place") / page).cast("long"))


def completeness(acquisitions: DataFrame, index_values: DataFrame, layers: DataFrame) -> DataFrame:
    """Does an acquisition have all five index rows and all seven layers of the current version?"""
    rows = index_values.groupBy("acquisition_id").agg(F.count(F.lit(1)).alias("index_rows"))
    drawn = (
        layers.filter(F.col("render_version") == K.RENDER_VERSION)
        .groupBy("acquisition_id")
        .agg(F.count_distinct("layer_name").alias("layer_rows"))
    )
    return (
        acquisitions.join(rows, "acquisition_id", "left")
        .join(drawn, "acquisition_id", "left")
        .withColumn("has_index_values", F.coalesce("index_rows", F.lit(0)) == len(K.CORE_INDICES))
        .withColumn("has_layers", F.coalesce("layer_rows", F.lit(0)) == len(K.LAYER_NAMES))
        .drop("index_rows", "layer_rows")
    )


ACQUISITION_KEY = ["field_id", "product_id", "revision_key"]


def insert_if_new(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming acquisitions once per key, with ``created`` where the key was not stored yet."""
    first = newest(incoming, ACQUISITION_KEY, (F.col("acquired_at"), F.col("acquisition_id")), 1).drop("rn")
    known = existing.select(*ACQUISITION_KEY).distinct().withColumn("_known", F.lit(True))
    return first.join(known, ACQUISITION_KEY, "left").withColumn("created", F.col("_known").isNull()).drop("_known")


def pending_work(inserted: DataFrame, index_values: DataFrame, layers: DataFrame, need_layers: bool = True) -> DataFrame:
    """Created, unprocessed or incomplete acquisitions (history loads do not look at layers)."""
    checked = completeness(inserted, index_values, layers)
    todo = F.col("created") | F.col("processed_at").isNull() | ~F.col("has_index_values")
    if need_layers:
        todo = todo | ~F.col("has_layers")
    return checked.filter(todo)


def metric_points(history: DataFrame, recomputed: DataFrame | None = None) -> DataFrame:
    """One row per acquisition, one column per index; the stored mean wins, else the recomputed one.

    ``recomputed``: (acquisition_id, index_name, mean) taken from pixel values.
    """
    mean = F.col("mean_value")
    if recomputed is not None:
        extra = recomputed.select("acquisition_id", "index_name", F.col("mean").alias("_recomputed"))
        history = history.join(extra, ["acquisition_id", "index_name"], "left")
        mean = F.coalesce(mean, F.when(F.col("valid_pixel_count") != 0, F.col("_recomputed")))
    keys = ["field_id", "acquisition_id", "acquired_at", "cloud_coverage", "fully_cloudy"]
    return history.withColumn("_mean", mean).groupBy(*keys).pivot("index_name", list(K.CORE_INDICES)).agg(F.first("_mean"))


def series(acquisitions: DataFrame, index_values: DataFrame, **bounds) -> DataFrame:
    """Metric points of a year, or from a date on."""
    return metric_points(index_history(acquisitions, index_values, n=None, **bounds))


def field_overview(fields: DataFrame, latest: DataFrame, recommendations: DataFrame, yields: DataFrame) -> DataFrame:
    """Field with its selected acquisition, recommendation and newest yield with totals."""
    last = newest(yields, ["field_id"], (F.col("created_at").desc(), F.col("prediction_id").desc()), 1)
    area = F.coalesce(F.when(F.col("field_area_ha") != 0, F.col("field_area_ha")), F.lit(1.0))

    def total(c: str) -> Column:
        return F.round(F.coalesce(c, F.lit(0.0)) * area, 2)

    last = last.select(
        "field_id", "crop", "predicted_yield_t_ha",
        total("yield_min_expected").alias("total_yield_min_tons"),
        total("yield_max_expected").alias("total_yield_max_tons"),
    )
    shown = latest.select("field_id", F.col("acquisition_id").alias("latest_acquisition_id"), "acquired_at", "cloud_coverage")
    advice = recommendations.select("field_id", F.col("content").alias("recommendation"))
    return fields.join(shown, "field_id", "left").join(advice, "field_id", "left").join(last, "field_id", "left")


def lookup_fields(fields: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (request_id, wanted); digits match the id or the public id, other text the public id."""
    by_id = requests.withColumn("field_id", F.expr("CASE WHEN wanted RLIKE '^[0-9]+$' THEN try_cast(wanted AS BIGINT) END")).join(fields, "field_id")
    by_public = requests.join(fields, F.col("wanted") == F.col("public_id"))
    columns = ["request_id", "wanted", "field_id", "public_id"]
    return by_id.select(*columns).unionByName(by_public.select(*columns)).distinct()


def latest_wins(stored: DataFrame, changes: DataFrame, keys: list[str], updated: str) -> DataFrame:
    """One row per key, changes over stored rows, the last change over earlier ones.

    The winner is found by a partial aggregation, so a much-updated key does not gather its versions.
    """
    columns = stored.columns
    rows = stored.withColumn("_change", F.lit(0)).unionByName(changes.select(*columns).withColumn("_change", F.lit(1)))
    rest = [c for c in columns if c not in keys]
    rows = rows.withColumn("_tie", F.xxhash64(F.to_json(F.struct(*rest))))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_change", updated, "_tie")).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*columns)


def complete_acquisitions(acquisitions: DataFrame, stats: DataFrame, failures: DataFrame, processed_at: Column) -> DataFrame:
    """Marks processed acquisitions (valid pixels are those of NDVI) and keeps 500 characters of a failure."""
    done = stats.filter("index_name = 'NDVI'").select("acquisition_id", F.col("valid_pixel_count").alias("_valid"))
    failed = failures.select("acquisition_id", F.substring("message", 1, 500).alias("_error"))
    return (
        acquisitions.join(done, "acquisition_id", "left")
        .join(failed, "acquisition_id", "left")
        .withColumn("processed_at", F.when(F.col("_valid").isNotNull(), processed_at).otherwise(F.col("processed_at")))
        .withColumn("fully_cloudy", F.when(F.col("_valid").isNotNull(), F.col("_valid") == 0).otherwise(F.col("fully_cloudy")))
        .withColumn("valid_pixel_count", F.coalesce("_valid", "valid_pixel_count"))
        .withColumn("processing_error", F.when(F.col("_valid").isNull(), F.col("_error")))
        .drop("_valid", "_error")
    )


def load_report(catalogue: DataFrame, pending: DataFrame, failures: DataFrame) -> DataFrame:
    """Per field the catalogue items found, newly processed and failed."""
    bad = failures.select("acquisition_id").withColumn("_failed", F.lit(1))
    new = pending.select("acquisition_id").withColumn("_new", F.lit(1))
    return (
        catalogue.join(new, "acquisition_id", "left")
        .join(bad, "acquisition_id", "left")
        .groupBy("field_id")
        .agg(
            F.count(F.lit(1)).alias("acquisitions_found"),
            F.count_if(F.col("_new").isNotNull() & F.col("_failed").isNull()).alias("new_acquisitions_processed"),
            F.count_if(F.col("_new").isNotNull() & F.col("_failed").isNotNull()).alias("failed"),
        )
    )


def merge_pages(pages: DataFrame) -> DataFrame:
    """Catalogue pages (page_no, …) united; the last page wins per product and revision."""
    rest = [c for c in pages.columns if c not in ACQUISITION_KEY]
    best = pages.groupBy(*ACQUISITION_KEY).agg(F.max_by(F.struct(*rest), F.struct("page_no", "acquired_at", "acquisition_id")).alias("_row"))
    return best.select(*ACQUISITION_KEY, *[F.col("_row")[c].alias(c) for c in rest])


def cascade_delete(tables: dict[str, DataFrame], root: str, column: str, removed: DataFrame) -> dict[str, DataFrame]:
    """Every table without the removed rows and without rows that refer to them, over all levels."""
    gone = {root: removed.select(column).distinct()}
    out = dict(tables)
    out[root] = tables[root].join(gone[root], column, "left_anti")
    for ref in REFERENCES:
        if ref.child not in tables or ref.parent not in gone:
            continue
        parent_key = ref.column
        child_key = {"acquisitions": "acquisition_id", "fields": "field_id", "documents": "document_id"}.get(ref.child)
        doomed = out[ref.child].join(gone[ref.parent].select(parent_key), parent_key, "left_semi")
        if child_key:
            ids = doomed.select(child_key)
            gone[ref.child] = gone[ref.child].union(ids).distinct() if ref.child in gone else ids.distinct()
        out[ref.child] = out[ref.child].join(gone[ref.parent].select(parent_key), parent_key, "left_anti")
    return out


def toggle_document(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (document_id, active) set the flag; other documents keep theirs."""
    asked = requests.select("document_id", F.col("active").alias("_active"))
    return documents.join(asked, "document_id", "left").withColumn("is_active", F.coalesce("_active", "is_active")).drop("_active")
