"""The incremental analysis of all fields that have new acquisitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.operators import advice, anomaly, store, zonal
from verdant.operators.components import TILE
from verdant.session import cut_lineage


NO_PIXELS = "no pixels were read"


def biophysical_means(pixels: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Mean of the named indices under the mask, long form."""
    valid = zonal.biophysical_pixels(pixels, keep_invalid=False)
    wide = valid.groupBy(*zonal.KEYS).agg(*[F.avg(n).alias(n) for n in names])
    return wide.unpivot(zonal.KEYS, [F.col(n) for n in names], "index_name", "mean_value")


def analyse(
    fields: DataFrame, incoming: DataFrame, acquisitions: DataFrame, index_values: DataFrame, layers: DataFrame, pixels: DataFrame,
    now: Column, need_layers: bool = True, tile: int = TILE, rejected: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """New acquisitions and incomplete ones are measured; the newest of them gives a field its advice.

    Everything up to the statistics is one plan; only the component labelling runs in rounds. ``rejected``
    (acquisition_id, message) are rasters that could not be read: their error is recorded and they stay
    pending. So does an acquisition without any pixels.
    """
    inserted = store.insert_if_new(incoming, acquisitions)
    pending = cut_lineage(store.pending_work(inserted, index_values, layers, need_layers).select("field_id", "acquisition_id", "acquired_at"))
    fresh_pixels = pixels.join(pending.select("acquisition_id"), "acquisition_id", "left_semi")
    measured = cut_lineage(zonal.zonal_statistics(fresh_pixels))
    values = store.latest_wins(
        index_values.withColumn("_at", F.lit(0)), measured.drop("field_id").withColumn("_at", F.lit(1)), ["acquisition_id", "index_name"], "_at"
    ).drop("_at")
    known = acquisitions.unionByName(inserted.filter("created").select(*acquisitions.columns))
    unread = pending.join(measured, "acquisition_id", "left_anti").select("acquisition_id", F.lit(NO_PIXELS).alias("message"))
    if rejected is not None:
        told = rejected.groupBy("acquisition_id").agg(F.min("message").alias("told"))
        unread = unread.join(told, "acquisition_id", "left").select("acquisition_id", F.coalesce("told", "message").alias("message"))
    done = store.complete_acquisitions(known, measured, unread, now)
    fresh = pending.join(unread.select("acquisition_id"), "acquisition_id", "left_anti")
    newest = store.newest(fresh, ["field_id"], store.by_time(), 1).drop("rn")
    # the report looks at these pixels a dozen times
    newest_pixels = cut_lineage(fresh_pixels.join(newest.select("acquisition_id"), "acquisition_id", "left_semi"))
    # the rule compares a field's last two observations, of which all but the newest are mostly stored ones
    observed = done.filter("processed_at IS NOT NULL").join(newest.select("field_id"), "field_id", "left_semi")
    last_two = store.newest(observed, ["field_id"], store.by_time(), 2).select("acquisition_id", "acquired_at")
    water = biophysical_means(pixels.join(last_two, "acquisition_id", "left_semi"), ("NDRE", "NDWI")).join(last_two, "acquisition_id")
    flag = cut_lineage(anomaly.drop_order_flag(water))
    report = cut_lineage(anomaly.anomaly_report(newest_pixels, fields, flag, tile))
    history = store.index_history(done, values, K.HISTORY_ACQUISITIONS)
    own = fields.join(newest.select("field_id"), "field_id", "left_semi")
    texts = advice.expert_advice(own, advice.latest_means(history), report.select("field_id", "top_clusters"))
    recommendations = advice.advice_json(texts).join(newest.select("field_id", "acquisition_id"), "field_id").select(
        "field_id", "acquisition_id", "content", "red", "yellow", "green", "advice_json", F.lit(K.RULES_MODEL).alias("model_name"), now.alias("created_at")
    )
    return {
        "acquisitions": done,
        "index_values": values,
        "removed_layers": store.retention_split(done, layers),
        "selected": store.select_acquisition(done, values),
        "report": report,
        "recommendations": recommendations,
        "counts": fresh.groupBy("field_id").agg(F.count(F.lit(1)).alias("new_acquisitions_processed")),
    }
