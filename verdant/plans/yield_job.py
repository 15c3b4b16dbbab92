"""M5: yield estimates for all fields in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.operators import features as fx
from verdant.operators import yields as yx
from verdant.session import cut_lineage
from verdant.sources import weather as wx


def observations(fields: DataFrame, weather_sources: list[DataFrame], points: DataFrame, radar: DataFrame | None = None):
    """Weather, optical and radar rows for every field (field_id, latitude, longitude, crop_name, …).

    ``weather_sources``: rows per provider in order of preference; ``points``: metric points of
    processed acquisitions. Fields without observations get the constant spines.
    """
    planned = fx.with_calendar(fields)
    requests = planned.select("field_id", "latitude", F.col("season_start").alias("start_date"), F.col("season_end").alias("end_date"))
    daily = wx.with_climatology(requests, weather_sources, "field_id")
    place = planned.select("field_id", "latitude", "longitude", "planting_date", "harvest_date")
    weather = fx.with_crop_time(daily.join(place, "field_id"))
    built = fx.optical_from_means(points).join(planned.select("field_id"), "field_id", "left_semi")
    optical = built.unionByName(fx.baseline_spine(planned, built, 10, K.OPTICAL_BASELINE))
    spine = fx.baseline_spine(planned, radar, 12, K.RADAR_BASELINE)
    echoes = spine if radar is None else radar.select("field_id", "date", "s1_vv", "s1_vh").unionByName(spine)
    return planned, weather, optical, echoes


def estimate_yields(planned: DataFrame, weather: DataFrame, optical: DataFrame, radar: DataFrame, registry: list[yx.Fitted], target_year: int = 2026):
    """Records per field: estimate, interval, totals, factors and phenology.

    A field is scored by the model of its crop that ``planned.model_name`` asks for, else by the crop's latest; fields
    of a crop without any model have no record.
    """
    matrix = cut_lineage(fx.monthly_features(weather, optical, radar, target_year))
    asked = F.col("model_name") if "model_name" in planned.columns else F.lit(None).cast("string")
    named = cut_lineage(planned.withColumn("model", yx.chosen_model(registry, F.col("crop"), asked)).filter("model IS NOT NULL"))
    estimates = yx.ensemble(yx.score_each(registry, matrix, named), named)
    factors = named.select("field_id", "model").join(yx.factors_of_models(registry, matrix), "model")
    timeline = fx.phenology(fx.with_optical_indices(optical), fx.with_radar_ratio(radar), weather, planned)
    return yx.yield_records(estimates, factors, timeline, named)
