"""Yield scoring: feature alignment, Spark ML tree models, ensembles, factors and records."""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.operators.features import FEATURES
from verdant.session import cut_lineage


def align_features(matrix: DataFrame, expected: list[str]) -> DataFrame:
    """M1: expected columns in order; a missing column and every non-number is 0."""

    def clean(name: str) -> Column:
        if name not in matrix.columns:
            return F.lit(0.0).alias(name)
        c = F.col(name).cast("double")
        real = F.coalesce(F.abs(c) < F.lit(math.inf), F.lit(False))
        return F.when(real, c).otherwise(F.lit(0.0)).alias(name)

    keys = [c for c in ("field_id", "year_month") if c in matrix.columns]
    return matrix.select(*keys, *[clean(n) for n in expected])


def train(matrix: DataFrame, labels: DataFrame, kind: str = "random_forest", features: list[str] = FEATURES, seed: int = 7) -> PipelineModel:
    """M2: a tree regressor over field months; labels: (field_id, yield_t_ha)."""
    # tree training reads its input several times; without a cut the whole plan would run each time
    rows = cut_lineage(align_features(matrix, features).join(labels, "field_id"))
    settings = {"featuresCol": "features", "labelCol": "yield_t_ha", "predictionCol": "prediction", "seed": seed, "maxDepth": 5}
    if kind == "random_forest":
        regressor = RandomForestRegressor(numTrees=20, **settings)
    else:
        regressor = GBTRegressor(maxIter=20, **settings)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, regressor]).fit(rows)


def score(model: PipelineModel, matrix: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """M2: (field_id, year_month, prediction)."""
    return model.transform(align_features(matrix, features)).select("field_id", "year_month", "prediction")


class Fitted(NamedTuple):
    """A model in the registry; of a crop's models the last by name and version is the latest."""

    crop: str
    name: str
    version: int
    model: PipelineModel

    @property
    def label(self) -> str:
        return f"{self.crop}_{self.name}_{self.version:04d}"


def train_models(matrix: DataFrame, labels: DataFrame, crops: DataFrame, names: tuple[str, ...] = ("random_forest",), version: int = 1) -> list[Fitted]:
    """M2: a model per crop of the calendar and name, learned from that crop's fields; ``crops``: (field_id, crop)."""
    rows = cut_lineage(matrix.join(crops.select("field_id", "crop"), "field_id"), "crop")
    found = []
    for crop in sorted({row[0] for row in K.CROP_CALENDAR}):
        own = rows.filter(F.col("crop") == crop).join(labels.select("field_id"), "field_id", "left_semi")
        if not own.isEmpty():
            found += [Fitted(crop, name, version, train(own, labels, name)) for name in names]
    return found


def chosen_model(registry: list[Fitted], crop: Column, name: Column) -> Column:
    """M2: label of the crop's last model whose name starts with the one asked for, else of its last model, else NULL."""
    ordered = sorted(registry, key=lambda m: m.label, reverse=True)
    asked = [F.when((crop == m.crop) & F.lit(m.name).startswith(F.trim(name)), F.lit(m.label)) for m in ordered]
    latest = [F.when(crop == m.crop, F.lit(m.label)) for m in ordered]
    return F.coalesce(*asked, *latest, F.lit(None).cast("string"))


def score_each(registry: list[Fitted], matrix: DataFrame, choice: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """M2: (field_id, year_month, prediction, model): every field by the model that ``choice`` (field_id, model) names.

    The rows are written once, in a folder per model, and each model reads its own; fields without a model have no row.
    """
    rows = align_features(matrix, features).join(choice.select("field_id", "model"), "field_id")
    rows = cut_lineage(rows, "model")
    parts = [m.model.transform(rows.filter(F.col("model") == m.label)).select("field_id", "year_month", "prediction", "model") for m in registry]
    return reduce(DataFrame.unionByName, parts)


def ensemble(predictions: DataFrame, fields: DataFrame) -> DataFrame:
    """One estimate per field from its monthly predictions, with interval and totals."""
    grouped = predictions.groupBy("field_id").agg(
        F.avg("prediction").alias("_mean"), F.stddev_pop("prediction").alias("_std"), F.count(F.lit(1)).alias("_n")
    )
    grouped = grouped.withColumn("_mean", F.greatest(F.lit(0.01), "_mean"))
    spread = F.when(F.col("_n") > 1, F.col("_std")).otherwise(F.col("_mean") * 0.15)
    grouped = grouped.withColumn("_margin", F.round(F.greatest(F.lit(0.1), spread), 2))
    estimate = grouped.select(
        "field_id",
        F.round("_mean", 2).alias("predicted_yield_t_ha"),
        F.round(F.greatest(F.lit(0.01), F.col("_mean") - F.col("_margin")), 2).alias("yield_min_expected"),
        F.round(F.col("_mean") + F.col("_margin"), 2).alias("yield_max_expected"),
    )
    area = F.col("field_area_ha")
    sized = fields.select("field_id", F.col("area_hectares").alias("field_area_ha"))
    return estimate.join(sized, "field_id").withColumns(
        {
            "total_expected_yield_tons": F.round(F.col("predicted_yield_t_ha") * area, 2),
            "total_yield_min_tons": F.round(F.col("yield_min_expected") * area, 2),
            "total_yield_max_tons": F.round(F.col("yield_max_expected") * area, 2),
        }
    )


def _described(factors: DataFrame) -> DataFrame:
    texts = F.create_map(*[F.lit(x) for pair in K.FEATURE_DESCRIPTIONS.items() for x in pair])
    return factors.withColumn("description", F.coalesce(F.try_element_at(texts, F.col("feature")), F.col("feature")))


def model_factors(model: PipelineModel, like: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """M3: the ten most important features of a trained model (122 numbers at most)."""
    importances = [float(x) for x in model.stages[-1].featureImportances.toArray()]
    rows = like.sparkSession.createDataFrame(list(zip(features, importances, strict=True)), "feature string, importance double")
    best = rows.orderBy(F.col("importance").desc(), "feature").limit(10)
    return _described(best.withColumn("importance", F.round("importance", 4)))


def factors_of_models(registry: list[Fitted], like: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """M3: (model, rank, feature, importance, description): the ten most important features of every model, by weight and name."""
    rows = []
    for m in registry:
        weights = [float(x) for x in m.model.stages[-1].featureImportances.toArray()]
        best = sorted(zip(weights, features, strict=True), key=lambda w: (-w[0], w[1]))[:10]
        rows += [(m.label, k, name, round(weight, 4)) for k, (weight, name) in enumerate(best, 1)]
    return _described(like.sparkSession.createDataFrame(rows, "model string, rank int, feature string, importance double"))


def spread_factors(matrix: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """M3 without importances: the ten columns that vary most per field, as shares of their sum."""
    spreads = align_features(matrix, features).groupBy("field_id").agg(*[F.stddev_samp(c).alias(c) for c in features])
    pairs = [x for c in features for x in (F.lit(c), F.col(c))]
    long = spreads.select("field_id", F.stack(F.lit(len(features)), *pairs).alias("feature", "spread"))
    # spreads that agree to nine digits count as equal and go by name
    order = Window.partitionBy("field_id").orderBy(F.round("spread", 9).desc_nulls_last(), "feature")
    # 122 candidates per field, ten kept
    top = long.withColumn("rank", F.row_number().over(order)).filter("rank <= 10")
    total = F.sum("spread").over(Window.partitionBy("field_id"))
    share = F.col("spread") / F.when(total > 0, total).otherwise(1.0)
    return _described(top.select("field_id", "rank", "feature", F.round(share, 4).alias("importance")))


def yield_records(estimates: DataFrame, factors: DataFrame, timeline: DataFrame, crops: DataFrame) -> DataFrame:
    """M4: one nested record per field with the model that made it; ten factors and at most twelve months per list."""
    listed = factors.groupBy("field_id").agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "importance", "description"))).alias("_f"))
    listed = listed.select("field_id", F.transform("_f", lambda f: f.dropFields("rank")).alias("top_features"))
    months = timeline.groupBy("field_id").agg(
        F.sort_array(F.collect_list(F.struct("month", *K.PHENOLOGY_DEFAULTS))).alias("phenology_timeline")
    )
    named = crops.select("field_id", "crop", "crop_display_name", F.col("model").alias("model_name"))
    return (
        estimates.join(named, "field_id").join(listed, "field_id", "left").join(months, "field_id", "left")
        .withColumn("created_at", F.current_timestamp())
    )
