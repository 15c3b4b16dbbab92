import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.functions import geo, keys
from verdant.operators import features as fx
from verdant.operators import fields, store, validation
from verdant.operators import yields as yx
from verdant.sources import weather as wx
from verdant.streaming import jobs

SQUARE = [[69.20, 41.20], [69.21, 41.20], [69.21, 41.21], [69.20, 41.21], [69.20, 41.20]]


def geojson(*rings, kind="Polygon"):
    return json.dumps({"type": kind, "coordinates": list(rings)})


def checked(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "request_id long, geometry_json string")
    return fields.check_geometry(df)


def test_polygon_errors(spark):
    bow = [[0, 0], [2, 2], [2, 0], [0, 1], [0, 0]]
    spike = [[0, 0], [2, 0], [4, 0], [2, 0], [2, 2], [0, 0]]
    texts = [
        geojson(SQUARE), geojson([1, 2], kind="Point"), geojson(SQUARE[:-1]), geojson([[181, 0], *SQUARE[1:4], [181, 0]]),
        geojson([[0, 91], *SQUARE[1:4], [0, 91]]), geojson(bow), geojson(spike), geojson(), geojson([[0, 0, 1], *SQUARE[1:4], [0, 0, 1]]),
        geojson([[True, 0], *SQUARE[1:4], [True, 0]]), geojson([[0, 0], [1, 1], [2, 2], [0, 0]]), "{",
    ]
    want = [None, "type", "closed", "longitude", "latitude", "crossing", "crossing", "empty", "position", "number", "area", "type"]
    got = [r.error for r in checked(spark, *texts).orderBy("request_id").collect()]
    assert got == want


def test_a_geometry_is_read_and_checked_once(spark):
    rows = checked(spark, geojson(SQUARE), geojson(SQUARE[:-1])).filter("valid")
    used = rows.select(geo.area_hectares(F.col("rings")).alias("a"), geo.bounding_box(F.col("rings")).alias("b"))
    assert used._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [r.b for r in used.collect()] == [[69.2, 41.2, 69.21, 41.21]]


def test_area_of_the_known_square(spark):
    row = checked(spark, geojson(SQUARE)).select(geo.area_hectares(F.col("rings")).alias("a")).first()
    assert row.a == pytest.approx(93.149, abs=0.01)


def test_holes_are_subtracted(spark):
    hole = [[69.202, 41.202], [69.208, 41.202], [69.208, 41.208], [69.202, 41.208], [69.202, 41.202]]
    whole, holed = [r.a for r in checked(spark, geojson(SQUARE), geojson(SQUARE, hole)).orderBy("request_id").select(geo.area_hectares(F.col("rings")).alias("a")).collect()]
    assert holed == pytest.approx(whole * 0.64, rel=1e-3)


def test_holes_that_cut_the_interior_together(spark):
    outside = [[0, 0], [12, 0], [12, 12], [0, 12], [0, 0]]
    box = lambda a, b, c, d: [[a, b], [c, b], [c, d], [a, d], [a, b]]
    left, right = [[0, 6], [4, 5], [4, 7], [0, 6]], [[12, 6], [8, 7], [8, 5], [12, 6]]
    chain = [box(4, 4, 5, 5), box(5, 5, 6, 6), box(6, 6, 7, 7)]
    fan = [[[6, 6], [9, 5], [9, 7], [6, 6]], [[6, 6], [3, 5], [3, 7], [6, 6]], [[6, 6], [5, 9], [7, 9], [6, 6]]]
    bridge = [[4, 5], [8, 5], [6, 4], [4, 5]]  # from the left hole's corner to the right hole's
    cases = [[left], [left, right], chain, fan, [left, right, bridge], [*fan, [[9, 7], [7, 9], [8, 10], [9, 7]]], [box(1, 1, 2, 2), *chain, [[7, 7], [11, 7], [11, 1], [5, 1], [5, 4], [10, 4], [10, 6], [7, 7]]]]
    want = [None, None, None, None, "hole", "hole", "hole"]
    got = [r.error for r in checked(spark, *[geojson(outside, *c) for c in cases]).orderBy("request_id").collect()]
    assert got == want


def test_hash_ignores_start_and_direction(spark):
    turned = SQUARE[2:4] + SQUARE[:2] + [SQUARE[2]]
    rows = fields.with_geometry(checked(spark, geojson(SQUARE), geojson(turned), geojson(SQUARE[::-1]))).collect()
    assert len({r.geometry_hash for r in rows}) == 1
    assert rows[0].geometry[0][0] == [69.2, 41.2] and rows[0].geometry[0][1] == [69.21, 41.2]


def test_registration_outputs(spark):
    rows = [(1, geojson(SQUARE), "Paxta"), (2, geojson(SQUARE[::-1]), "Paxta"), (3, geojson(SQUARE[:-1]), "Paxta"), (4, geojson([[p[0] + 1, p[1]] for p in SQUARE]), " ")]
    df = spark.createDataFrame(rows, "request_id long, geometry_json string, crop_name string")
    df = df.withColumn("planted_on", F.lit("2026-04-01").cast("date")).withColumn("growth_stage", F.lit("x"))
    out = fields.register_fields(df, spark.createDataFrame([], "geometry_hash string"), F.current_timestamp())
    assert [r.request_id for r in out["accepted"].collect()] == [1]
    assert [r.request_id for r in out["duplicates"].collect()] == [2]
    assert {r.request_id: r.reason for r in out["rejected"].collect()} == {3: K.POLYGON_ERRORS["closed"], 4: "crop_name"}
    assert len(out["accepted"].first().public_id) == 8


def test_utc_text(spark):
    df = spark.createDataFrame([(datetime.datetime(2026, 4, 1, 10, 0, 59, 5),)], "t timestamp")
    start, end = keys.observation_window(F.col("t"))
    assert tuple(df.select(start, end).first()) == ("2026-04-01T10:00:59.000005Z", "2026-04-01T10:01:00.000005Z")


def acquisitions(spark, days):
    rows = [(1, i, datetime.datetime(2026, 4, d), "p", f"r{i}") for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "field_id long, acquisition_id long, acquired_at timestamp, product_id string, revision_key string")


def test_newest_five_and_insert_if_new(spark):
    acq = acquisitions(spark, [1, 2, 3, 4, 5, 6])
    assert sorted(r.acquisition_id for r in store.newest_acquisitions(acq).collect()) == [1, 2, 3, 4, 5]
    created = store.insert_if_new(acq, acq.filter("acquisition_id < 4")).filter("created").collect()
    assert sorted(r.acquisition_id for r in created) == [4, 5]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k long, v string, at int")
    once = store.latest_wins(old, new, ["k"], "at")
    twice = store.latest_wins(once, new, ["k"], "at")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]


def test_duplicate_and_missing_keys(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    assert [tuple(r) for r in validation.duplicate_keys(child.filter("k is not null"), ["k"]).collect()] == [(1, 2)]
    assert [tuple(r) for r in validation.missing_parents(child, "k", spark.createDataFrame([(1,)], "k long")).collect()] == [(2, 1)]
    hot = spark.createDataFrame([(1,)] * 50, "k long")
    plan = validation.missing_parents(child, "k", hot)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan  # parents of one value are combined before they meet


def test_climatology_ranges(spark):
    req = spark.createDataFrame([(1, 41.1555, datetime.date(2026, 4, 1), datetime.date(2026, 9, 30))], "field_id long, latitude double, start_date date, end_date date")
    rows = wx.climatology(req).collect()
    assert len(rows) == 183
    for r in rows:
        assert 10 <= r.weather_temperature_2m <= 45 and r.weather_shortwave_radiation >= 10 and r.weather_evapotranspiration_et0 >= 1


def test_column_payload_tolerates_missing_columns(spark):
    body = json.dumps({"daily": {"time": ["2026-04-01", "2026-04-02"], "temperature_2m_mean": [20.0]}})
    rows = wx.column_payload(spark.createDataFrame([(1, body), (2, "{}")], "k long, body string")).orderBy("date").collect()
    assert [r.weather_temperature_2m for r in rows] == [20.0, None] and rows[0].weather_rain is None


def test_parameter_payload_defaults(spark):
    body = json.dumps({"properties": {"parameter": {"T2M": {"20260402": 20.0, "20260401": 21.0}, "PRECTOTCORR": {"20260401": -3.0}}}})
    row = wx.parameter_payload(spark.createDataFrame([(1, body)], "k long, body string")).orderBy("date").first()
    assert row.weather_total_precipitation == 0.0 and row.weather_wind_speed_10m == 10.0
    assert row.weather_evapotranspiration_et0 == round(0.0023 * 38.8 * math.sqrt(10) * 20 * 0.408, 2)


def test_gap_fill(spark):
    rows = [(1, f"2026-{m:02d}", v) for m, v in enumerate([None, 2.0, None, None, 8.0, None], 1)] + [(2, "2026-01", None)]
    df = fx.fill_gaps(spark.createDataFrame(rows, "field_id long, year_month string, x double"), ["x"])
    got = [r.x for r in df.orderBy("field_id", "year_month").collect()]
    assert got == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0, 0.0]


def test_crops(spark):
    names = ["Paxta", "G'o'za", "Bug'doy", "Kuzgi bug‘doy", "Sholi"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(fx.normalised_crop(F.col("n")).alias("c"))
    assert [r.c for r in df.collect()] == ["cotton", "cotton", "wheat", "wheat", "cotton"]


def test_feature_count_and_year_filter(spark):
    start, end = datetime.date(2026, 4, 1), datetime.date(2026, 10, 31)
    field = spark.createDataFrame([(1, "Paxta", 41.0, 69.0)], "field_id long, crop_name string, latitude double, longitude double")
    planned = fx.with_calendar(field)
    weather = wx.climatology(spark.createDataFrame([(1, 41.0, start, end)], "field_id long, latitude double, start_date date, end_date date"))
    weather = fx.with_crop_time(weather.join(planned.select("field_id", "longitude", "planting_date", "harvest_date"), "field_id"))
    optical = fx.baseline_spine(planned, None, 10, K.OPTICAL_BASELINE)
    radar = fx.baseline_spine(planned, None, 12, K.RADAR_BASELINE)
    matrix = fx.monthly_features(weather, optical, radar, 2026)
    assert len(fx.FEATURES) == 122 and set(fx.FEATURES) <= set(matrix.columns)
    rows = matrix.collect()
    assert len(rows) == 7 and all(r[c] is not None for r in rows for c in fx.FEATURES)
    timeline = fx.phenology(fx.with_optical_indices(optical), fx.with_radar_ratio(radar), weather, planned)
    assert sorted(r.month for r in timeline.collect()) == [4, 5, 6, 7, 8, 9, 10]


def test_ensemble_interval_holds_the_mean(spark):
    preds = spark.createDataFrame([(1, 3.0), (1, 4.0), (2, 0.0)], "field_id long, prediction double")
    area = spark.createDataFrame([(1, 10.0), (2, 1.0)], "field_id long, area_hectares double")
    rows = {r.field_id: r for r in yx.ensemble(preds, area).collect()}
    assert (rows[1].predicted_yield_t_ha, rows[1].yield_min_expected, rows[1].yield_max_expected) == (3.5, 3.0, 4.0)
    assert rows[1].total_expected_yield_tons == 35.0
    assert (rows[2].predicted_yield_t_ha, rows[2].yield_min_expected) == (0.01, 0.01)


def test_streamed_ingest_equals_batch(spark, tmp_path):
    acq = acquisitions(spark, [1, 2, 3, 4]).withColumn("revision_key", F.col("acquisition_id").cast("string"))
    twice = acq.unionByName(acq.withColumn("acquisition_id", F.col("acquisition_id") + 10).withColumn("acquired_at", F.expr("acquired_at + interval 9 days")))
    twice.repartitionByRange(3, "acquired_at").write.parquet(str(tmp_path / "in"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), twice.schema)
    out = jobs.ingest_acquisitions(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(r.revision_key for r in out.collect()) == ["0", "1", "2", "3"]


def test_choice_of_models(spark):
    made = lambda crop, name, version: yx.Fitted(crop, name, version, None)
    registry = [made("cotton", "forest", 1), made("cotton", "boosting", 3), made("cotton", "forest", 12), made("wheat", "boosting", 1)]
    rows = [("cotton", "forest"), ("cotton", " for "), ("cotton", "boosting"), ("cotton", "other"), ("cotton", None), ("wheat", "forest"), ("barley", "forest"), (None, "forest")]
    df = spark.createDataFrame(rows, "crop string, asked string")
    got = [r.m for r in df.select(yx.chosen_model(registry, F.col("crop"), F.col("asked")).alias("m")).collect()]
    assert got == ["cotton_forest_0012"] * 2 + ["cotton_boosting_0003"] + ["cotton_forest_0012"] * 2 + ["wheat_boosting_0001", None, None]


def test_fields_are_scored_by_their_crop(spark):
    matrix = spark.createDataFrame([(f, f"2026-{m:02}", float(f % 3), float(m)) for f in range(12) for m in (5, 6, 7)], "field_id long, year_month string, a double, b double")
    crops = spark.createDataFrame([(f, "wheat" if f % 2 else "cotton") for f in range(12)], "field_id long, crop string")
    labels = crops.selectExpr("field_id", "IF(crop = 'wheat', 100D, 0D) + field_id / 10 AS yield_t_ha").filter("field_id < 10")
    whole = yx.train
    yx.train = lambda m, lab, kind, features=("a", "b"), seed=7: whole(m, lab, kind, list(features), seed)
    try:
        registry = yx.train_models(matrix, labels, crops, ("random_forest", "gradient_boosting"))
    finally:
        yx.train = whole
    assert [m.label for m in registry] == [f"{c}_{n}_0001" for c in ("cotton", "wheat") for n in ("random_forest", "gradient_boosting")]
    choice = crops.select("field_id", yx.chosen_model(registry, F.col("crop"), F.when(F.col("field_id") > 5, "grad")).alias("model")).union(spark.createDataFrame([(99, None)], "field_id long, model string"))
    rows = yx.score_each(registry, matrix, choice, ["a", "b"]).collect()
    assert len(rows) == 36
    for r in rows:
        assert r.model.startswith("wheat" if r.field_id % 2 else "cotton") and (r.prediction > 50) == bool(r.field_id % 2)
        assert ("gradient" in r.model) == (r.field_id > 5)


def test_gaps_of_many_fields_in_one_exchange(spark):
    """Gaps inside, before and behind, whole columns empty, fields of one month; other columns pass; rows are exchanged once, side by side."""
    import numpy as np

    rng = np.random.default_rng(4)
    rows = []
    for field in range(40):
        for month in range(1, 1 + int(rng.integers(1, 13))):
            rows.append((field, f"2024-{month:02}", f"r{field}", *[float(x) if rng.random() < 0.4 and field % 5 else None for x in rng.normal(size=3)]))
    merged = spark.createDataFrame(rows[::-1], "field_id long, year_month string, w string, a double, b double, c double")
    filled = fx.fill_gaps(merged, ["a", "b", "c"])
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
    got = {(r.field_id, r.year_month): (r.w, r.a, r.b, r.c) for r in filled.collect()}
    assert len(got) == len(rows)
    for field in range(40):
        own = [r for r in rows if r[0] == field]
        for k in range(3):
            at = [i for i, r in enumerate(own) if r[3 + k] is not None]
            want = np.interp(range(len(own)), at, [own[i][3 + k] for i in at]) if at else [0.0] * len(own)
            assert [got[r[0], r[1]][1 + k] for r in own] == pytest.approx(list(want)) and all(got[r[0], r[1]][0] == r[2] for r in own)
