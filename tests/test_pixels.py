import numpy as np
import pytest
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.functions import spectral as S
from verdant.operators import anomaly, components, quantiles, zonal
from verdant.operators.components import label_components
from verdant.session import by_key, cut_lineage

SCHEMA = "field_id long, acquisition_id long, row long, col long, " + ", ".join(f"{b} double" for b in K.BANDS) + ", scl int, data_mask boolean"


def grid(spark, cells):
    """cells: (row, col, seven bands[, scl])."""
    rows = [(1, 10, r, c, *map(float, bands), *(rest or (4,)), True) for r, c, bands, *rest in cells]
    return spark.createDataFrame(rows, SCHEMA)


def test_core_indices_of_known_bands(spark):
    bands = (0.1, 0.2, 0.3, 0.35, 0.6, 0.58, 0.4)
    row = zonal.core_index_pixels(grid(spark, [(0, 0, bands)])).first()
    assert row.NDMI == pytest.approx(0.2)
    assert row.NDVI == pytest.approx(1 / 3)
    assert row.EVI == pytest.approx(2.5 * 0.3 / (0.6 + 1.8 - 0.75 + 1))
    assert all(-1 <= row[n] <= 1 for n in K.CORE_INDICES)


def test_zero_denominator_is_null_and_extremes_are_clipped(spark):
    df = grid(spark, [(0, 0, (0, 0, 0, 0, 0, 0, 0)), (0, 1, (0, 0, -99, 0, 100, 0, 0))])
    first, second = zonal.core_index_pixels(df).orderBy("col").collect()
    assert first.NDVI is None and second.NDVI == 1.0


def test_invalid_pixels(spark):
    good = (0.1,) * 7
    df = grid(spark, [(0, 0, good), (0, 1, good, 9), (0, 2, (float("nan"), *good[1:])), (0, 3, (float("inf"), *good[1:]))])
    assert [r.v for r in df.orderBy("col").select(S.valid_pixel().alias("v")).collect()] == [True, False, False, False]


def test_all_cloudy_acquisition_has_null_statistics(spark):
    stats = zonal.zonal_statistics(grid(spark, [(0, 0, (0.1,) * 7, 9)])).collect()
    assert len(stats) == 5
    assert all(r.mean_value is None and r.median_value is None and r.valid_pixel_count == 0 for r in stats)
    dist = zonal.index_distribution(grid(spark, [(0, 0, (0.1,) * 7, 9)])).first()
    assert dist.mean_value == 0.0 and dist.std_value == 0.0


def test_healthy_grid(spark):
    cells = [(r, c, (0.05, 0.08, 0.06, 0.12, 0.45, 0.44, 0.15)) for r in range(5) for c in range(5)]
    rows = {r.index_name: r for r in zonal.index_distribution(grid(spark, cells)).collect()}
    assert rows["NDVI"].mean_value == pytest.approx(0.765, abs=1e-3)
    assert rows["NDWI"].mean_value == pytest.approx(0.492, abs=1e-3)
    assert rows["NDVI"].std_value == 0.0


def test_absent_bands_count_as_zero(spark):
    df = spark.createDataFrame([(0.2, 0.5)], "B04 double, B08 double")
    exprs = S.biophysical_indices(df.columns, F.lit(True))
    row = df.select(*[exprs[n].alias(n) for n in ("NDVI", "NDRE", "MSI")]).first()
    assert row.NDVI == pytest.approx(0.3 / 0.7) and row.NDRE == 1.0 and row.MSI == 0.0


@pytest.mark.parametrize("accuracy, wrong", [(10_000, None), (5, None), (10_000, (0.9, 0.95)), (10_000, (-5.0, -4.0)), (10_000, (0.0, 0.0))])
def test_exact_medians_with_ties_and_wrong_brackets(spark, accuracy, wrong, monkeypatch):
    """Whatever the sketch says, the second read sets its brackets right."""
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(accuracy)
    sizes = rng.integers(1, 300, 4)
    rows = [(k, float(v), float(rng.normal())) for k, n in enumerate(sizes) for v in rng.choice([-2.0, -0.5, 0.0, 0.25, 0.26, 3.0], n)]
    rows += [(9, None, 1.0), (None, 2.0, None), (None, 4.0, None)]
    df = spark.createDataFrame(rows, "k long, v double, w double").withColumn("k", F.coalesce("k", F.lit(-1)))
    if wrong:
        monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a: F.when(F.count(a[0]) > 0, F.array(*map(F.lit, wrong))))
    got = {(r.k, r.index_name): r for r in quantiles.summaries(df, ["k"], ["v", "w"]).collect()}
    assert len(got) == 12
    for (k, name), r in got.items():
        values = [row[1 if name == "v" else 2] for row in rows if (-1 if row[0] is None else row[0]) == k]
        values = [v for v in values if v is not None]
        assert r.size == len(values)
        if values:
            assert [r.median, r.mean, r.minimum, r.maximum, r.std] == pytest.approx([np.median(values), np.mean(values), min(values), max(values), np.std(values)])
        else:
            assert r.median is None and r.mean is None


@pytest.mark.parametrize("whole, wrong", [(0, None), (0, (0.9, 0.95)), (0, (-5.0, -4.0)), (150, (0.0, 0.0)), (10_000, None)])
def test_small_groups_are_sorted_whole_and_large_ones_bracketed(spark, whole, wrong, monkeypatch):
    """Both ways agree, also where a group goes over several batches and where a column or a key has NULLs."""
    monkeypatch.setattr(quantiles, "WHOLE", whole)
    rng = np.random.default_rng(whole)
    rows = [(k // 3, f"g{k % 3}", None if v > 1.5 else float(v), None if k == 4 else float(w)) for k, n in enumerate(rng.integers(1, 400, 9)) for v, w in zip(rng.normal(size=n), rng.integers(0, 4, n))]
    df = spark.createDataFrame(rows, "k long, g string, v double, w double").repartition(7)
    sorts, plain = [], quantiles.sorted_summaries
    monkeypatch.setattr(quantiles, "sorted_summaries", lambda wide, *a: sorts.append(wide) or plain(wide, *a))
    if wrong:
        monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a: F.when(F.count(a[0]) > 0, F.array(*map(F.lit, wrong))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = {(r.k, r.g, r.index_name): r for r in quantiles.summaries(df, ["k", "g"], ["v", "w"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 18
    for (k, g, name), r in got.items():
        values = [v for row in rows if row[:2] == (k, g) and (v := row["vw".index(name) + 2]) is not None]
        assert r.size == len(values)
        if values:
            assert [r.median, r.mean, r.minimum, r.maximum, r.std] == pytest.approx([np.median(values), np.mean(values), min(values), max(values), np.std(values)])
        else:
            assert [r.median, r.mean, r.minimum, r.maximum, r.std] == [None] * 5
    largest = sorts[0].groupBy("k", "g").count().agg(F.max("count")).first()[0] or 0
    assert largest <= whole and (whole == 0 or largest > 0)


def test_small_groups_make_no_sketch(spark):
    """Many small acquisitions are summarised in one exchange of their rows; no digest is kept per group and column."""
    plan = quantiles.summaries(spark.range(1000).selectExpr("id div 4 AS k", "id / 7 AS v"), ["k"], ["v"])._jdf.queryExecution().toString()
    assert "percentile_approx" not in plan and "Join" not in plan


def test_indices_are_compiled_in_parts(spark):
    """The projection of the eleven indices stands outside compiled stages, in which its code is too large for the JVM's compiler."""
    plan = zonal.index_distribution(grid(spark, [(0, 0, (0.1,) * 7, 9)]))._jdf.queryExecution().sparkPlan().toString()
    assert "forall" in plan
    compiled = zonal.biophysical_pixels(grid(spark, [(0, 0, (0.1,) * 7, 4)]))._jdf.queryExecution().executedPlan().toString()
    (line,) = [part for part in compiled.splitlines() if "AS NDSI" in part]
    assert "*(" not in line


def test_few_values_lie_inside_the_brackets(spark):
    wide = spark.range(40_000).selectExpr("id % 2 AS k", *[f"(id * {m} % 39989) / 39989.0D AS {n}" for n, m in (("a", 7), ("b", 31), ("c", 1009))])
    known = quantiles.proven(wide, quantiles.sketches(wide, ["k"], ["a", "b", "c"]), ["k"], ["a", "b", "c"])
    ends = known.select("k", *[F.col(f"_{n}.bracket.{e}").alias(f"{e}_{n}") for n in "abc" for e in ("low", "high")])
    inside = wide.join(ends, "k").agg(*[F.count_if(F.col(n).between(F.col(f"low_{n}"), F.col(f"high_{n}"))) for n in "abc"]).first()
    assert 0 < max(inside) < 40_000 / 500
    plan = quantiles.sketches(wide, ["k"], ["a"])._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Expand" not in plan


def brute_components(points):
    left, groups = set(points), []
    for p in sorted(points):
        if p not in left:
            continue
        left.discard(p)
        stack, group = [p], []
        while stack:
            r, c = stack.pop()
            group.append((r, c))
            for q in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if q in left:
                    left.discard(q)
                    stack.append(q)
        groups.append(group)
    return {p: i for i, g in enumerate(groups, 1) for p in g}


def test_tiles_are_labelled_many_at_once(spark):
    """One call of Python per batch of rows, not per tile; a tile may lie in two batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(5)
        points = {k: [(int(r), int(c)) for r, c in np.argwhere(rng.random((13, 17)) < 0.45)] for k in range(3)}
        df = spark.createDataFrame([(k, *p) for k, own in points.items() for p in own], "k long, row long, col long")
        local = components._tile_labels(df, ["k"], 4)
        assert "FlatMapGroupsInPandas" not in local._jdf.queryExecution().toString()
        got = {(r.k, r.row, r.col): r.cluster_id for r in label_components(df, ["k"], 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == {(k, *p) for k, own in points.items() for p in own}
    for k, own in points.items():
        want = brute_components(own)
        pairs = {(got[k, *p], want[p]) for p in own}
        assert len(pairs) == len({a for a, _ in pairs}) == len(set(want.values()))


@pytest.mark.parametrize("tile", [3, 4, 128])
def test_components_equal_brute_force(spark, tile):
    rng = np.random.default_rng(tile)
    rows, want = [], {}
    for key, share in ((1, 0.35), (2, 0.55), (3, 0.2)):
        points = [(int(r), int(c)) for r, c in np.argwhere(rng.random((13, 17)) < share)]
        rows += [(key, r, c) for r, c in points]
        want |= {(key, *p): i for p, i in brute_components(points).items()}
    # a snake through all tiles is one component
    snake = [(r, c) for r in range(0, 13, 2) for c in range(17)] + [(r, 16 if r % 4 == 1 else 0) for r in range(1, 13, 2)]
    rows += [(4, r, c) for r, c in snake]
    want |= {(4, r, c): 1 for r, c in snake}
    df = spark.createDataFrame(rows, "k long, row long, col long")
    got = {(r.k, r.row, r.col): r.cluster_id for r in label_components(df, ["k"], tile).collect()}
    assert got == want


def test_anisotropy_of_line_and_disc(spark):
    line = [(1, 10, 1, i, 5) for i in range(12)]
    disc = [(1, 10, 2, i, j) for i in range(20, 26) for j in range(20, 26)]
    df = spark.createDataFrame(line + disc, "field_id long, acquisition_id long, cluster_id long, row long, col long")
    for name in K.BIOPHYSICAL_INDICES:
        df = df.withColumn(name, F.lit(0.5))
    rows = {r.cluster_id: r for r in anomaly.cluster_aggregates(df).collect()}
    assert rows[1].orientation_type == "linear_furrow" and rows[1].e_anisotropy > 3
    assert rows[2].orientation_type == "concentric_radial"
    assert rows[2].area_m2 == 3600.0 and rows[2].area_ha == 0.36


def test_diagnosis_order(spark):
    means = {n: 0.5 for n in anomaly.MEANS.values()}
    cases = [
        ({"mean_ndsi": 0.4, "mean_savi": 0.2}, False, "SALINITY_OSMOTIC_STRESS"),
        ({"mean_ndre": 0.4, "mean_bri": 1.3, "mean_ndwi": 0.4, "mean_ndsi": 0.0}, False, "EARLY_FUNGAL_INFECTION"),
        ({"mean_ndwi": 0.2, "mean_ndre": 0.3, "mean_ndsi": 0.0}, True, "XYLEM_BLOCKADE_ADVANCED_PATHOGEN"),
        ({"mean_ndwi": 0.2, "mean_ndre": 0.3, "mean_ndsi": 0.0}, False, "HYDRO_STRESS_IRRIGATION_DEFICIT"),
        ({"mean_ndre": 0.3, "mean_ndwi": 0.35, "mean_ndsi": 0.0, "mean_bri": 1.0}, False, "NUTRIENT_NITROGEN_DEFICIENCY"),
        ({"mean_ndvi": 0.4, "mean_ndsi": 0.0}, False, "MODERATE_VEGETATION_DECLINE"),
        ({"mean_ndsi": 0.0}, False, "LOCAL_DEVIATION"),
    ]
    rows = [tuple({**means, **c}.values()) + (flag, want) for c, flag, want in cases]
    df = spark.createDataFrame(rows, [*means, "flag", "want"])
    for row in df.withColumn("got", anomaly.diagnosis_code(F.col("flag"))).collect():
        assert row.got == row.want


def test_hotspot_grid_report(spark):
    healthy, salty = (0.05, 0.08, 0.06, 0.12, 0.45, 0.44, 0.15), (0.2, 0.5, 0.3, 0.3, 0.32, 0.32, 0.2)
    cells = []
    for r in range(30):
        for c in range(30):
            hot = (22 <= r < 27 and 22 <= c < 27) or (r, c) == (3, 3)
            cells.append((r, c, salty if hot else healthy))
    fields = spark.createDataFrame([(1, "Paxta")], "field_id long, crop_name string")
    flag = spark.createDataFrame([], "field_id long, ndre_before_ndwi boolean")
    report = anomaly.anomaly_report(grid(spark, cells), fields, flag, tile=8).first()
    assert report.total_anomalous_pixels == 26 and report.cluster_count == 1
    top = report.top_clusters[0]
    assert (top.pixel_count, top.compass_sector, top.risk_level) == (25, "Janubi-sharqiy", "CRITICAL")
    assert report.overall_health_verdict == "Paxta" + K.VERDICTS["stable"]  # below five percent


def test_compass_sectors(spark):
    where = {(0, 10): "Shimoliy", (10, 20): "Sharqiy", (20, 10): "Janubiy", (10, 0): "G'arbiy", (0, 20): "Shimoli-sharqiy", (10, 11): "Markaziy"}
    df = spark.createDataFrame([(float(r), float(c), want) for (r, c), want in where.items()], "r double, c double, want string")
    got = df.withColumn("got", S.compass_sector(F.col("r"), F.col("c"), F.lit(10.0), F.lit(10.0))).collect()
    assert all(row.got == row.want for row in got)


@pytest.mark.parametrize("links", [[], [(i + 1, i) for i in range(70)], [(i, 0) for i in range(1, 90)], [(9, 4), (4, 9), (7, 4), (20, 19)]])
def test_smallest_in_component(spark, links):
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(max(x), min(x)) for x in links], "a long, b long")
    assert {r.a: r.b for r in components.smallest_in_component(df, []).collect()} == {i: root(i) for i in parent if root(i) != i}


def test_what_grows_with_the_groups_is_not_sent_to_all_tasks(spark, monkeypatch):
    """Exploded brackets and edge pixels, links, ranks and whole rows of brackets go by key; few brackets are sent."""
    sketchy, links = spark.range(4000).selectExpr("id div 400 AS k", "id / 7 AS v"), [(3, 1), (2, 1), (5, 4)]
    plan_of = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    plans = []
    monkeypatch.setattr(quantiles, "cut_lineage", lambda df: plans.append(plan_of(df)) or cut_lineage(df))
    known = quantiles.proven(sketchy, quantiles.sketches(sketchy, ["k"], ["v"]), ["k"], ["v"])
    proving, middle = plans[-1], plan_of(quantiles.medians(sketchy, known, ["k"], ["v"]))
    assert proving.count("BroadcastHashJoin") == 1 and "SortMergeJoin" in proving
    assert middle.count("BroadcastHashJoin") == 1 and "SortMergeJoin [k" in middle
    monkeypatch.setattr(quantiles, "SENT", 9)  # ten groups
    assert "BroadcastHashJoin" not in plan_of(quantiles.medians(sketchy, known, ["k"], ["v"]))
    local = cut_lineage(spark.range(64).selectExpr("1 AS k", "id div 8 AS row", "id % 8 AS col", "0L AS label"))
    assert "BroadcastHashJoin" not in plan_of(components._edge_links(local, ["k"], 4))
    stars = by_key(cut_lineage(spark.createDataFrame(links, "a long, b long")))
    assert "BroadcastHashJoin" not in plan_of(components._star(stars, [], large=True))
    ranked = quantiles.ordered_rank(cut_lineage(spark.range(9).selectExpr("1 AS k", "id AS o")), ["k"], "o", "n", F.expr("o div 3"))
    assert "BroadcastHashJoin" not in plan_of(ranked) and sorted((r.o, r.n) for r in ranked.collect()) == [(i, i + 1) for i in range(9)]
