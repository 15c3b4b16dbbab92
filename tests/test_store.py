import pytest
from pyspark.sql import functions as F

from verdant.operators import store
from verdant.sources import versions
from verdant.session import cut_lineage

SCHEMA = "k long, v long"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_a_batch_rewrites_its_buckets_only_and_once(spark, tmp_path):
    folder = str(tmp_path / "t")
    merge = lambda stored, new: store.latest_wins(stored, new, ["k"], "v")
    apply = lambda name, rows: versions.change(spark.createDataFrame(rows, SCHEMA), folder, SCHEMA, "k", name, merge, 8)
    assert rows_of(versions.read(spark, folder, SCHEMA)) == []
    first = apply("a", [(i, 0) for i in range(40)])
    before = versions.manifest(spark, folder)[1]
    second = apply("b", [(3, 5), (3, 7), (100, 1)])
    after = versions.manifest(spark, folder)[1]
    assert len(first) == 8 and 1 <= len(second) <= 2
    assert {b for b in after if after[b] != before.get(b)} == set(second)
    want = sorted([(i, 7 if i == 3 else 0) for i in range(40)] + [(100, 1)])
    assert rows_of(versions.read(spark, folder, SCHEMA)) == want
    assert apply("b", [(3, 9)]) == [] and apply("a", [(3, 9)]) == [] and apply("c", []) == []
    assert rows_of(versions.read(spark, folder, SCHEMA)) == want


def test_a_failed_batch_shows_nothing_and_is_repeated(spark, tmp_path):
    folder = str(tmp_path / "t")
    merge = lambda stored, new: stored.unionByName(new)
    bad = lambda stored, new: stored.unionByName(new.withColumn("v", F.raise_error(F.lit("lost")).cast("long")))
    rows = spark.createDataFrame([(1, 1), (2, 2)], SCHEMA)
    versions.change(rows, folder, SCHEMA, "k", "a", merge)
    with pytest.raises(Exception, match="lost"):
        versions.change(rows, folder, SCHEMA, "k", "b", bad)
    (tmp_path / "t" / "manifest" / "00000007").mkdir()  # a manifest that was begun
    assert rows_of(versions.read(spark, folder, SCHEMA)) == [(1, 1), (2, 2)]
    versions.change(rows, folder, SCHEMA, "k", "b", merge)
    assert rows_of(versions.read(spark, folder, SCHEMA)) == [(1, 1), (1, 1), (2, 2), (2, 2)]


def test_rows_may_go_and_insert_if_new(spark, tmp_path):
    folder = str(tmp_path / "t")
    new_only = lambda stored, new: stored.unionByName(new.join(stored, "k", "left_anti"))
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    versions.change(make([(1, 1), (2, 2)]), folder, SCHEMA, "k", "a", new_only)
    versions.change(make([(2, 9), (3, 3)]), folder, SCHEMA, "k", "b", new_only)
    assert rows_of(versions.read(spark, folder, SCHEMA)) == [(1, 1), (2, 2), (3, 3)]
    versions.change(make([(1, 0)]), folder, SCHEMA, "k", "c", lambda stored, new: stored.join(new, "k", "left_anti"))
    assert rows_of(versions.read(spark, folder, SCHEMA)) == [(2, 2), (3, 3)]
    place = store.listed(make([(5, 1), (6, 3), (7, None), (8, 3)]).select("k", F.col("v").alias("created_at")), "k", page=2).collect()
    assert sorted((r.place, r.k, r.page) for r in place) == [(1, 6, 1), (2, 8, 1), (3, 5, 2), (4, 7, 2)]


def test_many_rows_in_small_files_are_not_sent_to_all_tasks(spark):
    """Spark knows a stored table by its files: 200,000 rows of small files are megabytes in a hash relation."""
    plans = []
    for n in (1000, 200_000):
        stored = cut_lineage(spark.range(n).selectExpr("id", "id div 1000 AS k"))
        assert stored.count() == n and stored.join(spark.range(10), "id").count() == 10
        plans.append(spark.range(1 << 40).join(stored.select("id"), "id")._jdf.queryExecution().sparkPlan().toString())
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]
