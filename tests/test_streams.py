"""Streams against their batch forms: repeats, late rows, many small batches, restarts."""

import datetime as dt
import random
from pathlib import Path

from pyspark.sql import functions as F

from verdant import constants as K
from verdant.operators.zonal import zonal_statistics
from verdant.queries import standins as st
from verdant.sources import versions
from verdant.streaming import jobs

MESSAGES = "conv_id long, message_id long, created_at timestamp"


def land(spark, folder, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{number:03d}")


def files(spark, folder, schema):
    return jobs.read_files(spark, f"{folder}/*", spark.createDataFrame([], schema).schema)


def test_counts_with_repeated_and_late_messages(spark, tmp_path):
    base, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    at = lambda day: dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
    land(spark, base, 0, [(1, 1, at(500)), (1, 2, at(501)), (1, 2, at(501)), (2, 1, at(502))], MESSAGES)
    land(spark, base, 1, [(1, 2, at(501)), (3, 9, at(0)), (2, 0, at(1))], MESSAGES)
    counts = lambda: sorted(map(tuple, jobs.running_counts(files(spark, base, MESSAGES), out, check).collect()))
    want = [(1, 2, 2), (2, 2, 1), (3, 1, 9)]
    assert counts() == want
    assert counts() == want  # started again without news
    land(spark, base, 2, [(3, 9, at(0)), (3, 10, at(2))], MESSAGES)
    assert counts() == [(1, 2, 2), (2, 2, 1), (3, 2, 10)]


def test_old_states_are_deleted(spark, tmp_path):
    base, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(5):
        land(spark, base, n, [(c, n, dt.datetime(2024, 1, 1)) for c in range(20)], MESSAGES)
    rows = jobs.running_counts(files(spark, base, MESSAGES), out, str(tmp_path / "check"))
    assert sorted(map(tuple, rows.collect())) == [(c, 5, 4) for c in range(20)]
    buckets = len(versions.manifest(spark, out)[1])
    assert len(list(Path(out).glob("data/*/bucket=*"))) <= 2 * buckets
    assert len(list(Path(out).glob("manifest/0*"))) == 2
    assert versions.tidy(spark, out, 1) == buckets == len(list(Path(out).glob("data/*/bucket=*")))
    assert versions.read(spark, out, jobs.COUNTS).count() == 20
    assert versions.tidy(spark, str(tmp_path / "none")) == 0


def test_statistics_of_many_small_batches(spark, tmp_path):
    chance = random.Random(5)
    fields = st.pixels(spark, "/root/testdata/sf0.001")
    rows = [r for r in fields.limit(3000).collect()]
    chance.shuffle(rows)
    base, schema = str(tmp_path / "in"), fields.schema
    for n in range(6):
        land(spark, base, n, rows[n::6], schema)
    stream = jobs.read_files(spark, f"{base}/*", schema)
    got = jobs.upsert_statistics(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    want = zonal_statistics(spark.createDataFrame(rows, schema))
    exact = lambda df: sorted((r.field_id, r.acquisition_id, r.index_name, r.min_value or 0, r.median_value or 0, r.max_value or 0, r.valid_pixel_count, round(r.mean_value or 0, 9)) for r in df.collect())
    assert exact(got) == exact(want)


def test_statistics_of_no_pixel_and_of_masked_ones(spark, tmp_path):
    schema = st.pixels(spark, "/root/testdata/sf0.001").schema
    (tmp_path / "in" / "000").mkdir(parents=True)
    stream = jobs.read_files(spark, f"{tmp_path}/in/*", schema)
    assert jobs.upsert_statistics(stream, str(tmp_path / "out"), str(tmp_path / "check")).collect() == []
    one = tuple({"field_id": 1, "acquisition_id": 2, "row": 0, "col": 0, "scl": 9}.get(f.name, False if f.dataType.simpleString() == "boolean" else None) for f in schema.fields)
    land(spark, str(tmp_path / "in"), 1, [one], schema)
    rows = jobs.upsert_statistics(jobs.read_files(spark, f"{tmp_path}/in/*", schema), str(tmp_path / "out"), str(tmp_path / "check")).collect()
    assert len(rows) == 5 and all(r.valid_pixel_count == 0 and r.median_value is None and r.mean_value is None for r in rows)


def test_slots_are_counted_after_the_exchange(spark):
    """A task that reads a large file does not hold the slots of all its pixels."""
    schema = "field_id long, acquisition_id long, " + ", ".join(f"{n} double" for n in K.CORE_INDICES)
    values = spark.createDataFrame([(1, i % 7, *[i / 1000] * 5) for i in range(500)], schema)
    slots = jobs._slots(values)
    plan = slots._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("HashAggregate") < plan.index("Exchange")
    assert "HashAggregate" not in plan[plan.index("Exchange"):]
    assert jobs._added(slots, slots).agg(F.sum("n")).first()[0] == 2 * 5 * 500
