"""A9 with W7 and R4: stored tables that are changed bucket by bucket, batch by batch.

Rows lie in buckets of their main key. A batch reads and writes the buckets it touches, into a folder of its
own; then a manifest names the folder that holds each bucket. Manifests are numbered, and the highest that was
written to its end is the table: readers see the state before a batch or after it, never between.

A batch is known by its name. One that is in the manifest is not applied again, so a retry adds nothing; one that
failed before its manifest was written leaves a folder that its retry overwrites. One writer at a time changes a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.sources.store import BUCKETS, _bucket

#: Names of batches that a manifest remembers, the latest ones; a retry comes long before.
REMEMBERED = 1000


def _complete(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the manifests that were written to their end, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path)]
    return sorted(int(p.getName()) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def manifest(spark: SparkSession, folder: str) -> tuple[int, dict[int, str], list[str]]:
    """(number, folder of every bucket, batches applied) of the table as it is; number -1 where there is none."""
    done = _complete(spark, folder)
    if not done:
        return -1, {}, []
    rows = spark.read.schema("kind string, place int, name string").json(f"{folder}/manifest/{done[-1]:08d}").collect()
    batches = sorted((r.place, r.name) for r in rows if r.kind == "batch")
    return done[-1], {r.place: r.name for r in rows if r.kind == "bucket"}, [name for _, name in batches]


def read(spark: SparkSession, folder: str, schema: str, only: list[int] | None = None) -> DataFrame:
    """The rows of the table, or of some of its buckets."""
    held = manifest(spark, folder)[1]
    paths = [f"{folder}/data/{name}/bucket={b}" for b, name in sorted(held.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def change(
    batch: DataFrame, folder: str, schema: str, key: str, name: str, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS
) -> list[int]:
    """Applies ``merge`` (stored rows, rows of the batch) to the buckets of ``key`` that the batch touches; their numbers.

    ``merge`` must keep every row in the bucket of its key. An applied batch, and one without rows, changes nothing.
    """
    spark = batch.sparkSession
    number, held, applied = manifest(spark, folder)
    if name in applied:
        return []
    placed = _bucket(F.col(key), buckets)
    touched = sorted(r.b for r in batch.select(placed.alias("b")).distinct().collect())  # at most ``buckets`` numbers
    if not touched:
        return []
    merged = merge(read(spark, folder, schema, touched), batch).withColumn("bucket", placed).hint("rebalance", "bucket")
    merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/{name}")
    written = spark.read.schema(f"{schema}, bucket int").parquet(f"{folder}/data/{name}")
    wrote = {r.bucket for r in written.select("bucket").distinct().collect()}
    now = {b: f for b, f in held.items() if b not in touched} | {b: name for b in touched if b in wrote}
    rows = [("bucket", b, f) for b, f in now.items()] + [("batch", i, f) for i, f in enumerate([*applied, name][-REMEMBERED:])]
    table = spark.createDataFrame(rows, "kind string, place int, name string").coalesce(1)
    table.write.mode("overwrite").json(f"{folder}/manifest/{number + 1:08d}")
    return touched


def tidy(spark: SparkSession, folder: str, states: int = 2) -> int:
    """Deletes what only older states than the last ``states`` need; the number of bucket folders that stay.

    A reader that began more than ``states`` changes ago may miss its files. To be called by the one writer.
    """
    done = _complete(spark, folder)
    kept = done[max(len(done) - states, 0) :]
    needed: set[tuple[str, str]] = set()
    for number in kept:
        rows = spark.read.schema("kind string, place int, name string").json(f"{folder}/manifest/{number:08d}").filter("kind = 'bucket'")
        needed |= {(r.name, f"bucket={r.place}") for r in rows.collect()}  # one row per bucket
    place = spark._jvm.org.apache.hadoop.fs.Path
    data = place(f"{folder}/data")
    files = data.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = {name for name, _ in needed}
    for batch in files.listStatus(data) if files.exists(data) else []:
        name = batch.getPath().getName()
        if name not in names:
            files.delete(batch.getPath(), True)
            continue
        for bucket in files.listStatus(batch.getPath()):
            if bucket.isDirectory() and (name, bucket.getPath().getName()) not in needed:
                files.delete(bucket.getPath(), True)
    for number in done[: len(done) - len(kept)]:
        files.delete(place(f"{folder}/manifest/{number:08d}"), True)
    return len(needed)
