"""Structured Streaming forms of the incremental jobs. All of them stop when the input is used up.

Results are versioned tables (``sources.versions``): a micro-batch rewrites the buckets of the keys it brings
and is known by its stream and number, so that a restarted batch changes nothing twice, readers see one state,
and folders of earlier states are deleted. Checkpoints and results live in the folders the caller names, which
on a cluster are shared ones. A checkpoint folder is what names a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verdant import constants as K
from verdant.functions.text import mask_secrets
from verdant.operators.quantiles import medians
from verdant.operators.store import ACQUISITION_KEY, insert_if_new
from verdant.operators.zonal import KEYS, core_index_pixels, statistics_columns
from verdant.session import cut_lineage
from verdant.sources import versions
from verdant.sources.store import BUCKETS

#: How long keys stay in a stream's state after they arrived.
HORIZON = "30 days"
#: Slots of equal width in which index values are counted.
SLOTS_PER_UNIT = 256


def read_files(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _run(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _once(stream: DataFrame, keys: list[str], horizon: str) -> DataFrame:
    """Rows whose keys did not arrive within the ``horizon`` before.

    The watermark follows the time of arrival, which only grows: no row is ever too late, however old the event
    it tells of, and the state holds the keys of one horizon, not of all time.
    """
    arrived = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", horizon)
    return arrived.dropDuplicatesWithinWatermark(keys).drop("_arrived")


def _name(checkpoint: str, batch_id: int) -> str:
    return f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}-{batch_id:08d}"


def _apply(batch: DataFrame, folder: str, schema: str, key: str, name: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    # stored first: a batch is looked at more than once, the stream's state only once
    if versions.change(cut_lineage(batch), folder, schema, key, name, merge):
        versions.tidy(batch.sparkSession, folder)


def _declared(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def ingest_acquisitions(stream: DataFrame, out: str, checkpoint: str, horizon: str = HORIZON) -> DataFrame:
    """ST1: each (field, product, revision) is stored once, the earliest of the batch that brings it.

    Repeats within the horizon end in the stream's state; those of later ones are found in the table, of which
    the buckets of the fields are read that still bring something. Late acquisitions are stored like others.
    """
    schema = _declared(stream.schema)

    def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
        return stored.unionByName(insert_if_new(new, stored).filter("created").drop("created"))

    def work(batch: DataFrame, batch_id: int) -> None:
        _apply(batch, out, schema, "field_id", _name(checkpoint, batch_id), merge)

    # the state keeps any one row of a key and batch; which of a batch's repeats is stored is decided before it
    _run(_once(stream, [*ACQUISITION_KEY, "acquired_at", "acquisition_id"], horizon), work, checkpoint)
    return versions.read(stream.sparkSession, out, schema)


SLOTS = "field_id long, acquisition_id long, index_name string, slot int, n long, total double, minimum double, maximum double"


def _slots(values: DataFrame) -> DataFrame:
    """Per acquisition, index and slot the number, sum and ends of its values; slot NULL for pixels without one.

    Pixels go to their acquisition's task before they become five rows each: they are fewer bytes than the slots of
    a file's share, and the size of a file does not decide how many slots a task holds.
    """
    long = values.repartition(BUCKETS, *KEYS).select(*KEYS, F.explode(F.array(*[F.struct(F.lit(n).alias("index_name"), F.col(n).alias("value")) for n in K.CORE_INDICES])).alias("v")).select(*KEYS, "v.*")
    slot = F.floor(F.greatest(F.least(F.col("value"), F.lit(8.0)), F.lit(-8.0)) * SLOTS_PER_UNIT).cast("int")
    return long.groupBy(*KEYS, "index_name", slot.alias("slot")).agg(
        F.count("value").alias("n"), F.sum("value").alias("total"), F.min("value").alias("minimum"), F.max("value").alias("maximum")
    )


def _added(stored: DataFrame, new: DataFrame) -> DataFrame:
    # Either side has a slot once at most, so counting inside the readers' tasks first would only fill their memory; dealt
    # over as many parts as there are buckets, a task has a share of the rows that neither the size of a file nor their compression decides.
    both = stored.unionByName(new.select(*stored.columns)).repartition(BUCKETS, *KEYS, "index_name", "slot")
    return both.groupBy(*KEYS, "index_name", "slot").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum")
    )


def _summed(slots: DataFrame) -> DataFrame:
    """Per acquisition one struct per index, with the ends of the slots that hold the middle ranks."""
    order = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("slot", "n", "minimum", "maximum"))))
    each = slots.groupBy(*KEYS, "index_name").agg(
        F.sum("n").alias("size"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"), F.sum("total").alias("total"), order.alias("slots")
    )
    # running numbers over at most 16 * SLOTS_PER_UNIT + 1 slots
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0).cast("long").alias("below"))
    first, last = F.floor((F.col("size") - 1) / 2), F.floor(F.col("size") / 2)

    def step(t, s):
        upto = t["upto"] + s["n"]
        starts, ends = t["low"].isNull() & (upto > first), t["high"].isNull() & (upto > last)
        return F.struct(
            upto.alias("upto"),
            F.when(starts, s["minimum"]).otherwise(t["low"]).alias("low"),
            F.when(ends, s["maximum"]).otherwise(t["high"]).alias("high"),
            F.when(starts, t["upto"]).otherwise(t["below"]).alias("below"),
        )

    found = each.withColumn("b", F.aggregate("slots", start, step))
    measured = F.struct(
        "size", "minimum", "maximum", F.when(F.col("size") > 0, F.col("total") / F.col("size")).alias("mean"), F.lit(None).cast("double").alias("std"),
        F.lit(None).cast("array<double>").alias("about"), F.struct("b.low", "b.high", "b.below").alias("bracket"),
    )
    return found.groupBy(*KEYS).agg(*[F.max(F.when(F.col("index_name") == n, measured)).alias(f"_{n}") for n in K.CORE_INDICES])


def upsert_statistics(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """ST2: zonal statistics of acquisitions whose pixels arrive in any number of batches.

    A batch adds its counts, sums and ends per slot to those of the acquisitions it touches and reads no earlier
    pixel. Its index values are stored; the statistics, when asked for, read of them what lies in the middle slots.
    """
    spark = stream.sparkSession
    values = "field_id long, acquisition_id long, " + ", ".join(f"{n} double" for n in K.CORE_INDICES)

    def work(batch: DataFrame, batch_id: int) -> None:
        name = _name(checkpoint, batch_id)
        indexed = core_index_pixels(batch).select(*KEYS, *[F.col(n).cast("double").alias(n) for n in K.CORE_INDICES])
        indexed.write.mode("overwrite").parquet(f"{out}/values/{name}")
        measured = batch.sparkSession.read.schema(values).parquet(f"{out}/values/{name}")
        _apply(_slots(measured), f"{out}/slots", SLOTS, "acquisition_id", name, _added)

    _run(stream, work, checkpoint)
    known = _summed(versions.read(spark, f"{out}/slots", SLOTS))
    if versions.manifest(spark, f"{out}/slots")[0] < 0:  # a stream that has brought nothing yet has no rows
        return statistics_columns(medians(spark.createDataFrame([], values), known, KEYS, K.CORE_INDICES))
    return statistics_columns(medians(spark.read.schema(values).parquet(f"{out}/values/*"), known, KEYS, K.CORE_INDICES))


def mask_stream(stream: DataFrame, column: str, out: str, checkpoint: str, literals: tuple[str, ...] = ()) -> DataFrame:
    """ST3: stateless masking from files to files."""
    masked = stream.withColumn(column, mask_secrets(F.col(column), literals))
    query = masked.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


COUNTS = "conv_id long, messages long, last_message_id long"


def running_counts(stream: DataFrame, out: str, checkpoint: str, horizon: str = HORIZON) -> DataFrame:
    """ST4: message count and last message id per conversation, updated with every batch.

    State: the message ids that arrived within the horizon; a message that is delivered again later than that is
    counted again. Counts are added to the table, one row per conversation.
    """

    def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
        return stored.unionByName(new).groupBy("conv_id").agg(F.sum("messages").alias("messages"), F.max("last_message_id").alias("last_message_id"))

    def work(batch: DataFrame, batch_id: int) -> None:
        counted = batch.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.max("message_id").alias("last_message_id"))
        _apply(counted, out, COUNTS, "conv_id", _name(checkpoint, batch_id), merge)

    _run(_once(stream, ["conv_id", "message_id"], horizon), work, checkpoint)
    return versions.read(stream.sparkSession, out, COUNTS)
