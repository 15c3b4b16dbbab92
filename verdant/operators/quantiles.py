"""Exact medians of groups of any size.

The columns to summarise stay beside each other. A group of at most ``WHOLE`` rows goes to one task, which sorts it; its
rows are exchanged once, and many small groups cost no sketch each. Larger groups are neither exchanged nor sorted: a first read keeps, per group and column, the usual sums
and a quantile sketch whose rank error is bounded, all combined on the map side; two quantiles on either side
of the middle bracket the median. A second read counts, again in one wide aggregate, how many values lie
below and up to the bracket, which proves it right or widens it. Only values inside the brackets, a few in ten
thousand and counted per distinct value, are exchanged to find the middle ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verdant.session import by_key, cut_lineage

#: Rank error of the sketch is a group's size over this.
ACCURACY = 10_000
#: Brackets that are sent to all tasks, of some 50 bytes each; beyond it the rows are joined with them by key.
SENT = 1_500_000
#: Rows of a group that one task sorts; beyond it the middle is bracketed.
WHOLE = 65_536

_SUMMARY = "index_name string, size long, minimum double, maximum double, mean double, std double, median double"


def _beside(wide: DataFrame, brackets: DataFrame, keys: list[str], number: int) -> DataFrame:
    """Every row with its group's brackets, of which there are ``number``."""
    return wide.join(F.broadcast(brackets) if number <= SENT else by_key(brackets), keys)


def sketches(wide: DataFrame, keys: list[str], names: list[str] | tuple[str, ...], **more: Column) -> DataFrame:
    """First read: one row per group with the sums and the bracket of every column (struct ``_name``), and ``more`` aggregates; stored."""
    off = 2.0 / ACCURACY
    measured = {
        f"_{n}": F.struct(
            F.count(n).alias("size"),
            F.min(n).alias("minimum"),
            F.max(n).alias("maximum"),
            F.avg(n).alias("mean"),
            F.stddev_pop(n).alias("std"),
            F.percentile_approx(n, [0.5 - off, 0.5 + off], ACCURACY).alias("about"),
        )
        for n in names
    }
    return cut_lineage(wide.groupBy(*keys).agg(*[c.alias(n) for n, c in (measured | more).items()]))


def proven(wide: DataFrame, known: DataFrame, keys: list[str], names: list[str] | tuple[str, ...], carry: tuple[str, ...] = (), **more: Column) -> DataFrame:
    """Second read: ``known`` with brackets that hold the middle ranks, and ``more`` aggregates over rows that have its columns ``carry``; stored."""
    sent = known.select(*keys, *carry, *[F.col(f"_{n}.about").alias(f"_{n}") for n in names])
    counted = {
        f"+{n}": F.struct(
            F.count_if(F.col(n) < F.get(f"_{n}", F.lit(0))).alias("below"),
            F.count_if(F.col(n) <= F.get(f"_{n}", F.lit(1))).alias("upto"),
        )
        for n in names
    }
    counts = _beside(wide, sent, keys, known.count() * len(names)).groupBy(*keys).agg(*[c.alias(n) for n, c in (counted | more).items()])

    def bracket(n: str) -> Column:
        size, low, high = F.col(f"_{n}.size"), F.get(f"_{n}.about", F.lit(0)), F.get(f"_{n}.about", F.lit(1))
        below, upto = F.col(f"`+{n}`.below"), F.col(f"`+{n}`.upto")
        early, late = below > F.floor((size - 1) / 2), upto <= F.floor(size / 2)
        return F.struct(
            F.when(early, F.col(f"_{n}.minimum")).otherwise(low).alias("low"),
            F.when(late, F.col(f"_{n}.maximum")).otherwise(high).alias("high"),
            F.when(early, F.lit(0).cast("long")).otherwise(below).alias("below"),
        )

    rest = [c for c in known.columns if c not in {*keys, *(f"_{n}" for n in names)}]
    return cut_lineage(by_key(known).join(counts, keys).select(*keys, *rest, *more, *[F.struct(f"_{n}.*", bracket(n).alias("bracket")).alias(f"_{n}") for n in names]))


def medians(wide: DataFrame, known: DataFrame, keys: list[str], names: list[str] | tuple[str, ...]) -> DataFrame:
    """Third read: (keys, index_name, size, minimum, maximum, mean, std, median) from proven brackets."""
    ends = known.select(*keys, *[F.struct(f"_{n}.bracket.low", f"_{n}.bracket.high").alias(f"_{n}") for n in names])
    inside = [F.when(F.col(n).between(F.col(f"_{n}.low"), F.col(f"_{n}.high")), F.col(n).cast("double")) for n in names]
    values = F.array(*[F.struct(F.lit(n).alias("index_name"), v.alias("value")) for n, v in zip(names, inside, strict=True)])
    near = _beside(wide, ends, keys, known.count() * len(names)).select(*keys, F.explode(F.filter(values, lambda v: v["value"].isNotNull())).alias("v"))
    near = near.groupBy(*keys, "v.index_name", "v.value").agg(F.count(F.lit(1)).alias("n"))

    each = known.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("index_name"), f"_{n}.*") for n in names])).alias("s")).select(*keys, "s.*")
    ranks = each.select(*keys, "index_name", "size", F.col("bracket.below").alias("below"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(*keys, "index_name").orderBy("value"))
    reached = near.join(by_key(ranks), [*keys, "index_name"]).withColumn("upto", upto)
    lower, upper = (F.min(F.when(F.col("upto") > F.floor(rank / 2), F.col("value"))) for rank in (F.col("size") - 1, F.col("size")))
    middle = reached.groupBy(*keys, "index_name").agg(((lower + upper) / 2).alias("median"))
    return each.drop("about", "bracket").join(middle, [*keys, "index_name"], "left")


def _starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Where the first ``keys`` columns, by which the rows are sorted, begin to differ from the row before."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for column in batch.columns[:keys]:
        here, before = column.slice(1), column.slice(0, len(column) - 1)
        differs = pc.coalesce(pc.not_equal(here, before), pc.xor(pc.is_null(here), pc.is_null(before)))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _summary(batch: pa.RecordBatch, starts: np.ndarray, keys: int, names: list[str] | tuple[str, ...]) -> pa.RecordBatch:
    """One row per group and column of whole groups that begin at ``starts``."""
    groups = len(starts)
    owner = np.repeat(np.arange(groups), np.diff(starts, append=batch.num_rows))
    sizes, found = np.zeros((len(names), groups), np.int64), np.zeros((5, len(names), groups))
    for i, column in enumerate(batch.columns[keys:]):
        there = column.is_valid().to_numpy(zero_copy_only=False)
        values, own = column.fill_null(0.0).to_numpy(zero_copy_only=False)[there], owner[there]
        values = values[np.lexsort((values, own))]
        sizes[i] = np.bincount(own, minlength=groups)
        some = np.flatnonzero(sizes[i])
        size, at = sizes[i][some], (np.cumsum(sizes[i]) - sizes[i])[some]
        if not len(some):
            continue
        with np.errstate(invalid="ignore", over="ignore"):
            mean = np.add.reduceat(values, at) / size
            std = np.sqrt(np.add.reduceat((values - np.repeat(mean, size)) ** 2, at) / size)
            median = (values[at + (size - 1) // 2] + values[at + size // 2]) / 2
        found[:, i, some] = values[at], values[at + size - 1], mean, std, median
    named = batch.select(range(keys)).take(pa.array(np.tile(starts, len(names))))
    numbers = [pa.array(f.ravel(), mask=sizes.ravel() == 0) for f in found]
    arrays = [*named.columns, pa.array(np.repeat(np.array(names, object), groups), pa.string()), pa.array(sizes.ravel()), *numbers]
    return pa.RecordBatch.from_arrays(arrays, [*named.schema.names, *[c.split()[0] for c in _SUMMARY.split(", ")]])


def sorted_summaries(wide: DataFrame, keys: list[str], names: list[str] | tuple[str, ...]) -> DataFrame:
    """``summaries`` of groups that each fit in a task; a task takes them as they come, many in a batch."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            starts = _starts(batch, len(keys))
            if len(starts) > 1:
                yield _summary(batch.slice(0, starts[-1]), starts[:-1], len(keys), names)
            held = batch.slice(starts[-1])
        if held is not None:
            yield _summary(held, np.zeros(1, np.int64), len(keys), names)

    schema = StructType([wide.schema[k] for k in keys] + StructType.fromDDL(_SUMMARY).fields)
    return wide.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(summarise, schema)


def summaries(wide: DataFrame, keys: list[str], names: list[str] | tuple[str, ...]) -> DataFrame:
    """(keys, index_name, size, minimum, maximum, mean, std, median) per group and column of ``wide``.

    NULLs do not count; a column without any value in a group has size 0 and NULL else. ``wide`` is read
    more than once, so it should be a stored table or a projection of one.
    """
    wide = wide.select(*keys, *[F.col(n).cast("double").alias(n) for n in names])
    large = cut_lineage(wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > WHOLE).select(*keys))
    if large.isEmpty():
        return sorted_summaries(wide, keys, names)
    # stored, so that the three reads work out no column again
    rest = cut_lineage(wide.join(large, keys, "left_semi"))
    bracketed = medians(rest, proven(rest, sketches(rest, keys, names), keys, names), keys, names)
    return sorted_summaries(wide.join(large, keys, "left_anti"), keys, names).unionByName(bracketed)


def ordered_rank(df: DataFrame, keys: list[str], order: str, name: str, block: Column) -> DataFrame:
    """Row number inside ``keys`` by the unique column ``order``, without one task per key.

    ``block`` must be non-decreasing in ``order`` and hold a bounded number of rows.
    """
    blocked = df.withColumn("_block", block)
    sizes = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_block")
    offsets = sizes.select(
        *keys, "_block", (F.sum("_n").over(w) - F.col("_n")).alias("_offset")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order))
    return (
        by_key(blocked.withColumn("_inside", inside))
        .join(by_key(offsets), [*keys, "_block"])
        .withColumn(name, (F.col("_offset") + F.col("_inside")).cast("long"))
        .drop("_block", "_inside", "_offset")
    )
