"""Numbers along a global order, without gathering the rows anywhere."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.session import cut_lineage


def numbered(rows: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """``rows`` written in ``order`` with their place in it, from 0; equal rows take any of their places.

    Ranges of the order are sorted apart from each other. One count per range, as many as there are
    partitions, reaches the driver; a row's number is its place in its range after all earlier ranges.
    ``rows`` are read twice (the ranges come from a sample), so they should stem from a written table.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = cut_lineage(ranges.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    counts = sorted(stored.groupBy(part.alias("part")).count().collect())
    before = list(accumulate((n for _, n in counts), initial=0))
    offsets = stored.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "_part int, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.join(F.broadcast(offsets), part == F.col("_part")).select(*[F.col(c) for c in rows.columns], place.alias(name))
