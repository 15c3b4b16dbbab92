"""8-connected components of pixels, distributed.

1. Pixels are grouped into tiles of fixed size; a tile holds at most tile x tile pixels whatever the
   size of the acquisition. Tiles are labelled inside one task, many at once, with array operations.
2. Only pixels on tile edges are joined with their neighbours across the edge; that gives a small
   graph of tile labels.
3. The graph is contracted by alternating large-star / small-star steps (Kiveris et al. 2014),
   whose number of rounds grows with the logarithm of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.operators.quantiles import ordered_rank
from verdant.session import by_key, cut_lineage

TILE = 128
ROW_SHIFT = 1 << 32


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of 0 … n - 1 over the links (a, b)."""
    label = np.arange(n)
    while True:
        one, other = label[a], label[b]
        if np.array_equal(one, other):
            return label
        lowest = np.minimum(one, other)
        np.minimum.at(label, one, lowest)
        np.minimum.at(label, other, lowest)
        while not np.array_equal(jumped := label[label], label):
            label = jumped


def _label_tiles(number: np.ndarray, row: np.ndarray, col: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, col) of the first pixel of each pixel's 8-connected component inside its tile.

    Tiles have numbers; rows and columns lie in 1 … width - 2, so that no neighbour is in another line or tile.
    """
    place, at = np.unique((number * width + row) * width + col, return_inverse=True)
    links = []
    for step in (1, width - 1, width, width + 1):
        ahead = np.searchsorted(place, place + step)
        near = np.flatnonzero(np.append(place, -1)[ahead] == place + step)
        links.append((near, ahead[near]))
    first = place[_smallest(len(place), *(np.concatenate(ends) for ends in zip(*links, strict=True)))][at]
    return first // width % width, first % width


def _tile_labels(df: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """(keys, row, col, label): a partition's tiles in order, many at once, as they come; a batch keeps back its last tile."""
    tiles = [*keys, "tile_row", "tile_col"]

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[tiles]
        number = own.ne(own.shift()).any(axis=1).to_numpy().cumsum()
        # a tile of row 0 also holds rows down to 1 - tile, as ``div`` cuts towards zero
        top, left = ((pdf[c].to_numpy() - 1) * tile for c in ("tile_row", "tile_col"))
        row, col = _label_tiles(number, pdf["row"].to_numpy() - top, pdf["col"].to_numpy() - left, 2 * tile + 1)
        return pdf[[*keys, "row", "col"]].assign(label=(row + top) * ROW_SHIFT + col + left)

    def label_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = rows[tiles].eq(rows[tiles].iloc[-1]).all(axis=1).to_numpy()
            rest = rows[last]
            if not last.all():
                yield label(rows[~last])
        if rest is not None and len(rest):
            yield label(rest)

    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"{k} {fields[k]}" for k in keys], "row long, col long, label long"])
    tiled = df.select(
        *keys,
        F.col("row").cast("long").alias("row"),
        F.col("col").cast("long").alias("col"),
        F.expr(f"row div {tile}").alias("tile_row"),
        F.expr(f"col div {tile}").alias("tile_col"),
    )
    # rows without a key belong to no acquisition
    return tiled.dropna(subset=[*keys, "row", "col"]).repartition(*tiles).sortWithinPartitions(*tiles).mapInPandas(label_all, schema)


def _edge_links(labelled: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Pairs of labels that touch across a tile edge."""
    r, c = F.col("row") % tile, F.col("col") % tile
    edge = labelled.filter(r.isin(0, tile - 1) | c.isin(0, tile - 1))
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))])
    reach = edge.withColumn("step", F.explode(steps)).select(
        *keys,
        (F.col("row") + F.col("step.dr")).alias("row"),
        (F.col("col") + F.col("step.dc")).alias("col"),
        F.col("label").alias("a"),
    )
    return (
        by_key(reach).join(edge.withColumnRenamed("label", "b"), [*keys, "row", "col"])
        .filter("a <> b")
        .select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _star(links: DataFrame, keys: list[str], large: bool) -> DataFrame:
    """One contraction step over links (a > b). Groups are only ever reduced to their minimum."""
    if large:
        # not a union, through which no word of the links' number would come to the join
        ends = [F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ("ab", "ba")]
        around = links.select(*keys, F.explode(F.array(*ends)).alias("_e")).select(*keys, "_e.u", "_e.v")
        least = around.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        least = least.withColumn("m", F.least("m", "u"))
        moved = around.filter("v > u").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        moved = (
            links.join(least, [*keys, "a"])
            .select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(least.select(*keys, "a", F.col("m").alias("b")))
        )
    return moved.filter("a <> b").distinct()


def smallest_in_component(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): every node of the links (a > b) with the smallest node of its component, itself excepted.

    Rounds grow with the logarithm of the longest chain. Groups are only reduced to their minimum; a node
    with very many neighbours is one row on the other side of its join, which Spark may split.
    """

    def fingerprint(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*keys, "a", "b"))).first())

    links = cut_lineage(links)
    seen = fingerprint(links)
    while seen[0]:
        links = cut_lineage(_star(_star(links, keys, large=True), keys, large=False))
        now = fingerprint(links)
        if now == seen:
            break
        seen = now
    return links


def label_components(df: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """(keys, row, col, cluster_id); ids count components in row-major order of their first pixel.

    Tile labels get their component and its id first; pixels then join on their tile label, of which a
    tile bounds the rows.
    """
    local = cut_lineage(_tile_labels(df, keys, tile))
    roots = smallest_in_component(_edge_links(local, keys, tile), keys)
    labels = local.select(*keys, "label").distinct()
    rooted = labels.join(roots.select(*keys, F.col("a").alias("label"), F.col("b").alias("root")), [*keys, "label"], "left")
    rooted = rooted.select(*keys, "label", F.coalesce("root", "label").alias("root"))
    # Numbered by first pixel, block by block of one raster line: a line's width bounds a block.
    block = F.expr(f"root div {ROW_SHIFT}")
    ids = ordered_rank(rooted.select(*keys, "root").distinct(), keys, "root", "cluster_id", block)
    named = by_key(rooted).join(by_key(ids), [*keys, "root"]).select(*keys, "label", "cluster_id")
    return local.join(named, [*keys, "label"]).select(*keys, "row", "col", "cluster_id")
