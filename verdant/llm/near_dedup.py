"""Near-duplicates by a multi-index Hamming join over b-bit MinHash signatures, confirmed on full sets.

1. A document's set holds the 64-bit hashes of its distinct shingles. Equal sets are one node, so a group
   of copies of any size is one row from here on.
2. A node's signature has ``CHUNKS`` x ``SYMBOLS`` symbols of 16 bits, each of an independent minimum. Two
   signatures that differ in at most ``REACH`` symbols have, by the pigeonhole principle, a chunk with at
   most one differing symbol. Every chunk is therefore posted once per symbol it may differ in, that symbol
   left out: all pairs within ``REACH`` share a bucket. At a similarity of 0.8 a pair stays unfound with
   probability 0.181^8, about 1e-6.
3. Pairs inside a bucket are not listed. Each node meets the bucket's most popular node only (the sum of the
   sizes of its buckets; the original that copies were made from has the most); of those, the nearest by
   Hamming distance is confirmed on full sets. That links most of every group at once.
4. What could still link two groups is a pair of different components that share a bucket, and so that
   bucket's most popular node: a cell is a popular node with all nodes of its buckets. Within each cell that
   holds several components, every node outside the largest one is compared with all others on full sets,
   through an inverted index of the cell, block by block of bounded size. Only links that join components
   leave a block. Pairs within a component need no check: they add nothing.

So no link between different texts within reach is lost; a group of n copies moves about n rows, and no pair of
texts is ever a row unless it is a link that is needed.

Cases: texts without words have the empty set, link with nothing and are kept; NULL counts as such a text.
Rows with the same id are documents of their own with one id. A NULL doc_id can be linked; it is smaller
than no id, and a component of NULL ids only has a NULL component_id. An empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.llm._words import Hashes, blank_words
from verdant.operators.components import smallest_in_component
from verdant.session import by_key, cut_lineage

SHINGLE = 2
PERCENT = 80
CHUNKS, SYMBOLS = 8, 4
REACH = 2 * CHUNKS - 1
#: Bounds of a block of a cell; a single node may have more shingles.
BLOCK_NODES, BLOCK_SHINGLES = 2048, 2_000_000
SIGNS = [f"s{c}" for c in range(CHUNKS)]
_ODD = np.random.default_rng(20).integers(0, 1 << 63, CHUNKS * SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of the whole sequence, if shorter."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    mixed = np.full(n, min(size, len(words)), dtype=np.uint64)
    for k in range(min(size, len(words))):
        mixed = (mixed ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed * np.uint64(0xBF58476D1CE4E5B9))


def signature(found: np.ndarray) -> np.ndarray:
    """One 64-bit chunk of four 16-bit symbols per entry."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, dtype=np.uint64)
    for low in range(0, len(found), 4096):  # bounds the memory of very long texts
        np.minimum(least, (found[low : low + 4096, None] * _ODD).min(axis=0), out=least)
    symbol = ((least ^ (least >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(48)
    return (symbol.reshape(CHUNKS, SYMBOLS) << np.arange(0, 64, 16, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def signatures(docs: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """(rid, doc_id, n_shingles, set_hash, s0 ..): written once; ``set_hash`` has 128 bits."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = Hashes()
        for batch in rows:
            counts, names, signs = [], [], []
            for x in batch.column(2):
                found = shingles(hashes.of(blank_words(x.as_py())), size)
                counts.append(len(found))
                names.append(xxhash.xxh3_128_digest(found.tobytes()))
                signs.append(signature(found))
            columns = np.stack(signs).view(np.int64) if signs else np.empty((0, CHUNKS), np.int64)
            arrays = [pa.array(counts, pa.int64()), pa.array(names, pa.binary()), *[pa.array(columns[:, c]) for c in range(CHUNKS)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["rid", "doc_id", "n_shingles", "set_hash", *SIGNS])

    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return cut_lineage(named.mapInArrow(batches, f"rid long, doc_id {kind}, n_shingles long, set_hash binary, " + ", ".join(f"{s} long" for s in SIGNS)))


def _keys() -> Column:
    """Per chunk and symbol the chunk without that symbol; the chunk's and symbol's number takes its place."""
    keys = []
    for c in range(CHUNKS):
        for j in range(SYMBOLS):
            rest = ((1 << 64) - 1) ^ (0xFFFF << 16 * j)
            tag = (c * SYMBOLS + j) << 16 * j
            keys.append(F.col(f"s{c}").bitwiseAND(F.lit(_signed(rest))).bitwiseOR(F.lit(_signed(tag))))
    return F.array(*keys)


def _signed(value: int) -> int:
    """The long with these 64 bits."""
    return value - (1 << 64) if value >> 63 else value


def _distance(left: str, right: str) -> Column:
    """How many of the symbols differ: a lane's top bit is set where the lane is not zero, and counted."""
    each = []
    for s in SIGNS:
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        # The low 15 bits plus 0x7FFF carry into bit 15 unless they are zero; halves keep the sum inside a long.
        for half in (F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))):
            carried = (half.bitwiseAND(F.lit(0x7FFF7FFF).cast("long")) + F.lit(0x7FFF7FFF).cast("long")).bitwiseOR(half)
            each.append(F.bit_count(carried.bitwiseAND(F.lit(0x80008000).cast("long"))))
    return reduce(lambda a, b: a + b, each)


def _alike(left: str, right: str, percent: int) -> Column:
    """Signatures within reach, and sizes that allow the similarity."""
    a, b = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (_distance(left, right) <= REACH)


def _sets(docs: DataFrame, nodes: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """(node, shingles): the full sets of the nodes, as sorted hashes in bytes, worked out from their texts again."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = Hashes()
        for batch in rows:
            sets = [shingles(hashes.of(blank_words(x.as_py())), size).tobytes() for x in batch.column(2)]
            right = [xxhash.xxh3_128_digest(s) == n.as_py() for s, n in zip(sets, batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"]).filter(pa.array(right, pa.bool_()))

    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(nodes, F.col("doc_id").eqNullSafe(F.col("first_id")))
    # Rows that share an id may give a node its set more than once.
    return named.select("node", "set_hash", "text").mapInArrow(batches, "node long, shingles binary").dropDuplicates(["node"])


def _confirmed(docs: DataFrame, table: DataFrame, pairs: DataFrame, percent: int, size: int, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    sets = cut_lineage(_sets(docs, table.select("node", "first_id", "set_hash").join(wanted, "node"), size, doc_id, text))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(batches, "a long, b long")


def _block_links(percent: int):
    """(a, b) of one block of a cell: links between its odd nodes and its members that join components."""

    def links(block: pa.Table) -> pa.Table:
        odd = np.array(block["odd"].to_pylist(), dtype=bool)
        node, root = block["node"].to_numpy(), block["root"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block["shingles"]]
        members, found = np.flatnonzero(~odd), []
        sizes = np.array([len(sets[i]) for i in members], np.int64)
        if len(members):
            flat = np.concatenate([sets[i] for i in members])
            order = np.argsort(flat, kind="stable")
            holder = np.repeat(np.arange(len(members)), sizes)[order]
            flat = flat[order]
            parent: dict[int, int] = {}

            def top(r: int) -> int:
                while parent.get(r, r) != r:
                    r = parent[r]
                return r

            for i in np.flatnonzero(odd):
                low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
                held = [holder[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True) if x < y]
                if not held:
                    continue
                shared = np.bincount(np.concatenate(held), minlength=len(members))
                alike = np.flatnonzero(100 * shared >= percent * (sizes + len(sets[i]) - shared))
                _, first = np.unique(root[members[alike]], return_index=True)
                for j in members[alike[first]].tolist():
                    one, other = top(int(root[i])), top(int(root[j]))
                    if one != other:
                        parent[max(one, other)] = min(one, other)
                        found.append((max(int(node[i]), int(node[j])), min(int(node[i]), int(node[j]))))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return links


def _cell_links(docs: DataFrame, table: DataFrame, cells: DataFrame, found: DataFrame, percent: int, size: int, doc_id: str, text: str) -> DataFrame:
    """(a, b): links between components within cells (centre, node); ``found`` has the components' roots so far."""
    members = cells.join(table.select("node", "n_shingles"), "node").join(found.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    members = members.select("centre", "node", "n_shingles", F.coalesce("root", "node").alias("root"))
    by_root = members.groupBy("centre", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n_shingles").alias("weight"))
    largest = F.max(F.struct("k", "weight", "root"))
    mixed = by_root.groupBy("centre").agg(largest.alias("m"), F.sum("k").alias("k"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")

    def blocks(k: Column, weight: Column) -> Column:
        return F.ceil(F.greatest(k / BLOCK_NODES, weight / BLOCK_SHINGLES)).cast("int")

    mixed = mixed.select(
        "centre", F.col("m.root").alias("largest"), blocks(F.col("k"), F.col("weight")).alias("all_blocks"),
        blocks(F.col("k") - F.col("m.k"), F.col("weight") - F.col("m.weight")).alias("odd_blocks"),
    )
    opened = cut_lineage(members.join(mixed, "centre"))

    def own(n: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    rows = opened.select("centre", "node", "root", F.lit(False).alias("odd"), own("all_blocks").alias("block"), every("odd_blocks").alias("odd_block"))
    odd = opened.filter("root <> largest").select("centre", "node", "root", F.lit(True).alias("odd"), own("odd_blocks").alias("odd_block"), every("all_blocks").alias("block"))
    sets = _sets(docs, table.select("node", "first_id", "set_hash").join(opened.select("node").distinct(), "node"), size, doc_id, text)
    held = rows.unionByName(odd).join(sets, "node")
    return held.groupBy("centre", "block", "odd_block").applyInArrow(_block_links(percent), "a long, b long").distinct()


def classes(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: rid, doc_id, n_shingles, component_id (the smallest doc_id linked with it, through any number of links) and node (its class of equal sets)."""
    signed = signatures(docs, size, doc_id, text)
    table = cut_lineage(
        signed.filter("n_shingles > 0")
        .groupBy("set_hash")
        .agg(F.min("rid").alias("node"), F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n_shingles"), *[F.max(s).alias(s) for s in SIGNS])
    )
    posted = by_key(table.select("node", F.explode(_keys()).alias("key")))
    buckets = cut_lineage(posted.join(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key"))
    popular = buckets.groupBy("node").agg(F.sum("n").alias("fame"))
    centres = buckets.join(popular, "node").groupBy("key").agg(F.max(F.struct("fame", F.col("node").alias("centre"))).alias("c")).select("key", "c.centre")
    cells = cut_lineage(buckets.join(centres, "key").select("centre", "node").distinct())
    known = table.select("node", F.struct("n_shingles", *SIGNS).alias("sign"))
    near = (
        cells.filter("node <> centre")
        .join(known.select("node", F.col("sign").alias("x")), "node")
        .join(known.select(F.col("node").alias("centre"), F.col("sign").alias("y")), "centre")
        .filter(_alike("x", "y", percent))
        .select("node", _distance("x", "y").alias("d"), F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b"))
    )
    best = near.groupBy("node").agg(F.min(F.struct("d", "a", "b")).alias("first")).select("first.a", "first.b").distinct()
    links = cut_lineage(_confirmed(docs, table, cut_lineage(best), percent, size, doc_id, text))
    more = _cell_links(docs, table, cells, smallest_in_component(links, []), percent, size, doc_id, text)
    whole = smallest_in_component(links.unionAll(more), [])
    rooted = table.join(whole.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("set_hash", "node", "first_id", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("set_hash", "node", "component_id")
    alone = F.col("n_shingles") == 0
    joined = signed.select("rid", "doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    return joined.select("rid", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node")


def kept() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.

    Of rows that share that id one stays. Rows with a NULL id stay: nothing says which they are.
    """
    ids = classes(docs).filter(kept() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    named = docs.filter(F.col("doc_id").isNotNull())
    return named.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns).unionAll(docs.filter(F.col("doc_id").isNull()))
