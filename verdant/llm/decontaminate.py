"""Benchmark decontamination with a distributed positional inverted index.

1. One pass over the texts stores, per document, the positions of all words that occur in the benchmark.
   A bitmap of fixed size says which words may; words it lets pass by chance match nothing later.
2. Document frequencies come from that table. Of every window of 13 item words (or the whole item, if
   shorter) the ``RAREST`` rarest positions are index positions.
3. The postings of index words are joined with the items' index positions and grouped per (document,
   item): offset-adjusted lists, place minus item position. A list long enough is a candidate.
4. Candidates are matched against the stored positions word by word: runs of at least a window are exact
   hits. An item whose index words stand close together without such a run is a proximity match.

Texts are read once and not shuffled; what moves are postings of rare words and the stored positions.
Items of the same words are one item until their ids are named in the result. Frequent words become index words only of items that have no others, so a common passage makes as many
candidates as documents that hold it. Nothing of unbounded size is broadcast or collected.

Cases: NULL or wordless texts have no words and no hits, NULL or wordless items match nothing; a NULL
item_id reads as an empty one; repeated documents are judged row by row, repeated items count once per
item_id; with an empty benchmark nothing is hit, an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm._words import Hashes, alnum_words
from verdant.session import cut_lineage

WINDOW = 13
RAREST = 3
BITS = 22
NEAR_SHARE, NEAR_SLACK = 0.7, 2.0


def _item_rows(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(iid, item_ids, hashes): one row per different sequence of words, with the ids of its items; 64-bit hashes as bytes."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in rows:
            words = [hashes.of(alnum_words(x.as_py())).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.binary())], ["iid", "item_id", "hashes"])

    named = benchmark.select(F.monotonically_increasing_id().alias("iid"), F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.col(text).alias("text"))
    each = named.mapInArrow(batches, "iid long, item_id string, hashes binary").filter(F.length("hashes") > 0)
    return cut_lineage(each.groupBy("hashes").agg(F.min("iid").alias("iid"), F.array_sort(F.collect_set("item_id")).alias("item_ids")).select("iid", "item_ids", "hashes"))


def _low(column: str = "word"):
    return F.col(column).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))


def _bitmap(words: DataFrame) -> np.ndarray:
    """A bit per value of the lowest ``BITS`` bits of the words: at most 2^BITS values reach the driver, whatever the table's size."""
    found = np.zeros(1 << BITS, dtype=bool)
    for row in words.select(_low().alias("bit")).distinct().toLocalIterator():
        found[row.bit] = True
    return found


def _item_words(items: DataFrame) -> DataFrame:
    """(iid, ipos, word) of every item."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            each = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)]
            if each:
                place = np.concatenate([np.arange(len(e), dtype=np.int32) for e in each])
                iid = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), [len(e) for e in each])
                yield pa.RecordBatch.from_arrays([pa.array(iid), pa.array(place), pa.array(np.concatenate(each))], ["iid", "ipos", "word"])

    return items.select("iid", "hashes").mapInArrow(batches, "iid long, ipos int, word long")


def positions(docs: DataFrame, bitmap: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """(rid, doc_id, text_hash, n_words, hashes, places): the words that may be benchmark words; written once."""
    known = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap).tobytes())

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.unpackbits(np.frombuffer(known.value, np.uint8)).astype(bool)
        hashes = Hashes()
        for batch in rows:
            counts, words, places = [], [], []
            for x in batch.column(3):
                all_words = hashes.of(alnum_words(x.as_py()))
                at = np.flatnonzero(may[all_words & np.uint64((1 << BITS) - 1)])
                counts.append(len(all_words))
                words.append(all_words[at].tobytes())
                places.append(np.diff(at, prepend=0).astype(np.uint32).tobytes())  # gaps: they compress well
            arrays = [pa.array(counts, pa.int64()), pa.array(words, pa.binary()), pa.array(places, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], ["rid", "doc_id", "text_hash", "n_words", "hashes", "places"])

    named = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return cut_lineage(named.mapInArrow(batches, f"rid long, doc_id {kind}, text_hash long, n_words long, hashes binary, places binary"))


def frequencies(forward: DataFrame) -> DataFrame:
    """(word, df): in how many documents each stored word stands."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            each = [np.unique(np.frombuffer(x.as_py(), np.uint64)) for x in batch.column(0)]
            words, df = np.unique(np.concatenate(each), return_counts=True) if each else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(df.astype(np.int64))], ["word", "df"])

    return forward.select("hashes").mapInArrow(batches, "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))


def index_items(items: DataFrame, df: DataFrame) -> DataFrame:
    """(iid, item_ids, hashes, at): ``at`` are the positions that are among the rarest of some window."""

    def rarest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            chosen = []
            for counts in batch.column(3).to_pylist():
                n, found = len(counts), set()
                for start in range(max(1, n - WINDOW + 1)):
                    found.update(sorted(range(start, min(n, start + WINDOW)), key=lambda i: (counts[i], i))[:RAREST])  # noqa: B023
                chosen.append(sorted(found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(chosen, pa.list_(pa.int32()))], ["iid", "item_ids", "hashes", "at"])

    each = _item_words(items).join(df, "word", "left")
    rows = each.groupBy("iid").agg(F.array_sort(F.collect_list(F.struct("ipos", F.coalesce("df", F.lit(0)).alias("df")))).alias("w"))
    counted = items.join(rows, "iid").select("iid", "item_ids", "hashes", F.transform("w", lambda w: w["df"]).alias("dfs"))
    return cut_lineage(counted.mapInArrow(rarest, "iid long, item_ids array<string>, hashes binary, at array<int>"))


def _index_words(items: DataFrame) -> DataFrame:
    """(word, iid, ipos, least): the index positions of all items; ``least`` of them must meet in a document."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = {"word": [], "iid": [], "ipos": [], "least": []}
            for iid, hashes, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = np.frombuffer(hashes.as_py(), np.int64)
                out["word"] += words[at].tolist()
                out["iid"] += [iid] * len(at)
                out["ipos"] += at
                out["least"] += [min(RAREST, len(words))] * len(at)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("word", pa.int64()), ("iid", pa.int64()), ("ipos", pa.int32()), ("least", pa.int32())]))

    return items.select("iid", "hashes", "at").mapInArrow(batches, "word long, iid long, ipos int, least int")


def _postings(forward: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(word, rid, place): the stored places of words that may be index words."""
    known = forward.sparkSession.sparkContext.broadcast(np.packbits(bitmap).tobytes())

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.unpackbits(np.frombuffer(known.value, np.uint8)).astype(bool)
        for batch in rows:
            words, rids, places = [], [], []
            for rid, h, p in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                all_words = np.frombuffer(h.as_py(), np.uint64)
                at = np.flatnonzero(may[all_words & np.uint64((1 << BITS) - 1)])
                words.append(all_words[at])
                places.append(np.cumsum(np.frombuffer(p.as_py(), np.uint32), dtype=np.int64)[at])
                rids.append(np.full(len(at), rid, np.int64))
            if words:
                columns = [np.concatenate(words).view(np.int64), np.concatenate(rids), np.concatenate(places)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["word", "rid", "place"])

    return forward.select("rid", "hashes", "places").mapInArrow(batches, "word long, rid long, place long")


def _runs(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], equal.astype(np.int8), [0]))))
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= least]


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row: doc_id, text_hash, n_words, n_hit, spans of hit words, items (ids with exact hits) and near_items (proximity only)."""
    items = _item_rows(benchmark, item_id, item_text)
    forward = positions(docs, _bitmap(_item_words(items)), doc_id, text)
    indexed = index_items(items, frequencies(forward))
    words = cut_lineage(_index_words(indexed))
    lists = (
        _postings(forward, _bitmap(words))
        .join(words, "word")
        .groupBy("rid", "iid")
        .agg(F.collect_list(F.struct("place", "ipos")).alias("met"), F.size(F.collect_set("ipos")).alias("kinds"), F.max("least").alias("least"))
        .filter("kinds >= least")
    )
    cases = lists.join(indexed, "iid").groupBy("rid").agg(F.collect_list(F.struct("item_ids", "hashes", F.size("at").alias("n_index"), "met")).alias("cases"))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()), pa.list_(pa.string())]
        for batch in rows:
            out = []
            for n, h, p, found in zip(batch.column(3).to_pylist(), batch.column(4), batch.column(5), batch.column(6), strict=True):
                out.append(verify(n, h.as_py(), p.as_py(), found.as_py()) if found.is_valid else (0, [], [], []))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:4], *columns], ["doc_id", "text_hash", "n_words", "n_hit", "spans", "items", "near_items"])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>, near_items array<string>"
    return forward.join(cases, "rid", "left").select("rid", "doc_id", "text_hash", "n_words", "hashes", "places", "cases").mapInArrow(batches, schema)


def verify(n_words: int, hashes: bytes, places: bytes, cases: list[dict]) -> tuple[int, list[dict], list[str], list[str]]:
    """(n_hit, spans, items, near items) of one document against its candidate items, word by word."""
    words = np.zeros(n_words, dtype=np.uint64)
    at = np.cumsum(np.frombuffer(places, np.uint32), dtype=np.int64)
    stored = np.zeros(n_words, dtype=bool)
    words[at], stored[at] = np.frombuffer(hashes, np.uint64), True
    hit = np.zeros(n_words, dtype=bool)
    exact, near = set(), set()
    for case in cases:
        item = np.frombuffer(case["hashes"], np.uint64)
        window = min(WINDOW, len(item))
        place = np.array([m["place"] for m in case["met"]], dtype=np.int64)
        ipos = np.array([m["ipos"] for m in case["met"]], dtype=np.int64)
        offsets, met = np.unique(place - ipos, return_counts=True)
        found = False
        for d in offsets[met >= min(RAREST, len(item))].tolist():
            low, high = max(0, -d), min(len(item), n_words - d)
            equal = (words[d + low : d + high] == item[low:high]) & stored[d + low : d + high]
            for a, b in _runs(equal, window):
                hit[d + low + a : d + low + b] = found = True
        if found:
            exact.update(case["item_ids"])
        elif not exact.issuperset(case["item_ids"]) and _near(place, ipos, case["n_index"], len(item)):
            near.update(case["item_ids"])
    spans = [{"start": a, "end": b} for a, b in _runs(hit, 1)]
    return int(hit.sum()), spans, sorted(exact), sorted(near - exact)


def _near(place: np.ndarray, ipos: np.ndarray, n_index: int, n_item: int) -> bool:
    """Whether enough different index positions of an item are met within a stretch of ``NEAR_SLACK`` times its length."""
    need = max(RAREST, int(np.ceil(NEAR_SHARE * n_index)))
    if len(np.unique(ipos)) < need:
        return False
    order = np.argsort(place, kind="stable")
    place, ipos = place[order], ipos[order]
    inside: dict[int, int] = {}
    first = 0
    for i in range(len(place)):
        inside[int(ipos[i])] = inside.get(int(ipos[i]), 0) + 1
        while place[i] - place[first] >= NEAR_SLACK * n_item:
            inside[int(ipos[first])] -= 1
            if not inside[int(ipos[first])]:
                del inside[int(ipos[first])]
            first += 1
        if len(inside) >= need:
            return True
    return False


def contaminated(found: DataFrame):
    """At least one word is hit, and at least one word in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    found = matches(docs, benchmark)
    bad = found.filter(contaminated(found)).select("doc_id", "text_hash").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("d.text") == F.col("b.text_hash"))
    return docs.alias("d").join(bad.alias("b"), same, "left_anti")
