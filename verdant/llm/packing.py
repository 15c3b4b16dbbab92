"""Best-fit packing by length patterns fitted with non-negative least squares.

1. Texts are encoded once into pieces of at most ``CAPACITY`` tokens; only their lengths are planned with.
2. The histogram of lengths, at most ``CAPACITY`` counts, is all that reaches the driver. Patterns of one to
   three lengths that fill a sequence exactly are enumerated; non-negative least squares gives each a repeat
   count so that together they use up the histogram.
3. Counts are rounded down to what is left of each length, the longest-serving patterns first. The residual
   counts are packed by best fit: the longest length left, then exact complements or else the longest that
   fits, repeated as often as the counts allow.
4. The plan is a list of (pattern, repeats). It is turned into ranges of ranks per length, and every piece
   finds its sequence and offset from its rank among the pieces of its length. Ranks are counted per stored
   partition first and then offset, so no length, however frequent, is gathered anywhere.

The plan has some thousand rows at most, whatever the number of documents: each residual step uses up a
length, and exact patterns are at most one per repeat count kept.

Cases: NULL and empty texts are one piece, the end token alone; repeated rows and NULL ids are pieces of
their own; a text of any length is cut, its first piece taking what 1024 does not divide; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdant.session import cut_lineage

CAPACITY = 1024
END = 2
#: Parts a task remembers before it starts anew; bounds its memory, changes no result.
REMEMBERED = 800_000
ROUNDS = 400


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary's pattern never joins what stands before a blank with the blank and the word after it, so a
    text is the row of its parts cut before each such blank, and equal parts need encoding once. For the same
    reason new parts are encoded together, as one text, whose tokens are dealt out by their lengths in bytes.
    Parts of printable ASCII and line feeds are encoded by token ranks where ``merge_ranks`` finds that these say the same as the merges.
    Texts with a blank before other white space or at the end are encoded whole, and so are those that hold the
    string of a special token, which the tokenizer reads as that token wherever it stands.
    """

    _WHOLE = re.compile(r" (?=\s|\Z)")

    def __init__(self, vocabulary: str, ranks: dict[bytes, int] | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}  # part, without its blank -> ids
        self.ranked = None
        if ranks:
            import tiktoken

            self.ranked = tiktoken.Encoding("parts", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})
        tokens = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(tokens.values()) + 1, np.int64)
        for token, number in tokens.items():
            self.sizes[number] = len(token)  # one character stands for one byte

    def _encode(self, *texts: str) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        plain, other = [], []
        for p in parts:
            (plain if self.ranked and p.isascii() and p.replace("\n", "").isprintable() else other).append(p)
        for kind, encode in ((plain, lambda t: np.array(self.ranked.encode_ordinary(t), dtype="<u4")), (other, lambda t: self._encode(t)[0])):
            for low in range(0, len(kind), 4000):
                block = kind[low : low + 4000]
                ids = encode("".join([" " + p for p in block]))
                ends = np.cumsum([1 + len(p.encode()) for p in block])
                cut = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
                raw, first = ids.tobytes(), 0
                for part, after in zip(block, (4 * cut).tolist(), strict=True):
                    self.known[part] = raw[first:after]
                    first = after

    def ids(self, texts: list[str]) -> list[bytes]:
        whole = [self._WHOLE.search(t) is not None or any(s in t for s in self.special) for t in texts]
        out = [e.tobytes() for e in self._encode(*[t for t, w in zip(texts, whole, strict=True) if w])]
        split = self._joined([t for t, w in zip(texts, whole, strict=True) if not w])
        out.reverse()
        split.reverse()
        return [(out if w else split).pop() for w in whole]

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Ids of the texts from those of their parts: different parts are looked up, their ids then gathered by number."""
        if not texts:
            return []
        if len(self.known) > REMEMBERED:
            self.known.clear()
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        each = parts.flatten().dictionary_encode()
        different = each.dictionary.to_pylist()
        self._learn([p for p in different if p not in self.known])
        ends = np.cumsum(pc.list_value_length(parts).to_numpy())
        first = np.concatenate([[0], ends[:-1]])
        held = [*map(self.known.__getitem__, different), *(e.tobytes() for e in self._encode(*[different[i] for i in each.indices.take(pa.array(first)).to_pylist()]))]
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        number = each.indices.to_numpy().astype(np.int64)
        number[first] = len(different) + np.arange(len(texts))  # a first part has no blank before it, so its ids are its own
        many = sizes[number]
        upto = np.cumsum(many)
        starts = (np.cumsum(sizes) - sizes)[number] - (upto - many)
        raw = np.frombuffer(b"".join(held), "<u4")[np.repeat(starts, many) + np.arange(upto[-1])].tobytes()
        bounds = [0, *(4 * upto[ends - 1]).tolist()]
        return [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


#: What byte-level tokenizers of this kind cut a text into before they merge.
_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merge_ranks(vocabulary: str) -> dict[bytes, int] | None:
    """bytes -> rank of all tokens of a byte-level BPE vocabulary, or None where merging by ranks may differ from its merge list.

    Merging the adjacent pair whose whole has the lowest rank is the same as following the list if the ids follow it and
    every token, encoded alone, comes out as itself: then no two pieces that are not on the list ever meet as a token's halves.
    """
    from tokenizers import Tokenizer

    with open(vocabulary, encoding="utf-8") as file:
        given = json.load(file)
    model, before = given["model"], given["pre_tokenizer"] or {}
    options = [model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")]
    if model["type"] != "BPE" or any(options) or given["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    tokens = model["vocab"]
    merged = [tokens["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    alone = Tokenizer.from_file(vocabulary).model.tokenize
    if merged != sorted(merged) or any(len(alone(t)) != 1 for t in tokens):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {bytes(byte[c] for c in t): i for t, i in tokens.items()} if all(c in byte for t in tokens for c in t) else None


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: only the first may be shorter than the capacity."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], part, row): written once; ``ids`` are the tokens' bytes.

    ``vocabulary`` is a file of the tokenizers library that every worker can read.
    """

    ranks = docs.sparkSession.sparkContext.broadcast(merge_ranks(vocabulary))  # as many as the vocabulary has tokens

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(vocabulary, ranks.value), np.array([END], dtype="<u4").tobytes()
        for batch in rows:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                index, out, ids = [], [], []
                for i, body in enumerate(encoder.ids([x.as_py() or "" for x in part.column(1)])):
                    whole = body + end
                    for k, (start, length) in enumerate(cuts(len(whole) // 4)):
                        piece = whole[4 * start : 4 * (start + length)]
                        index.append(i)
                        out.append((k, start, length, zlib.crc32(piece)))
                        ids.append(piece)
                columns = [part.column(0).take(pa.array(index, pa.int64()))]
                columns += [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if keep_ids else []), names + ["ids"] * keep_ids)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    encoded = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, schema)
    return cut_lineage(encoded.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}))


def patterns(present: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Rows of three lengths, longest first and 0 for none, that fill a sequence; only lengths that occur."""
    lengths = np.flatnonzero(present)
    has = np.zeros(capacity + 1, dtype=bool)
    has[lengths] = True
    rows = [np.array([[capacity, 0, 0]])] if has[capacity] else []
    two = lengths[(lengths < capacity) & (2 * lengths >= capacity)]
    two = two[has[capacity - two]]
    rows.append(np.stack([two, capacity - two, 0 * two], axis=1))
    a, b = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
    c = capacity - a - b
    fits = (a >= b) & (b >= c) & (c > 0)
    a, b, c = a[fits], b[fits], c[fits]
    rows.append(np.stack([a, b, c], axis=1)[has[c]])
    return np.concatenate(rows)


def fit(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-negative repeats whose use of each length is nearest to the counts, by accelerated projected gradient.

    A pattern's column holds how often it uses a length; the step follows from the largest row and column sums.
    """
    size = len(counts)

    def used(x: np.ndarray) -> np.ndarray:
        total = np.zeros(size)
        for k in range(rows.shape[1]):
            total += np.bincount(rows[:, k], weights=x, minlength=size)
        total[0] = 0
        return total

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[rows].sum(axis=1)

    weight = used(np.ones(len(rows)))
    scale = 1 / np.maximum(back(weight), 1)  # one step length per pattern: the sum of its row of A'A
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(ROUNDS):
        nearer = np.maximum(y - scale * back(used(y) - counts), 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = nearer + (before - 1) / t * (nearer - x)
        x = nearer
    return x


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths, repeats) that use every count exactly; ``counts[n]`` pieces have length ``n``."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []

    def take(lengths: list[int], most: int | None = None) -> None:
        kinds, many = np.unique(lengths, return_counts=True)
        repeats = int((left[kinds] // many).min())
        repeats = repeats if most is None else min(repeats, most)
        if repeats > 0:
            left[kinds] -= many * repeats
            out.append((list(lengths), repeats))

    if left[capacity]:
        take([capacity])
    rows = patterns(left > 0, capacity)
    if len(rows):
        repeats = fit(rows, left.astype(float))
        for i in np.argsort(-repeats, kind="stable"):
            if repeats[i] < 1:
                break
            take([n for n in rows[i].tolist() if n], int(repeats[i]))
    while left.any():
        lengths = [int(np.flatnonzero(left)[-1])]
        left[lengths[0]] -= 1
        room = capacity - lengths[0]
        while room:
            fits = np.flatnonzero(left[: room + 1])
            if not len(fits):
                break
            chosen = [int(fits[-1])]
            if chosen[0] < room:  # two that fill the room exactly are better than the longest alone
                other = room - fits
                pair = fits[(other > 0) & (left[other] > (other == fits)) & (2 * fits >= room)]
                if len(pair):
                    chosen = [int(pair[-1]), room - int(pair[-1])]
            for n in chosen:
                left[n] -= 1
                room -= n
            lengths += chosen
        np.add.at(left, lengths, 1)
        take(lengths)
    return out


def ranges(steps: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank: which ranks of a length go where."""
    out, rank, sequence = [], {}, 0
    for lengths, repeats in steps:
        offset = 0
        for n in lengths:
            out.append((n, rank.get(n, 0), sequence, offset))
            rank[n] = rank.get(n, 0) + repeats
            offset += n
        sequence += repeats
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 4)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    where = cut.sparkSession.sparkContext.broadcast(ranges(plan(counts, capacity)))
    # Rank within a length: the pieces of it in earlier parts, and those before it in its own part.
    per_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    local = cut.withColumn("rank", F.row_number().over(W.partitionBy("length", "part").orderBy("row")) - 1)
    ranked = local.join(per_part.select("length", "part", earlier.alias("earlier")), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    names = [c for c in cut.columns if c not in ("part", "row")]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = where.value
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in rows:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            placed = [pa.array(table[at, 2] + rank - table[at, 1], pa.int64()), pa.array(table[at, 3], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + placed, [*names, "sequence_id", "offset"])

    fields = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in names)
    return ranked.select(*names, "rank").mapInArrow(batches, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed token ids, from pieces cut with ``keep_ids``; at most ``CAPACITY`` per row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
