"""Exact top-k search by inner product, pruned with multi-resolution segment statistics.

A vector's components become whole numbers, floor(scale * x). Cut into segments of length l with mean m and
deviation s, two vectors are at least sqrt(sum l ((m - m')^2 + (s - s')^2)) apart, which is the same as saying
that their inner product is at most sum l (m m' + s s'). More segments give a closer bound.

1. Of equal vectors the k + 1 smallest ids are candidates; the others rank behind them for every query. Equal
   queries are asked once, for k + 1 rows; each leaves out its own row when the answers are dealt out.
2. Candidates are dealt into ranges of the bit-interleaved means of their first segments and packed into blocks
   of at most ``ROWS`` rows. A block carries an envelope: the least and largest mean and the largest
   deviation of each segment. Queries stay in the block they lie in and are scored against its rows first, which
   gives each a threshold no answer may fall below.
3. Each block of queries meets all envelopes, in slabs of ``SLAB``. A query goes to a block only where the
   envelope's bound reaches its threshold.
4. In a block the bounds are taken with 1, 2, 4, … segments. Row and query pairs that fall below the
   threshold at any level are out; survivors are scored exactly. Each block returns at most k + 1 rows a query.

Bounds are rounded up by more than their error in floating point, so that no pair is lost. Products are
exact: in doubles while all sums stay below 2^53, else in Python's integers, cut at the limits of a long before they are ranked.
No pair of rows is ever a row of a table; what waits for a block comes in groups of some ``GROUP`` query blocks.

Cases: NULL vectors, vectors with components that are NULL or not finite (also when scaled), and rows with a NULL
id take no part. Vectors are compared with those of their own length only. A repeated row is a row: its copies are
candidates of each other, and each copy of a query has its own answer. Ties go to the smaller id, then to
either row. A query with fewer than k candidates gets them all. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdant.session import cut_lineage

ROWS = 4096
SLAB = 8192
GROUP = 64
COARSE = 8
FEW = 0.2
CHUNK = 256
EXACT = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)


def _starts(dim: int, segments: int) -> np.ndarray:
    return np.arange(min(segments, dim)) * dim // min(segments, dim) if dim else np.zeros(0, np.int64)


def levels(dim: int) -> list[np.ndarray]:
    """Starts of the segments of every resolution: 1, 2, 4, … as long as segments have two components."""
    out, n = [], 1
    while 2 * n <= dim:
        out.append(_starts(dim, n))
        n *= 2
    return out


def statistics(vectors: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of sqrt(l) m and sqrt(l) s per segment: their inner product bounds that of the vectors."""
    if not len(starts):
        return np.zeros((len(vectors), 0))
    length = np.diff(np.append(starts, vectors.shape[1])).astype(float)
    mean = np.add.reduceat(vectors, starts, axis=1) / length
    off = vectors - np.repeat(mean, length.astype(int), axis=1)
    return np.concatenate([mean * np.sqrt(length), np.sqrt(np.add.reduceat(off * off, starts, axis=1))], axis=1)


def _slack(a: np.ndarray, b: np.ndarray) -> float:
    """More than the error of a bound between any rows of the two."""
    norms = [np.sqrt((x * x).sum(axis=1).max()) if x.size else 0.0 for x in (a, b)]
    return 1e-9 * float(norms[0] * norms[1]) + 1e-6


def _products(a: np.ndarray, b: np.ndarray, plain: bool) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``b``: doubles where these are exact, else Python's integers."""
    if plain:
        return a @ b.T
    whole = [np.array([[int(x) for x in row] for row in m], dtype=object) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, *_LONG)


def best(queries: np.ndarray, bars: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query (rows, scores) of its k best rows among those that reach its bar."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    steps = levels(vectors.shape[1])
    stats = [statistics(vectors, s) for s in steps]
    plain = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * vectors.shape[1] < EXACT
    for low in range(0, len(queries), CHUNK):
        q, bar = queries[low : low + CHUNK], bars[low : low + CHUNK]
        who, row = None, None  # surviving pairs, once they are few enough to list
        for starts, there in zip(steps, stats, strict=True):
            here = statistics(q, starts)
            slack = _slack(here, there)
            if who is None:
                alive = ~(here @ there.T + slack < bar[:, None])  # an overflow to NaN keeps the pair
                if alive.mean() < FEW:
                    who, row = np.nonzero(alive)
            else:
                stay = ~(np.einsum("ij,ij->i", here[who], there[row]) + slack < bar[who])
                who, row = who[stay], row[stay]
        if who is None or not plain:
            score = _products(q, vectors, plain)
            if who is None:
                who, row = np.nonzero(score >= bar[:, None])
            score = score[who, row]
        else:
            score = np.einsum("ij,ij->i", q[who], vectors[row])
        stay = (score >= bar[who]).astype(bool)
        who, row, score = who[stay], row[stay], score[stay]
        if plain:
            order = np.lexsort((ids[row], -score, who))
        else:
            order = np.array(sorted(range(len(who)), key=lambda i: (who[i], -score[i], ids[row[i]])), dtype=np.int64)  # noqa: B023
        who, row, score = who[order], row[order], score[order]
        place = np.searchsorted(who, np.arange(len(q) + 1))
        out += [(row[a : min(a + k, b)], score[a : min(a + k, b)]) for a, b in zip(place[:-1], place[1:], strict=True)]
    return out


def whole(vectors: Column | str, scale: int) -> Column:
    """floor(scale * x) of every component as a double, or NULL if any is missing or not finite."""
    scaled = F.transform(vectors, lambda x: F.lit(float(scale)) * x.cast("double"))
    good = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # FLOOR of a double is a long in Spark; beyond 2^53 a double is whole already.
    floor = F.transform(scaled, lambda x: F.when(F.abs(x) < EXACT, F.floor(F.when(F.abs(x) < EXACT, x)).cast("double")).otherwise(x))
    return F.when(good, floor)


def _key(vectors: Column, bits: int = 8) -> Column:
    """Bit-interleaved means of four segments, each squeezed into ``bits`` bits by its arcus tangent: like vectors get like keys."""
    size = F.size(vectors)
    means = []
    for i in range(4):
        a, b = F.floor(size * i / 4).cast("int"), F.floor(size * (i + 1) / 4).cast("int")
        total = F.aggregate(F.slice(vectors, a + 1, b - a), F.lit(0.0), lambda s, x: s + x)
        means.append(F.floor((F.atan(F.when(b > a, total / (16 * (b - a))).otherwise(0.0)) / 3.1416 + 0.5) * (1 << bits)).cast("long"))
    key = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for mean in means:
            key = key * 2 + F.shiftright(mean, bit).bitwiseAND(F.lit(1).cast("long"))
    return key


def _raw(values: np.ndarray) -> pa.Array:
    """One row holding the values' bytes."""
    return pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())


_BLOCK = "block long, dim int, n int, rows binary, ids binary, vectors binary, envelope binary, own binary, queries binary, bars binary"
_ASKED = "block long, dim int, own binary, queries binary, bars binary"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _packed(vectors: np.ndarray) -> bytes:
    """The vectors' bytes, in half the room where the components fit."""
    return (vectors.astype("<i4") if np.abs(vectors).max(initial=0) < 1 << 31 else np.ascontiguousarray(vectors)).tobytes()


def _matrix(raw, dim: int, n: int) -> np.ndarray:
    data = raw.as_py()
    return np.frombuffer(data, "<i4" if len(data) == 4 * n * dim else "<f8").reshape(n, dim).astype(float)


def blocks(candidates: DataFrame, k: int) -> DataFrame:
    """``candidates`` (rid, id, x, dim, key, asks) in blocks with their envelopes, queries and the queries' thresholds; written once."""

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n, dim = 0, -1

        def block() -> pa.RecordBatch:
            x, ids, asks, rids = (np.concatenate(c) for c in zip(*held, strict=True))
            queries = np.flatnonzero(asks)
            bars = np.full(len(queries), -np.inf)
            for i, (_, scores) in enumerate(best(x[queries], bars.copy(), x, ids, k)):
                if len(scores) == k and abs(scores[-1]) < EXACT:
                    bars[i] = float(scores[-1])
            seg = statistics(x, _starts(dim, COARSE))
            half = seg.shape[1] // 2
            envelope = np.concatenate([seg[:, :half].min(axis=0), seg[:, :half].max(axis=0), seg[:, half:].max(axis=0)])
            raw = [rids.tobytes(), ids.tobytes(), _packed(x), envelope.tobytes(), rids[queries].tobytes(), _packed(x[queries]), bars.tobytes()]
            arrays = [pa.array([int(rids[0])], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(x)], pa.int32()), *[pa.array([r], pa.binary()) for r in raw]]
            return pa.RecordBatch.from_arrays(arrays, _names(_BLOCK))

        for batch in rows:
            rids, ids, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "id", "asks"))
            sizes = batch.column("dim").to_numpy()
            values, ends = batch.column("x").flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            low = 0
            while low < len(ids):
                if held and (sizes[low] != dim or n == ROWS):
                    yield block()
                    held, n = [], 0
                if not held:
                    dim = int(sizes[low])
                high = low + int(np.argmax(np.append(sizes[low : low + ROWS - n], -1) != dim))
                part = values[ends[low] - dim : ends[high - 1]].reshape(high - low, dim)
                held.append((part, ids[low:high], asks[low:high], rids[low:high]))
                n, low = n + high - low, high
        if held:
            yield block()

    dealt = candidates.repartitionByRange("dim", "key", "rid").sortWithinPartitions("dim", "key", "rid")
    return cut_lineage(dealt.select("rid", "id", "x", "dim", "asks").mapInArrow(pack, _BLOCK))


def _asked(table: DataFrame) -> DataFrame:
    """A row per block of queries and block that may hold answers of some of them, with those queries."""

    def slabs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}

        def slab(dim: int) -> pa.RecordBatch:
            there, envelopes = zip(*held.pop(dim), strict=True)
            arrays = [pa.array([dim], pa.int32()), pa.array([np.array(there).tobytes()], pa.binary()), pa.array([b"".join(envelopes)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["dim", "there", "envelopes"])

        for batch in rows:
            for block, dim, envelope in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(dim, []).append((block, envelope))
                if len(held[dim]) == SLAB:
                    yield slab(dim)
        for dim in list(held):
            yield slab(dim)

    def route(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for dim, own, queries, bars, there, envelopes in zip(*batch.columns, strict=True):
                dim, own, bars, there = dim.as_py(), *(np.frombuffer(c.as_py(), t) for c, t in ((own, np.int64), (bars, float), (there, np.int64)))
                q = _matrix(queries, dim, len(own))
                seg = statistics(q, _starts(dim, COARSE))
                half = seg.shape[1] // 2
                lows, highs, deviations = np.frombuffer(envelopes.as_py(), float).reshape(len(there), 3, half).transpose(1, 0, 2)
                mean, deviation = seg[:, :half], seg[:, half:]
                # A query's mean meets the largest mean of the block where it is positive and the least where it is negative.
                bound = np.maximum(mean, 0) @ highs.T + np.minimum(mean, 0) @ lows.T + deviation @ deviations.T
                reach = ~(bound + _slack(seg, np.concatenate([np.maximum(np.abs(lows), np.abs(highs)), deviations], axis=1)) < bars[:, None])
                out = []
                for i in np.flatnonzero(reach.any(axis=0)):
                    at = np.flatnonzero(reach[:, i])
                    out.append((int(there[i]), dim, own[at].tobytes(), _packed(q[at]), bars[at].tobytes()))
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], _names(_ASKED))

    envelopes = table.select("block", "dim", "envelope").coalesce(8).mapInArrow(slabs, "dim int, there binary, envelopes binary")
    asking = table.filter(F.length("own") > 0).select("dim", "own", "queries", "bars")
    meeting = asking.join(cut_lineage(envelopes), "dim")
    return meeting.select("dim", "own", "queries", "bars", "there", "envelopes").mapInArrow(route, _ASKED)


def _answers(table: DataFrame, k: int) -> DataFrame:
    """(own, row, vec_id, score): of every block a query was sent to, its k best rows; ``own`` and ``row`` are row numbers."""

    def answer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for dim, n, rids, ids, x, waiting in zip(*batch.columns, strict=True):
                dim, n = dim.as_py(), n.as_py()
                rids, ids, x = np.frombuffer(rids.as_py(), np.int64), np.frombuffer(ids.as_py(), np.int64), _matrix(x, dim, n)
                for group in waiting:
                    own, bars = np.frombuffer(group["own"].as_py(), np.int64), np.frombuffer(group["bars"].as_py(), float)
                    found = best(_matrix(group["queries"], dim, len(own)), bars, x, ids, k)
                    at = np.concatenate([rows for rows, _ in found])
                    arrays = [np.repeat(own, [len(rows) for rows, _ in found]), rids[at], ids[at]]
                    scores = pa.array([int(s) for _, scores in found for s in scores], pa.int64())
                    yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), scores], ["own", "row", "vec_id", "score"])

    groups = -(-table.filter(F.length("own") > 0).count() // GROUP)
    waiting = _asked(table).withColumn("salt", F.pmod(F.xxhash64("own"), F.lit(max(1, groups))))
    waiting = waiting.groupBy("block", "salt").agg(F.collect_list(F.struct("own", "queries", "bars")).alias("waiting"))
    meeting = waiting.join(table.select("block", "dim", "n", "rows", "ids", "vectors"), "block")
    found = meeting.select("dim", "n", "rows", "ids", "vectors", "waiting").mapInArrow(answer, "own long, row long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("own").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def search(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``is_query`` its ``k`` highest inner products with all other rows."""
    named = vectors.select(F.col(vec_id).cast("long").alias("id"), whole(embedding, scale).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    given = cut_lineage(named.filter("id IS NOT NULL AND x IS NOT NULL").withColumn("rid", F.monotonically_increasing_id()))
    copy = F.row_number().over(W.partitionBy("x").orderBy("id", "rid"))
    first = given.withColumn("copy", copy).filter(F.col("copy") <= k + 1)
    asked = given.filter("asks").select("x").distinct().withColumn("wanted", F.lit(True))
    first = first.drop("asks").join(asked, "x", "left").withColumn("asks", F.coalesce(F.col("wanted") & (F.col("copy") == 1), F.lit(False)))
    candidates = cut_lineage(first.select("rid", "id", "x", F.size("x").alias("dim"), _key(F.col("x")).alias("key"), "asks"))
    found = _answers(blocks(candidates, k + 1), k + 1)
    queries = given.filter("asks").select("x", F.col("rid").alias("self"), F.col("id").alias("query_id"))
    queries = queries.join(candidates.filter("asks").select("x", F.col("rid").alias("own")), "x").drop("x")
    place = F.row_number().over(W.partitionBy("self").orderBy(F.desc("score"), "vec_id", "row"))
    dealt = queries.join(found, "own").filter(F.col("row") != F.col("self")).withColumn("rank", place)
    return dealt.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
