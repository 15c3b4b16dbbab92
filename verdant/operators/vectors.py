"""Q2: exact vector search over blocks of the corpus, with blocks skipped by the triangle inequality.

The corpus is packed where it lies: the rows of a batch are grouped by the nearest of some pivots taken from it, and
a group becomes a block with its pivot, its least and largest distance from it, and its largest norm. A query at distance
d from the pivot is at least max(0, d - largest, least - d) away from all rows of the block, which bounds its dot
products with them. Queries are a table of packed blocks as well: they meet the blocks of the corpus in a join, which Spark
broadcasts while they are few, and never pass through the driver. The corpus is read once whatever their number.

A task keeps the best ``k`` rows per query while it reads and leaves out queries whose bound stays below their
k-th score so far. Only ``k`` rows per query and task are ranked at the end.

Vectors are compared with those of their own length. Rows whose vector is NULL, empty or holds a NULL are left out;
``unusable`` lists them, and those of another length than the one asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.operators.store import newest
from verdant.session import cut_lineage

QUERY_BLOCK = 512
PIVOTS = 16
#: Query blocks a task keeps lists for at once; beyond it the lists so far are handed on.
HELD = 32
DIGITS = 9  # scores that agree to nine digits count as equal and go by id

_BLOCK = "dim int, ids binary, vectors binary, pivot binary, nearest double, farthest double, norm double"
_ASKED = "asked long, dim int, names binary, queries binary"


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the ``k`` highest scores of every row, ties by id."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        least = np.full(len(scores), -np.inf)
    row, column = np.nonzero(scores >= least[:, None])  # more than k only where scores are equal
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, column = row[place < k], column[place < k]
    return row, ids[column], scores[row, column]


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, ids, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], ids[first], score[first]


def _bars(best: tuple[np.ndarray, np.ndarray, np.ndarray], bars: np.ndarray, k: int) -> None:
    """Sets the k-th score of every query that has ``k`` rows."""
    owner, many = np.unique(best[0], return_counts=True)
    last = np.cumsum(many) - 1
    bars[owner[many == k]] = best[2][last[many == k]]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for every length of vector in the batch."""
    lengths = batch.column(column).value_lengths().to_numpy()
    values, ends = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lengths)
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        yield rows, values[(ends[rows] - dim)[:, None] + np.arange(dim)]


def _usable(column: str):
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, lambda x: x.isNull())


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` from all rows of ``b``."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def blocks(corpus: DataFrame) -> DataFrame:
    """The corpus (chunk_id BIGINT, embedding) in blocks around pivots, stored; may be passed to any number of searches."""

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids = batch.column(0).to_numpy()
            for at, matrix in _by_length(batch, 1):
                pivots = matrix[:: max(1, len(matrix) // PIVOTS)][:PIVOTS]
                apart = _apart(matrix, pivots)
                group = apart.argmin(axis=1)
                for g in np.unique(group).tolist():
                    members = np.flatnonzero(group == g)
                    part, distance = matrix[members], apart[members, g]
                    ends = (float(distance.min()), float(distance.max()), float(np.sqrt((part * part).sum(axis=1).max())))
                    raw = [ids[at[members]].astype(np.int64).tobytes(), part.tobytes(), pivots[g].tobytes()]
                    arrays = [pa.array([matrix.shape[1]], pa.int32()), *[pa.array([r], pa.binary()) for r in raw], *[pa.array([e]) for e in ends]]
                    yield pa.RecordBatch.from_arrays(arrays, _names(_BLOCK))

    return cut_lineage(corpus.filter(_usable("embedding")).select(F.col("chunk_id").cast("long"), "embedding").mapInArrow(pack, _BLOCK))


def _asked(queries: DataFrame) -> DataFrame:
    """The queries in blocks of one length of vector, stored."""

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for low in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(low, QUERY_BLOCK)
                numbers, names = part.column(0).to_numpy(), part.column(1).to_numpy()
                for at, matrix in _by_length(part, 2):
                    arrays = [pa.array([int(numbers[at[0]])], pa.int64()), pa.array([matrix.shape[1]], pa.int32())]
                    arrays += [pa.array([r], pa.binary()) for r in (names[at].astype(np.int64).tobytes(), matrix.tobytes())]
                    yield pa.RecordBatch.from_arrays(arrays, _names(_ASKED))

    given = queries.filter(_usable("embedding") & F.col("query_id").isNotNull())
    given = given.select(F.monotonically_increasing_id().alias("number"), F.col("query_id").cast("long"), "embedding")
    return cut_lineage(given.mapInArrow(pack, _ASKED))


def _reach(queries: np.ndarray, pivot: np.ndarray, least: float, most: float, norm: float) -> np.ndarray:
    """What no dot product of a query with a row of the block exceeds, rounded up by more than its error."""
    square = (queries * queries).sum(axis=1)
    apart = _apart(queries, pivot[None, :])[:, 0]
    slack = 1e-7 * (np.sqrt(square) + norm + np.sqrt((pivot * pivot).sum())) + 1e-12  # of a distance: half the digits of its square
    gap = np.maximum(np.maximum(apart - most, least - apart) - 2 * slack, 0)
    bound = np.minimum((square + norm * norm - gap * gap) / 2, np.sqrt(square) * norm)
    return bound + 1e-12 * (square + norm * norm) + 10.0**-DIGITS


def nearest(queries: DataFrame, corpus: DataFrame, k: int, index: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` highest dot products, ties by chunk id.

    ``queries``: (query_id BIGINT, embedding); ``corpus``: (chunk_id BIGINT, embedding); ``index``: its ``blocks``, if stored already.
    """
    asked = _asked(queries)
    held = asked.select("asked", "dim").collect()  # two numbers per block of queries
    if not held:
        return queries.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double, rank int")

    def answer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, list] = {}  # block of queries -> their ids, vectors, bars and best rows so far

        def done() -> Iterator[pa.RecordBatch]:
            for names, _, _, best in lists.values():
                if best is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(names[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "chunk_id", "score"])
            lists.clear()

        for batch in rows:
            for dim, ids, vectors, pivot, least, most, norm, number, names, asked_vectors in zip(*batch.columns, strict=True):
                dim, number = dim.as_py(), number.as_py()
                if number not in lists:
                    if len(lists) == HELD:
                        yield from done()
                    named = np.frombuffer(names.as_py(), np.int64)
                    lists[number] = [named, np.frombuffer(asked_vectors.as_py()).reshape(-1, dim), np.full(len(named), -np.inf), None]
                known = lists[number]
                reach = _reach(known[1], np.frombuffer(pivot.as_py()), least.as_py(), most.as_py(), norm.as_py())
                alive = np.flatnonzero(reach >= known[2])
                if not len(alive):
                    continue
                matrix = np.frombuffer(vectors.as_py()).reshape(-1, dim)
                row, found, score = _best(np.round(known[1][alive] @ matrix.T, DIGITS), np.frombuffer(ids.as_py(), np.int64), k)
                best = (alive[row], found, score)
                known[3] = best if known[3] is None else _merged([known[3], best], k)
                _bars(known[3], known[2], k)
        yield from done()

    every = F.array(*[F.struct(F.lit(r.asked).cast("long").alias("asked"), F.lit(r.dim).alias("dim")) for r in held])
    dealt = (index if index is not None else blocks(corpus)).withColumn("asked", F.explode(F.transform(F.filter(every, lambda a: a["dim"] == F.col("dim")), lambda a: a["asked"])))
    columns = ["dim", "ids", "vectors", "pivot", "nearest", "farthest", "norm", "asked", "names", "queries"]
    meeting = dealt.join(asked.drop("dim"), "asked").select(columns)
    found = meeting.mapInArrow(answer, "query_id long, chunk_id long, score double")
    return newest(found, ["query_id"], (F.col("score").desc(), F.col("chunk_id")), k, "rank")


def unusable(corpus: DataFrame, size: int) -> DataFrame:
    """Rows without a vector of ``size`` numbers."""
    return corpus.filter(~_usable("embedding") | (F.size("embedding") != size))


def keep_rule(ranked: DataFrame, score: str, threshold: float | None, cutoff: float = K.SIMILARITY_CUTOFF) -> DataFrame:
    """Scores from the cutoff on; without an explicit threshold the best hit always stays."""
    enough = F.col(score) >= (cutoff if threshold is None else threshold)
    return ranked.filter(enough if threshold is not None else enough | (F.col("rank") == 1))


def search_naive(
    queries: DataFrame, corpus: DataFrame, top_k: int = 3, threshold: float | None = None, cutoff: float = K.SIMILARITY_CUTOFF
) -> DataFrame:
    """Q2 with the keep rule; scores rounded to 4 after the decision."""
    kept = keep_rule(nearest(queries, corpus, top_k), "score", threshold, cutoff)
    return kept.withColumn("score", F.round("score", 4))
