"""A lexical index of blocks of chunks, and ranked search that skips what cannot enter a list.

A block holds the inverted lists of at most ``CHUNKS`` chunks and, per term, its largest count and its
shortest chunk. Both bound what the term can add to any chunk of the block under every corpus average, so blocks
of an earlier batch stay as they are when chunks are added: only term frequencies and totals are summed anew.

Queries are packed as well and meet every block; no posting is shuffled. A task keeps the ``n`` best chunks
per query while it reads. Where the bounds of a query's terms in a block sum up to less than its n-th score so far,
the block's lists are not read for that query. Ties go by id, so a bound that only reaches that score is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant import constants as K
from verdant.functions import text as tx
from verdant.operators.store import newest
from verdant.operators.vectors import DIGITS, _best, _merged
from verdant.session import cut_lineage

CHUNKS = 1024
QUERIES = 512
#: Query blocks a task keeps lists for at once; beyond it the lists so far are handed on.
HELD = 32

_BLOCK = "ids binary, lengths binary, terms array<string>, starts binary, members binary, counts binary, most binary, shortest binary, held array<int>"
_ASKED = "asked long, names binary, terms array<string>, owners binary, weights binary"


class Corpus(NamedTuple):
    """Stored batches of chunks with what scoring needs to know about the whole."""

    tokens: DataFrame  # chunk_id, tokens, length
    blocks: DataFrame
    counts: DataFrame  # term, df per batch
    totals: DataFrame  # n, total length per batch

    @property
    def chunks(self) -> DataFrame:
        return self.tokens.select("chunk_id")

    @property
    def frequencies(self) -> DataFrame:
        """(term, df, idf) over all batches; N is a one-row aggregate used as a scalar subquery."""
        df = F.col("df").cast("double")
        n = self.totals.agg(F.sum("n").cast("double").alias("n")).scalar()
        found = self.counts.groupBy("term").agg(F.sum("df").alias("df")).withColumn("_n", n)
        return found.select("term", "df", F.log((F.col("_n") - df + 0.5) / (df + 0.5) + 1.0).alias("idf"))

    @property
    def mean_length(self) -> float:
        row = self.totals.agg(F.sum("total") / F.sum("n")).first()
        return float(row[0] or 1.0)


def _blocks(tokens: DataFrame) -> DataFrame:
    """Blocks of the chunks of each partition."""

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for low in range(0, batch.num_rows, CHUNKS):
                part = batch.slice(low, CHUNKS)
                lengths = part.column(1).value_lengths().to_numpy().astype(np.int64)
                flat = part.column(1).flatten().dictionary_encode()
                code, chunk = flat.indices.to_numpy().astype(np.int64), np.repeat(np.arange(part.num_rows), lengths)
                pairs, tf = np.unique(code * CHUNKS + chunk, return_counts=True)
                term, member = pairs // CHUNKS, pairs % CHUNKS
                starts = np.searchsorted(term, np.arange(len(flat.dictionary) + 1))
                most, shortest = (f.reduceat(v, starts[:-1]) if len(term) else v for f, v in ((np.maximum, tf), (np.minimum, lengths[member])))
                kinds = ((part.column(0).to_numpy(), "<i8"), (lengths, "<i4"), None, (starts, "<i4"), (member, "<u2"), (tf, "<i4"), (most, "<i4"), (shortest, "<i4"))
                held = pa.array([np.diff(starts)], pa.list_(pa.int32()))
                arrays = [pa.array([flat.dictionary.to_pylist()], pa.list_(pa.string())) if k is None else pa.array([np.asarray(k[0]).astype(k[1]).tobytes()], pa.binary()) for k in kinds]
                yield pa.RecordBatch.from_arrays([*arrays, held], [c.split()[0] for c in _BLOCK.split(", ")])

    return cut_lineage(tokens.select("chunk_id", "tokens").mapInArrow(pack, _BLOCK))


def corpus_statistics(chunks: DataFrame, text: str = "text") -> Corpus:
    """The index of one batch of chunks (chunk_id, ``text``)."""
    tokens = cut_lineage(chunks.select(F.col("chunk_id").cast("long"), tx.tokens(F.col(text)).alias("tokens")).withColumn("length", F.size("tokens")))
    blocks = _blocks(tokens)
    # a block knows in how many of its chunks each of its terms stands
    counts = blocks.select(F.inline(F.arrays_zip("terms", "held"))).groupBy(F.col("terms").alias("term")).agg(F.sum("held").alias("df"))
    totals = tokens.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"))
    return Corpus(tokens, blocks, cut_lineage(counts), cut_lineage(totals))


def added(corpus: Corpus, chunks: DataFrame, text: str = "text") -> Corpus:
    """The corpus with a further batch of chunks with new ids; nothing stored before is read or written."""
    return Corpus(*[old.unionByName(new) for old, new in zip(corpus, corpus_statistics(chunks, text), strict=True)])


def bm25_scores(queries: DataFrame, corpus: Corpus, keys: list[str]) -> DataFrame:
    """Q4: (keys, chunk_id, score) of all chunks that share a token; repeated query tokens count again."""
    asked = queries.select(*keys, F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("times"))
    counts = corpus.tokens.select("chunk_id", "length", F.explode("tokens").alias("term"))
    postings = counts.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"), F.max("length").alias("length"))
    norm = 1.0 - K.BM25_B + K.BM25_B * (F.col("length") / F.lit(corpus.mean_length))
    part = F.col("times") * F.col("idf") * (F.col("tf") * (K.BM25_K1 + 1.0) / (F.col("tf") + K.BM25_K1 * norm))
    # frequent terms make hot join keys; the sum per query and chunk is combined before it is shuffled
    scored = asked.join(corpus.frequencies.select("term", "idf"), "term").join(postings, "term").groupBy(*keys, "chunk_id").agg(F.sum(part).alias("score"))
    return scored.withColumn("score", F.round("score", DIGITS))


def _packed(weighted: DataFrame) -> DataFrame:
    """Blocks of queries (qid, terms of (term, weight)): one row per ``QUERIES`` of a partition."""

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for low in range(0, batch.num_rows, QUERIES):
                part = batch.slice(low, QUERIES)
                owner = np.repeat(np.arange(part.num_rows, dtype=np.int64), part.column(1).value_lengths().to_numpy())
                pairs = part.column(1).flatten()
                names, weights = part.column(0).to_numpy(), pairs.field("weight").to_numpy()
                arrays = [pa.array([int(names[0])], pa.int64()), pa.array([names.tobytes()], pa.binary()), pa.array([pairs.field("term").to_pylist()], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([owner.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary())], [c.split()[0] for c in _ASKED.split(", ")])

    return cut_lineage(weighted.mapInArrow(pack, _ASKED))


def _impact(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K.BM25_K1 + 1.0) / (tf + K.BM25_K1 * (1.0 - K.BM25_B + K.BM25_B * (length / mean)))


def _scored(block: dict, asked: dict, bars: np.ndarray, mean: float, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(query number, chunk id, score) of the ``n`` best chunks of the block for each query that its bound lets in."""
    where = pc.index_in(asked["terms"], value_set=block["terms"])
    here = np.flatnonzero(where.is_valid().to_numpy(zero_copy_only=False))
    term = where.take(pa.array(here)).to_numpy().astype(np.int64)
    owner, weight = asked["owners"][here], asked["weights"][here]
    bound = np.bincount(owner, weight * _impact(block["most"][term].astype(float), block["shortest"][term], mean), len(bars))
    stay = bound[owner] + 10.0**-DIGITS >= bars[owner]  # scores are rounded, and equal ones go by id
    owner, weight, term = owner[stay], weight[stay], term[stay]
    if not len(owner):
        return None
    numbers, owner = np.unique(owner, return_inverse=True)
    low, many = block["starts"][term].astype(np.int64), np.diff(block["starts"])[term]
    at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
    member = block["members"][at].astype(np.int64)
    parts = np.repeat(weight, many) * _impact(block["counts"][at].astype(float), block["lengths"][member], mean)
    size = len(block["ids"])
    scores = np.bincount(np.repeat(owner, many) * size + member, parts, len(numbers) * size).reshape(len(numbers), size)
    row, ids, score = _best(np.round(scores, DIGITS), block["ids"], n)
    found = score > 0
    return numbers[row[found]], ids[found], score[found]


def _search(asked: DataFrame, corpus: Corpus, n: int) -> DataFrame:
    """(qid, chunk_id, score): per task the ``n`` best chunks of every query."""
    names = [r.asked for r in asked.select("asked").collect()]  # one number per block of queries
    mean = corpus.mean_length

    def answer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, list] = {}  # block of queries -> their names, bars and best chunks so far

        def done() -> Iterator[pa.RecordBatch]:
            for named, _, best in lists.values():
                if best is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(named[best[0]]), pa.array(best[1]), pa.array(best[2])], ["qid", "chunk_id", "score"])
            lists.clear()

        kinds = {"ids": "<i8", "lengths": "<i4", "starts": "<i4", "members": "<u2", "counts": "<i4", "most": "<i4", "shortest": "<i4"}
        for batch in rows:
            for i in range(batch.num_rows):
                block = {c: np.frombuffer(batch.column(c)[i].as_py(), k) for c, k in kinds.items()} | {"terms": batch.column("terms")[i].values}
                query = {"terms": batch.column("words")[i].values, "owners": np.frombuffer(batch.column("owners")[i].as_py(), np.int64), "weights": np.frombuffer(batch.column("weights")[i].as_py(), float)}
                name = batch.column("asked")[i].as_py()
                if name not in lists:
                    if len(lists) == HELD:
                        yield from done()
                    named = np.frombuffer(batch.column("names")[i].as_py(), np.int64)
                    lists[name] = [named, np.full(len(named), -np.inf), None]
                held = lists[name]
                found = _scored(block, query, held[1], mean, n)
                if found is not None and len(found[0]):
                    held[2] = found if held[2] is None else _merged([held[2], found], n)
                    owner, many = np.unique(held[2][0], return_counts=True)
                    last = np.cumsum(many) - 1
                    held[1][owner[many == n]] = held[2][2][last[many == n]]
        yield from done()

    if not names:
        return asked.sparkSession.createDataFrame([], "qid long, chunk_id long, score double")
    dealt = corpus.blocks.drop("held").select("*", F.explode(F.array(*map(F.lit, names))).alias("asked"))
    meeting = dealt.join(asked.withColumnRenamed("terms", "words"), "asked")
    return meeting.mapInArrow(answer, "qid long, chunk_id long, score double")


def bm25_ranked(queries: DataFrame, corpus: Corpus, keys: list[str], n: int = K.RANKED_LIST) -> DataFrame:
    """Q4: the first ``n`` chunks per query; chunks without a match follow with score 0 in id order.

    At most ``n`` of the ``n`` lowest ids can be needed as padding, so only those are added: every
    query is paired with the numbers 1..n and these with the lowest ids, by an ordinary join.
    """
    terms = queries.select(*keys, F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("times"))
    terms = terms.join(corpus.frequencies.select("term", "idf"), "term").select(*keys, F.struct("term", (F.col("times") * F.col("idf")).alias("weight")).alias("_t"))
    # a query has as many terms as its text has words
    weighted = cut_lineage(terms.groupBy(*keys).agg(F.sort_array(F.collect_list("_t")).alias("terms")).withColumn("qid", F.monotonically_increasing_id()))
    scored = _search(_packed(weighted.select("qid", "terms")), corpus, n).join(weighted.select("qid", *keys), "qid").select(*keys, "chunk_id", "score")
    lowest = corpus.chunks.orderBy("chunk_id").limit(n).agg(F.sort_array(F.collect_list("chunk_id")).alias("ids"))
    lowest = lowest.select(F.posexplode("ids").alias("at", "chunk_id"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    padding = queries.select(*keys, numbers.alias("at")).join(lowest, "at").select(*keys, "chunk_id", F.lit(0.0).alias("score"))
    every = scored.unionByName(padding).groupBy(*keys, "chunk_id").agg(F.max("score").alias("score"))
    return newest(every, keys, (F.col("score").desc(), F.col("chunk_id")), n, "rank")
