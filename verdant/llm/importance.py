"""Importance resampling towards a target distribution, on hashed word n-grams with prefix-CRC substrings.

1. Each text is scanned once: its words, joined by single blanks, give a running CRC-32, stored before and
   after every word. The CRC of any n-gram follows from two of these prefixes: appending L bytes to a
   prefix multiplies its CRC by x^(8L) over GF(2), so crc(gram) = crc(up to its end) xor shift(crc(up to its
   start), L). The shift is a product of precomputed operators, one per bit of L, applied to whole batches.
2. The buckets (CRC modulo ``buckets``) of every document are written once; both counting and scoring read them.
3. Bucket counts are added up inside tasks; at most ``buckets`` sums per corpus reach the driver, which
   turns them into one gain per bucket. A document's weight is the sum of the gains of its features.
4. Gumbel noise from a digest of the id makes the highest scores a draw without replacement in proportion
   to the weights. Scores are ranked over ranges (see ``_rank``), so no task sees more than its range.

Gains and noise are whole thousandths, as the logarithms are floored; all sums are exact.

Cases: NULL, empty and wordless texts have no features and weight 0; repeated rows are judged row by row,
equal scores go by id, and rows equal in both by chance; a NULL id draws its noise as an empty one and
sorts first; an empty corpus gives an empty result, an empty target a count of 0 in every bucket; texts of
any length are scanned whole, their features cut into blocks; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm._rank import numbered
from verdant.llm._words import alnum_words
from verdant.session import cut_lineage

POLYNOMIAL = 0xEDB88320
#: Words whose n-grams are hashed together; bounds the memory of a task beside the text itself.
BLOCK = 1 << 18


@lru_cache(1)
def shifts() -> list[np.ndarray]:
    """Operator ``b`` (4 x 256, one row per byte of a CRC) multiplies by x^(8 * 2^b): it appends 2^b zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, byte >> 1 ^ np.uint32(POLYNOMIAL), byte >> 1)
    rows = [byte, *(np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(3))]
    found = [np.stack(rows)]
    while len(found) < 40:  # 2^40 bytes are more than a text can have
        found.append(np.stack([_apply(found[-1], row) for row in found[-1]]))
    return found


def _apply(operator: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return operator[0][crc & 255] ^ operator[1][crc >> 8 & 255] ^ operator[2][crc >> 16 & 255] ^ operator[3][crc >> 24]


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs (uint32) after ``lengths`` further zero bytes, without the conditioning of a message's start and end."""
    out, bit = crc.copy(), 0
    while len(lengths) and int(lengths.max()) >> bit:
        at = np.flatnonzero(lengths >> bit & 1)
        out[at] = _apply(shifts()[bit], out[at])
        bit += 1
    return out


def prefixes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(CRC before, CRC after, place before, place after) of every word of the text that joins them with blanks."""
    after = np.fromiter(accumulate(map(b" ".__add__, words[1:]), lambda crc, word: crc32(word, crc), initial=crc32(words[0])), np.uint32, len(words))
    # crc32 inverts its register at both ends; one more byte is one step of the inverted register.
    register = ~after[:-1]
    before = np.concatenate([np.zeros(1, np.uint32), ~(shifts()[0][0][(register ^ 32) & 255] ^ register >> 8)])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return before, after, np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1]), ends


def gram_crcs(words: list[bytes], least: int = 1, most: int = 1) -> Iterator[np.ndarray]:
    """CRC-32 of every run of ``least`` to ``most`` words joined by blanks, in blocks, each from two prefixes."""
    if not words:
        return
    before, after, start, end = prefixes(words)
    for n in range(least, min(most, len(words)) + 1):
        for low in range(0, len(words) - n + 1, BLOCK):
            high = min(low + BLOCK, len(words) - n + 1)
            yield after[low + n - 1 : high + n - 1] ^ shifted(before[low:high], end[low + n - 1 : high + n - 1] - start[low:high])


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 1, most: int = 1, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_words, n_features, buckets): the bucket of every feature as little-endian integers; written once."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                n_words, n_features, found = [], [], []
                for x in part.column(1):
                    words = alnum_words(x.as_py())
                    hashed = b"".join([(crc % np.uint32(buckets)).astype(kind).tobytes() for crc in gram_crcs(words, least, most)])
                    n_words.append(len(words))
                    n_features.append(len(hashed) // kind.itemsize)
                    found.append(hashed)
                arrays = [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_features", "buckets"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return cut_lineage(given.mapInArrow(batches, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, n_features long, buckets binary"))


def bucket_counts(hashed: DataFrame, buckets: int = 10_000) -> list[int]:
    """Features per bucket over the whole table; at most ``buckets`` rows per task are exchanged."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in rows:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), kind), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], ["bucket", "n"])

    out = [0] * buckets
    for row in hashed.select("buckets").mapInArrow(batches, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the smoothed log ratio of target to corpus, per bucket, floored."""
    k = len(corpus)
    total, wanted = float(sum(corpus) + k), float(sum(target) + k)
    return np.array([math.floor(1000 * math.log((t + 1.0) * total / ((s + 1.0) * wanted))) for s, t in zip(corpus, target, strict=True)], np.int64)


def weights(hashed: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight)."""
    kind = np.dtype("<u2" if len(gain) <= 1 << 16 else "<u4")
    sent = hashed.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            weight = [int(sent.value[np.frombuffer(x.as_py(), kind)].sum()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    kind_of_id = hashed.schema["doc_id"].dataType.simpleString()
    return hashed.mapInArrow(batches, f"doc_id {kind_of_id}, n_words long, n_features long, weight long")


def noise(doc_id, seed: int = 2024):
    """Thousandths of Gumbel noise, floored, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    least: int = 1,
    most: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    min_words: int = 20,
    percent: int = 10,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): ``rank`` 1, 2, … for the drawn ``percent`` of documents with ``min_words``, else NULL."""
    hashed = features(docs, doc_id, text, least, most, buckets)
    aim = features(target.select(F.lit(0).alias("doc_id"), F.col(target_text).alias("text")), least=least, most=most, buckets=buckets)
    weighed = weights(hashed, gains(bucket_counts(hashed, buckets), bucket_counts(aim, buckets)))
    scored = cut_lineage(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = F.col("n_words") >= min_words
    drawn = scored.filter(able).count() * percent // 100
    ranked = numbered(scored.filter(able), F.desc("score"), F.asc("doc_id"), name="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    return ranked.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
