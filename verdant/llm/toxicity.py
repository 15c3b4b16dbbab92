"""Toxicity of whole texts: a recurrent network with attention scores all overlapping windows.

Learning uses a bounded sample of the labelled documents: at most ``MARKED`` marked and ``CLEAN`` clean ones,
chosen by a hash of their id, and at most ``WINDOWS`` windows of each, evenly spread. One task trains the
network on it; the model, of fixed size, is what reaches the driver. A second bounded sample, of other
documents, fits how a document's score follows from its windows (highest, second highest and mean logit,
number of windows): a logistic regression weighted to the shares of the labels.

Scoring reads every window of every text, whole, in blocks of bounded size. Labels, language, source and id
are no inputs: the id only decides which rows may be learned from.

Cases: a NULL, empty or wordless text has no windows and gets the score of a text whose windows all look
harmless; labels that are NULL or have no document teach nothing, several labels of an id count as their
largest; of an id's several rows the smallest text teaches; without labels of both kinds every text gets the same score, below 0.5; repeated rows are scored alike; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.llm import gru
from verdant.llm._words import alnum_words

MARKED, CLEAN, WINDOWS = 3000, 3000, 6
HARMLESS = -8.0


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def words_of(text: str | None) -> list[bytes]:
    return alnum_words(text.lower()) if text else []


def _sample(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """(doc_id, label, fits): at most ``MARKED`` + ``CLEAN`` rows; a third of them fit the second step."""
    usable = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64(F.col("doc_id").cast("string")), "doc_id"]
    chosen = usable.filter("label = 1").orderBy(*order).limit(MARKED).unionAll(usable.filter("label = 0").orderBy(*order).limit(CLEAN))
    return chosen.withColumn("fits", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)), F.lit(3)) == 0)


def _shares(labels: DataFrame, doc_id: str, label: str) -> tuple[int, int]:
    row = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col(doc_id))).agg(F.count(F.when(F.col(label) == 1, 1)).alias("one"), F.count(F.when(F.col(label) == 0, 1)).alias("zero")).first()
    return row.one, row.zero


def _model(sample: DataFrame) -> bytes:
    """Trains in one task on the bounded sample."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            cuts = []
            for x in batch.column(2):
                words = words_of(x.as_py())
                starts = gru.windows(len(words))
                spread = [starts[i * len(starts) // min(WINDOWS, len(starts))] for i in range(min(WINDOWS, len(starts)))] if starts else []
                cuts.append([b" ".join(words[s : s + gru.LENGTH]) for s in spread])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cuts, pa.list_(pa.binary()))], ["name", "label", "cuts"])

    def learn(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = sorted(r for batch in rows for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        model = gru.train([([w.split(b" ") for w in cuts], label) for _, label, cuts in samples])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    named = sample.filter("NOT fits").select(F.col("doc_id").cast("string").alias("name"), "label", "text")
    trained = named.mapInArrow(cut, "name string, label int, cuts array<binary>").repartition(1).mapInArrow(learn, "model binary").collect()
    return bytes(trained[0].model) if trained else pickle.dumps(gru.new_model())


def _signs(logits: np.ndarray) -> list[float]:
    """What a document's score follows from."""
    if not len(logits):
        return [HARMLESS, HARMLESS, HARMLESS, 0.0]
    top = np.sort(logits)[-2:]
    return [float(top[-1]), float(top[0]) if len(top) > 1 else HARMLESS, float(logits.mean()), float(np.log(len(logits)))]


def fit(signs: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge; the last entry is the constant."""
    x = np.concatenate([signs / 4, np.ones((len(signs), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.diag([*[0.5] * signs.shape[1], 1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - label)) + ridge @ w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        w -= np.clip(np.linalg.solve(bend, slope), -2, 2)
    return w


def _scored(docs: DataFrame, model, columns: str, width: int, finish) -> DataFrame:
    """The first ``width`` columns of ``docs`` with ``finish`` of the signs of the text after them."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = gru.Scorer(pickle.loads(model.value))
        for batch in rows:
            signs, part, size = [], [], 0
            for x in batch.column(width):
                part.append(words_of(x.as_py()))
                size += len(part[-1])
                if size > 100_000:
                    signs += [_signs(v) for v in scorer.score(part)]
                    part, size = [], 0
            signs += [_signs(v) for v in scorer.score(part)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], finish(np.array(signs, np.float64).reshape(-1, 4))], names)

    names = [c.split(" ")[0] for c in columns.split(", ")]
    return docs.mapInArrow(batches, columns)


def learned_from(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, label, fits, text): the sample, one row per id however often the id stands in the table."""
    chosen = F.broadcast(_sample(labels, doc_id, label))  # MARKED + CLEAN rows at most
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return named.join(chosen, "doc_id").groupBy("doc_id", "label", "fits").agg(F.min("text").alias("text"))


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, score): per document row a score from 0 to 1; learned from ``labels`` (doc_id, label)."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample = learned_from(docs, labels, doc_id, text, label)
    context = docs.sparkSession.sparkContext
    model = context.broadcast(_model(sample))
    as_list = lambda signs: pa.array(signs.tolist(), pa.list_(pa.float64()))
    fitting = sample.filter("fits").select(F.col("label").cast("double").alias("label"), "text")
    rows = sorted(_scored(fitting, model, "label double, signs array<double>", 1, as_list).collect())  # MARKED + CLEAN at most
    one, zero = _shares(labels, doc_id, label)
    y = np.array([r.label for r in rows])
    weights = np.array([0.0, 0, 0, 0, -2])  # nothing learned: every text alike, and clean
    if 0 < y.sum() < len(y):
        share = np.where(y == 1, one / y.sum(), zero / (len(y) - y.sum()))
        weights = fit(np.array([r.signs for r in rows]), y, share * len(y) / share.sum())

    def chance(signs: np.ndarray) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(signs / 4 @ weights[:-1] + weights[-1], -30, 30))), pa.float64())

    kind = docs.schema[doc_id].dataType.simpleString()
    return _scored(named, model, f"doc_id {kind}, score double", 1, chance)
