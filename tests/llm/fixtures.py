"""Small tables with the cases every operator has to stand: NULLs, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, start long, word string, rid long"


def docs_of(spark, texts, first=0):
    rows = [(first + i, t, "en", "src0", None if t is None else len(t), 7, "x", -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
