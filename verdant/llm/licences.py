"""Licence scans by a positional rare-token index, in DataFrame functions only.

1. Every text is cut into words once. Its licence words – words of any template – are stored with
   their positions; that table is a small part of the texts and all later steps read it alone.
2. Document frequencies of the licence words give each template its anchor: the rarest word (highest
   IDF) of its mandatory phrase. A template is posted under its anchor only.
3. A file looks up its anchors. Each hit is a candidate (template, start); the other template words
   are looked up at ``start`` plus their own position, which intersects the postings.
4. A candidate holds where every word of the mandatory phrase stands at its place and enough of the
   template's words do.

As an anchor belongs to its mandatory phrase, no place of a phrase can be missed, however frequent the
anchor is. Template tables have a fixed size; nothing else is broadcast.

Cases: NULL text counts as empty (no words, NULL places, empty labels, score 0); repeated rows and NULL
ids are judged row by row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``phrase`` (words ``first`` .. of ``text``) must stand whole; ``need`` percent of all words at their places."""

    label: str
    text: str
    phrase: str
    base: bool = False
    need: int = 100


# Names and notice sentences of public licences.
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", base=True),
    Template("gpl", "general public license", "general public license", base=True),
    Template("reserved", "all rights reserved", "all rights reserved", base=True),
    Template("apache-2.0", "apache license version 2 0", "apache license version 2"),
    Template("mit", "mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "any person obtaining", need=80),
    Template("bsd", "bsd license", "bsd license"),
    Template("bsd", "redistribution and use in source and binary forms", "source and binary forms", need=80),
    Template("cc-by-nc", "cc by nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd", "cc by nd"),
    Template("cc0", "cc0", "cc0"),
    Template("creative-commons", "creative commons", "creative commons"),
    Template("gpl-2.0", "general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "general public license version 3", "general public license version 3"),
    Template("agpl", "affero general public license", "affero general public license"),
    Template("lgpl", "lesser general public license", "lesser general public license"),
    Template("mpl", "mozilla public license", "mozilla public license"),
    Template("epl", "eclipse public license", "eclipse public license"),
    Template("isc", "isc license", "isc license"),
    Template("unlicense", "free and unencumbered software released into the public domain", "unencumbered software released", need=80),
    Template("public-domain", "public domain", "public domain"),
)


def word_rows(templates: tuple[Template, ...] = TEMPLATES) -> list[tuple]:
    """(tid, label, base, need, n, tpos, word, must) per template word."""
    rows = []
    for tid, t in enumerate(templates):
        words, phrase = t.text.split(), t.phrase.split()
        first = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        rows += [(tid, t.label, t.base, t.need, len(words), i, w, first <= i < first + len(phrase)) for i, w in enumerate(words)]
    return rows


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(WORD), 0)


def postings(docs: DataFrame, templates: tuple[Template, ...], doc_id: str, text: str) -> DataFrame:
    """(rid, doc_id, n_words, hits): per row its licence words with their positions; written once."""
    known = sorted({w for t in templates for w in t.text.split()})
    cut = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
    placed = F.transform("words", lambda w, i: F.when(w.isin(known), F.struct(w.alias("word"), i.cast("long").alias("pos"))))
    return cut_lineage(
        cut.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("words").cast("long").alias("n_words"), F.array_compact(placed).alias("hits")
        )
    )


def anchors(index: DataFrame, template_words: DataFrame) -> DataFrame:
    """(tid, word, tpos): per template the word of its mandatory phrase in the fewest documents, the first of equals."""
    df = index.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    ranked = template_words.filter("must").join(df, "word", "left")
    return ranked.groupBy("tid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "tpos", "word")).alias("a")).select("tid", "a.word", "a.tpos")


def matches(index: DataFrame, spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(rid, tid, label, base, start, part, found) per candidate: the part of the template's words in place, and whether it holds."""
    schema = "tid int, label string, base boolean, need int, n int, tpos int, word string, must boolean"
    template_words = spark.createDataFrame(word_rows(templates), schema)
    single = index.filter(F.size("hits") > 0).select("rid", F.explode("hits").alias("h")).select("rid", "h.word", "h.pos")
    # A document keeps the words of templates whose anchor it has; all its candidates follow from the anchors.
    tops = F.broadcast(anchors(index, template_words))
    starts = single.join(tops, "word").select("rid", "tid", (F.col("pos") - F.col("tpos")).alias("start"))
    wanted = starts.join(F.broadcast(template_words), "tid").withColumn("pos", F.col("start") + F.col("tpos"))
    there = wanted.join(single.withColumn("there", F.lit(1)), ["rid", "word", "pos"], "left")
    return (
        there.groupBy("rid", "tid", "label", "base", "need", "n", "start")
        .agg(F.sum(F.coalesce("there", F.lit(0))).alias("k"), F.min(F.when(F.col("must"), F.coalesce("there", F.lit(0)))).alias("whole"))
        .select(
            "rid", "tid", "label", "base", "start", (F.col("k") / F.col("n")).alias("part"), ((F.col("whole") == 1) & (100 * F.col("k") >= F.col("need") * F.col("n"))).alias("found")
        )
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document row: its words, the places of base phrases, the labels found and the best matched part."""
    index = postings(docs, templates, doc_id, text)
    base = F.col("found") & F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  at most one entry per template
    per_row = (
        matches(index, docs.sparkSession, templates)
        .groupBy("rid")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined(F.when(F.col("found"), F.col("label"))).alias("labels"),
            F.max("part").alias("score"),
        )
    )
    return index.select("rid", "doc_id", "n_words").join(per_row, "rid", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
