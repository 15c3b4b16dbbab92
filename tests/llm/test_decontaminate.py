import random

import duckdb

from tests.llm import brute
from tests.llm.fixtures import docs_of, empty_docs
from verdant.llm import decontaminate as dc
from pyspark.sql import functions as F


def got(docs, benchmark):
    found = dc.matches(docs, benchmark).withColumn("bad", dc.contaminated(None))
    digest = F.sha2(F.array_join("items", ","), 256)
    return {r.doc_id: (r.n_words, r.n_hit, r.n, r.d, r.bad) for r in found.withColumns({"d": digest, "n": F.size("items")}).collect()}


def test_given_tables_equal_looking_up_every_window(spark):
    at = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{at}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{at}/benchmark.parquet'").fetchall()
    want = brute.contamination(docs, items)
    assert sum(w[1] > 0 for w in want.values()) > 10
    assert got(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/benchmark.parquet")) == want


def test_fixture_equals_looking_up_every_window(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice((1, 2, 12, 13, 14, 40))))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "the the the"), (33, "the of the of " * 5), (3, items[4][1]), (34, items[5][1]), (35, "É É é, X.9")]
    texts = [None, "", "!!", "the of " * 400, "the the the the", "é é É x 9", "É É é x 9", "É É É"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(6)):
            source = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(source) + 1)
            parts += rng.choices(words + ["the", "of"], k=rng.randrange(60)) + source[a : a + rng.choice((11, 12, 13, 14, 99))]
        texts.append(" , ".join(parts))
    texts.append(" ".join(rng.choices(words, k=30000)) + " " + items[9][1])
    benchmark = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, n_words int")
    assert got(docs_of(spark, texts), benchmark) == brute.contamination(list(enumerate(texts)), items)


def test_spans_and_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    words = item.split()
    loose = " ".join(w for pair in zip(words, ["x", ""] * 8) for w in pair)
    texts = [f"a b {item} c", loose, "alpha x beta y", item.replace(" ", " x y z" * 8 + " ") + " far", " ".join(reversed(words))]
    found = sorted(dc.matches(docs_of(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string")).collect(), key=lambda r: r.doc_id)
    assert [(s.start, s.end) for s in found[0].spans] == [(2, 17)] and found[0]["items"] == ["1"] and found[0].near_items == []
    assert [r.near_items for r in found[1:]] == [["1"], [], [], ["1"]] and not any(r.spans for r in found[1:])


def test_items_of_the_same_words_are_matched_once(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    rows = [(i, item if i % 2 else item.upper() + " !") for i in range(50)] + [(7, item), (99, "other words")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    assert sorted(len(r.item_ids) for r in dc._item_rows(items, "item_id", "text").collect()) == [1, 50]
    (found,) = dc.matches(docs_of(spark, [f"{item} and {item}"]), items).collect()
    assert found["items"] == sorted(str(i) for i in range(50)) and found.n_hit == 26


def test_empty_tables_and_filter(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of(spark, ["a b", None, "one two three", "one two three"])
    assert all(r.n_hit == 0 for r in dc.matches(docs, none).collect())
    assert dc.matches(empty_docs(spark), none).count() == 0
    left = dc.clean(docs, spark.createDataFrame([(1, "two three")], "item_id long, text string"))
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [0, 1]
