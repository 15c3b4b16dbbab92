import random

import duckdb
import numpy as np

from tests.llm import brute
from tests.llm.fixtures import DOCS, docs_of, empty_docs
from verdant.llm import near_dedup as nd
from verdant.session import cut_lineage


def expected(rows):
    return {i: (n, c) for i, (n, c) in brute.components(rows).items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nd.classes(df).collect()}


def changed(words, rng, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_given_documents_equal_all_pairs(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    assert got(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")) == expected(rows)


def test_copies_around_the_threshold_equal_all_pairs(spark):
    """Groups of copies of one text, copies of copies and common passages, with similarities on both sides of 0.8."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(55)]
    texts = [None, "", "  \n", "one", "ONE", "one two", "one  two", "É a", "é a", "a b c d e f", "a b c d e f g", "a b c d e"]
    for g in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((30, 80, 300)))]
        texts += [" ".join(changed(base, rng, rng.choice((0.0, 0.01, 0.04, 0.05, 0.06, 0.08)))) for _ in range(60)]
        chain = base
        for _ in range(25):
            chain = changed(chain, rng, 0.04)
            texts.append(" ".join(chain))
    texts += [" ".join([f"u{rng.randrange(10**6)}" for _ in range(60)] + common) for _ in range(80)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert got(docs_of(spark, texts)) == expected(rows)


def test_all_pairs_within_reach_share_a_bucket():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 16, 32)
    for _ in range(300):
        b = a.copy()
        at = rng.choice(32, nd.REACH, replace=False)
        b[at] = (b[at] + 1) % (1 << 16)
        differ = (a != b).reshape(nd.CHUNKS, nd.SYMBOLS).sum(axis=1)
        assert differ.sum() == nd.REACH and differ.min() <= 1


def test_distance_counts_differing_symbols(spark):
    rng = np.random.default_rng(6)
    rows, want = [], []
    for _ in range(50):
        a = rng.integers(0, 1 << 16, 32, dtype=np.uint64)
        b = np.where(rng.random(32) < 0.4, rng.choice(np.array([0, 1, 0x8000, 0xFFFF], dtype=np.uint64), 32), a)
        pack = lambda x: (x.reshape(8, 4) << np.arange(0, 64, 16, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()
        rows.append((tuple(pack(a)), tuple(pack(b))))
        want.append(int((a != b).sum()))
    kind = "struct<" + ",".join(f"{s}:long" for s in nd.SIGNS) + ">"
    df = spark.createDataFrame(rows, f"x {kind}, y {kind}")
    assert [r.d for r in df.select(nd._distance("x", "y").alias("d")).collect()] == want


def test_repeats_and_unknown_ids(spark):
    rows = [(5, "a b c", *"..", 1, 2, "w", 3), (5, "a b c", *"..", 1, 2, "w", 3), (3, "A b c", *"..", 1, 2, "w", 3), (None, "x y", *"..", 1, 2, "w", 3), (8, "x y", *"..", 1, 2, "w", 3), (9, None, *"..", 1, 2, "w", 3)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted((str(r.doc_id), r.component_id) for r in nd.classes(df).collect()) == [("3", 3), ("5", 3), ("5", 3), ("8", 8), ("9", 9), ("None", 8)]
    once = nd.deduplicated(df.unionAll(df))
    assert sorted(str(r.doc_id) for r in once.collect()) == ["3", "8", "9", "None", "None"] and once.columns == df.columns
    assert nd.classes(empty_docs(spark)).count() == 0 and nd.deduplicated(empty_docs(spark)).count() == 0


def test_postings_are_not_sent_to_all_tasks(spark, monkeypatch):
    """An exploded row counts as one in Spark's sizes, so 32 postings a node seemed few enough for a broadcast."""
    plans = []
    monkeypatch.setattr(nd, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or cut_lineage(df))
    assert nd.classes(docs_of(spark, ["a b c d e f", "a b c d e f", "x y z"])).count() == 3
    posted = [p for p in plans if "Generate explode" in p and "Join [key" in p]
    assert posted and all("SortMergeJoin [key" in p and "BroadcastHashJoin [key" not in p for p in posted)
