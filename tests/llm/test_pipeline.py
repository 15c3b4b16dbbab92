from collections import Counter

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.llm.fixtures import DOCS
from tests.llm.test_native import measured
from tests.llm.test_packing import check
from verdant.llm import secret_scans


def good(text):
    n, chars, symbols, dup, repeat = measured(text)
    lines = sum(bool(x.strip(" \t\n\x0b\f\r")) for x in (text or "").split("\n"))
    return n >= 50 and 2 * repeat <= n and 10 * symbols <= n and not (lines >= 4 and 100 * dup > 60 * lines) and 2 * n <= chars <= 15 * n


def test_run_equals_brute_force(spark):
    at = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{at}/documents.parquet'").fetchall()
    docs = [(i, t) for i, t in docs if good(t)]
    linked = brute.components(docs)
    docs = [(i, t) for i, t in docs if linked[i][1] == i]
    bad = brute.contamination(docs, duckdb.sql(f"SELECT item_id, text FROM '{at}/benchmark.parquet'").fetchall())
    docs = {i: secret_scans.redact_text(t) for i, t in docs if not bad[i][4]}
    rows = corpus_pipeline.run(spark, at).collect()
    check(rows, docs, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def test_stages_keep_columns_and_clean_rows(spark):
    clean = [" ".join(f"word{i}x{k}" for k in range(80)) for i in range(5)]
    rows = [(i, t, "en", "s", len(t), 1, "w", 2) for i, t in enumerate(clean)] + [(9, None, "en", "s", None, 1, "w", 2), (None, clean[0] + " more", "en", "s", 3, 1, "w", 2)]
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert {r.doc_id for r in out.collect()} >= set(range(5)), name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0, name
    assert Counter(n for n, _ in corpus_pipeline.STAGES) and [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules"


def test_clashing_names(spark):
    text = " ".join(f"word{k}" for k in range(80))
    names = ["n_words", "failed", "row", "words", "text_hash", "b", "d", "node", "component_id", "found", "part", "piece", "length", "rank"]
    docs = spark.createDataFrame([(1, text, "en", "s", len(text), *range(len(names)))], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").collect() == docs.collect(), name
    assert corpus_pipeline.sequence_packing(spark, docs, "").count() == 1
