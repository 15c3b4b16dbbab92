from __future__ import annotations

import hashlib
import math
import random
from zlib import crc32

import numpy as np
import pytest
from brute import alnum_words
from fixtures import docs_of, empty_docs, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from verdant.llm import importance


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters=" "), min_size=1, max_size=40), min_size=1, max_size=12), st.integers(1, 4))
def test_gram_crcs_equal_plain_ones(words, most):
    raw = [w.encode() for w in words]
    want = [crc32(b" ".join(raw[i : i + n])) for n in range(1, most + 1) for i in range(len(raw) - n + 1)]
    assert [int(x) for block in importance.gram_crcs(raw, 1, most) for x in block] == want


def test_shift_by_long_lengths():
    words = [b"a" * 5000, b"b" * 70_001, b"c", b"d" * 300_000]
    got = np.concatenate(list(importance.gram_crcs(words, 1, 4)))
    assert int(got[-1]) == crc32(b" ".join(words))
    assert [int(x) for x in got[:4]] == [crc32(w) for w in words]


def test_blocks_of_a_long_text(monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 7)
    words = [b"w%d" % (i % 13) for i in range(100)]
    got = np.concatenate(list(importance.gram_crcs(words, 2, 3)))
    assert got.tolist() == [crc32(b" ".join(words[i : i + n])) for n in (2, 3) for i in range(100 - n + 1)]


def plain(docs, target, least=1, most=1, buckets=10_000, seed=2024, min_words=20, percent=10):
    def hashed(text):
        words = [w.encode() for w in alnum_words(text)]
        return len(words), [crc32(b" ".join(words[i : i + n])) % buckets for n in range(least, most + 1) for i in range(len(words) - n + 1)]

    corpus, aim = [hashed(t) for _, t in docs], [hashed(t) for t in target]
    s, t = ([0] * buckets for _ in range(2))
    for side, rows in ((s, corpus), (t, aim)):
        for _, found in rows:
            for b in found:
                side[b] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for (i, _), (n, found) in zip(docs, corpus):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for place, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = place
    return out


@pytest.mark.parametrize("options", [{}, {"most": 3, "buckets": 70_000, "min_words": 3, "percent": 50, "seed": 7}])
def test_equals_brute_force(spark, options):
    rnd = random.Random(4)
    words = ["der", "the", "Zürich", "x1", "data", "model", "règle", "a-b", "42"]
    texts = [" ".join(rnd.choices(words, k=rnd.choice([0, 1, 5, 19, 20, 21, 60]))) for _ in range(120)]
    texts += [None, "", " . ", "The data model " * 3000, texts[5], texts[5]]
    target = ["the data model règle " * 4, None, "x1"]
    got = importance.resample(docs_of(spark, texts), docs_of(spark, target), **options)
    want = plain(list(enumerate(texts)), target, **options)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_repeated_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = docs_of(spark, [text] * 40).selectExpr("CASE WHEN doc_id > 9 THEN doc_id % 10 END AS doc_id", "text", "rid", "rid AS number")
    got = importance.resample(docs, docs_of(spark, [text]), percent=50).collect()
    assert len(got) == 40 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21))
    by_rank = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["score"] for r in by_rank] == sorted((r["score"] for r in got), reverse=True)[:20]


def test_empty_tables(spark):
    assert importance.resample(empty_docs(spark), docs_of(spark, ["a b"])).count() == 0
    rows = rows_of(importance.resample(docs_of(spark, ["a b", None]), empty_docs(spark), min_words=1, percent=100))
    assert rows[0]["rank"] == 1 and rows[1]["rank"] is None and rows[1]["weight"] == 0 and rows[0]["weight"] < 0
