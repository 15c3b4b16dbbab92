from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import empty_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from verdant.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, item int, rank int, total int, kept int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1, 2, 3, 4, 5) for i, r in enumerate(rows)], SCHEMA)


def plain(rows, min_docs=10, top=10):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang].add(source)
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        p = {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(ranked if part == "pair" else ranked[:top], 1)]
    return sorted(out)


def found(spark, rows, **options):
    got = divergence.audit(table_of(spark, rows), **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("shard,block,held", [(1 << 15, 32, 400_000), (4, 2, 5)])
def test_equals_brute_force(spark, monkeypatch, shard, block, held):
    for name, value in (("SHARD", shard), ("BLOCK", block), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    rnd = random.Random(9)
    words = ["Zug", "the", "École", "naïve", "x-ray", "über", "日本", "of", "a", "𝔘", "ﬀ", "rare"]
    rows = []
    for i in range(150):
        source = rnd.choice(["s1", "s2", "s3", "s4", "ß", None])
        picked = words[: 4 + len(source or "")] if rnd.random() < 0.7 else words
        rows.append((" ".join(rnd.choices(picked, k=rnd.choice([0, 3, 30]))), rnd.choice(["en", "de", None]), source))
    rows += [(None, "en", "only-null"), ("", "en", "only-empty"), ("12 34", "fr", "digits"), ("word", "fr", "x"), ("Zug " * 5000, "en", "s1"), rows[3], rows[3]]
    assert found(spark, rows, min_docs=5) == plain(rows, 5)


def test_few_documents_keep_no_term(spark):
    rows = [("a b c", "en", s) for s in ("x", "y", "z")]
    assert found(spark, rows) == plain(rows) == [("en", s, "pair", o, 0, k) for s in "xyz" for k, o in enumerate([t for t in "xyz" if t != s], 1)]


def test_one_hot_source_and_ties(spark):
    rows = [("alpha beta gamma delta", "en", "hot")] * 200 + [(f"t{i} alpha", "en", f"s{i % 3}") for i in range(30)]
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert divergence.audit(empty_docs(spark)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 3000)), st.sets(st.integers(0, 3000)), st.integers(1, 40))
def test_galloping(a, b, stride):
    x, y = (np.array(sorted(s), np.int64) for s in (a, b))
    here, there = divergence.galloping(x, y, stride)
    assert x[here].tolist() == sorted(a & b) == y[there].tolist()


def test_shares_of_large_counts():
    n = np.array([0, 1, 7, 10**15, 8 * 10**15], np.int64)
    assert divergence.shares(n, 8 * 10**15, 123_456).tolist() == [1 + 10**9 * (int(c) + 2) // (8 * 10**15 + 2 * 123_456) for c in n]
    assert divergence.shares(np.array([5]), 5, 1).tolist() == [1 + 10**9]
