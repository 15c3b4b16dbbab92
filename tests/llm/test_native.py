import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import docs_of, empty_docs, rows_of
from verdant.llm import licences, quality, urls

BLANK = "[\x20\x09-\x0d]+"


def measured(text):
    words = [w for w in re.split(BLANK, text or "") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + d for i, g in enumerate(grams) if often[g] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.sub(BLANK, "", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_measurements_equal_counting(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t ", "a", "a b", "a b c", "a a a a", "x y z x y z", "a\n a\na\n\n", "é\u00a0é ü\x0bö", "#*$% <|>"]
    texts += [" ".join(rng.choices("a b c d e\n".split(" "), k=rng.randrange(60))) for _ in range(150)]
    texts += [" ".join(f"w{rng.randrange(4000)}" for _ in range(30000))]
    got = rows_of(quality.measure(docs_of(spark, texts)))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(t), t


@pytest.mark.parametrize("spare", [58, 60, 62])
def test_measurements_with_few_hash_bits(spark, monkeypatch, spare):
    """Unlike windows that share their hash and stand between equal ones."""
    rng = random.Random(spare)
    texts = [None, "a", "a b c", " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i % 90}" for i in range(200))]
    texts += [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(80))) for _ in range(60)]
    monkeypatch.setattr(quality, "_position_bits", lambda words: F.lit(spare))
    got = rows_of(quality.measure(docs_of(spark, texts)))
    assert [got[i].n_repeat_words for i in range(len(texts))] == [measured(t)[4] for t in texts]


def test_ledger_policies_and_ablation(spark):
    texts = [None, "word " * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}#" for i in range(60)), "a #"]
    book = quality.ledger(docs_of(spark, texts)).cache()
    bits = {r.doc_id: r.failed for r in book.collect()}
    assert bits == {0: 0b1, 1: 0b10, 2: 0, 3: 0b100, 4: 0b10101}
    v1 = {r.doc_id for r in book.filter(quality.passes(book.failed, "v1")).collect()}
    assert v1 == {2, 3} and [r.doc_id for r in quality.accepted(docs_of(spark, texts)).collect()] == [2]
    for r in quality.ablation(book, "v2").collect():
        bit = quality.mask_of((r.rule,))
        assert (r.n_failed, r.n_only) == (sum(b & bit > 0 for b in bits.values()), sum(b == bit for b in bits.values()))
        assert r.n_kept_without == sum(b & ~bit == 0 for b in bits.values())
    assert quality.ledger(empty_docs(spark)).count() == 0 and quality.accepted(empty_docs(spark)).columns == empty_docs(spark).columns


def expected_licences(texts):
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c in licences.UPPER else c for c in t or "")) for t in texts]
    out = []
    for ws in words:
        places, labels, base = [], set(), set()
        for t in licences.TEMPLATES:
            want, phrase = t.text.split(), t.phrase.split()
            first = next(i for i in range(len(want)) if want[i : i + len(phrase)] == phrase)
            for at in range(len(ws)):
                start = at - first
                if ws[at : at + len(phrase)] != phrase:
                    continue
                k = sum(0 <= start + i < len(ws) and ws[start + i] == w for i, w in enumerate(want))
                if 100 * k >= t.need * len(want):
                    labels.add(t.label)
                    if t.base:
                        base.add(t.label)
                        places.append(start)
        out.append((len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels))))
    return out


def test_licences_equal_trying_every_place(spark):
    rng = random.Random(3)
    vocabulary = sorted({w for t in licences.TEMPLATES for w in t.text.split()}) + ["x", "é", "2"]
    texts = [None, "", "CC-BY. cc by", "All rights reserved" * 3, "(all rights\nreserved) all all rights reserved", "General Public License, version 3", "ALL RİGHTS reserved", "cc\u00a0by"]
    texts += [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 200))) for _ in range(60)]
    texts += [f"a {t.text} b" for t in licences.TEMPLATES] + ["all rights reserved " * 3000]
    got = rows_of(licences.scan(docs_of(spark, texts)))
    for i, want in enumerate(expected_licences(texts)):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want, texts[i]
        assert 0 <= r.score <= 1 and (r.score > 0 or not r.labels)
    assert licences.scan(empty_docs(spark)).count() == 0
    twice = docs_of(spark, ["cc by"]).unionAll(docs_of(spark, ["cc by"]))
    assert [r.n_base for r in licences.scan(twice).collect()] == [1, 1]


NOTICES = {
    "cc by": "This work is licensed under CC BY 4.0.",
    "general public license": "under the terms of the GNU General Public License as published by the Free Software Foundation",
    "all rights reserved": "Copyright (c) 2020 A. Author. All rights reserved.",
    "apache license version 2 0": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "mit license": "The MIT License (MIT)",
    "permission is hereby granted free of charge to any person obtaining a copy": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files",
    "bsd license": "SPDX: BSD License",
    "redistribution and use in source and binary forms": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc by nc": "CC BY-NC 4.0",
    "cc by sa": "CC BY-SA 4.0",
    "cc by nd": "CC BY-ND 4.0",
    "cc0": "CC0 1.0 Universal",
    "creative commons": "Creative Commons Attribution 4.0 International",
    "general public license version 2": "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991",
    "general public license version 3": "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007",
    "affero general public license": "GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007",
    "lesser general public license": "GNU LESSER GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007",
    "mozilla public license": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "eclipse public license": "made available under the terms of the Eclipse Public License 2.0",
    "isc license": "ISC License",
    "free and unencumbered software released into the public domain": "This is free and unencumbered software released into the public domain.",
    "public domain": "This file is in the public domain.",
}


def test_each_template_finds_its_notice(spark):
    assert [t.text for t in licences.TEMPLATES] == list(NOTICES)
    index = licences.postings(docs_of(spark, list(NOTICES.values())), licences.TEMPLATES, "doc_id", "text")
    found = licences.matches(index, spark).join(index.select("rid", "doc_id"), "rid").filter("found").select("doc_id", "tid", "part").collect()
    assert {i for i in range(len(NOTICES))} <= {r.tid for r in found if r.doc_id == r.tid and r.part == 1}
    mit = rows_of(licences.scan(docs_of(spark, ["Permission is hereby granted, free of charge, to any person obtaining a copy", "permission, free of any charge, to any person obtaining"])))
    assert mit[0].labels == "mit" and mit[0].score == 1 and mit[1].labels == ""


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_for(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    given = [None, "", "no scheme", "http://", "HTTP://A.Com", "x://EXAMPLE.com/en/1?q=/fr/#z", "http://www.Example.com/en/", "http://a.net/es/2", "http://net/fr/", "http://bnet/fr/1", "http://a.net?x=/es/", "a://b://c/d"]
    given += [u for (u,) in duckdb.sql("SELECT url FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    # A host whose paths /ads/<n> are blocked by a rule, and /ads2 pages like them that no rule knows.
    given += [f"http://many.org/item{c}/x" for c in "abcdefghijkl"] + ["http://deep.org" + "/a" * 40]
    rows = [(i, u, "h", "t") for i, u in enumerate(given)]
    got = rows_of(urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string, template string"), RULES), "page_id")
    assert len(got) == len(rows)
    for i, u, _, _ in rows:
        host, path = split_url(u)
        rule, verdict = rule_for(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or ("block" if got[i].purity >= urls.REJECT else "allow"))
    assert {r.template for r in got.values() if r.host == "many.org"} == {"/*/x"}
    assert {r.template for r in got.values() if r.host == "deep.org"} == {"/a" * 40}
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty, RULES).count() == 0


def test_templates_learn_from_labels_and_merge(spark):
    rules = [("block", "s.org", "/bad/1"), ("block", "s.org", "/worse/1"), ("allow", "s.org", "/good/1")]
    paths = [f"/{kind}/{n}" for kind in ("bad", "worse", "good") for n in (*range(1, 2), *range(10, 20), *range(100, 130), 7, 8)] + ["/new/9"]
    rows = [(i, f"http://s.org{p}") for i, p in enumerate(paths)]
    got = {p: r for p, r in zip(paths, sorted(urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()))}
    assert got["/bad/7"].verdict == "block" and got["/worse/8"].verdict == "block" and got["/good/7"].verdict == "allow" and got["/new/9"].verdict == "allow"
    assert got["/bad/7"].rule is None
    assert {got[p].template for p in paths if p.startswith("/new")} == {"/new/*"}


def test_all_levels_of_deep_paths(spark):
    deep = "/r/s/t/u/v/w"
    rules = [("block", "s.org", f"{deep}/bad/x/1"), ("allow", "s.org", f"{deep}/good/x/1")]
    paths = [f"{deep}/{kind}/x/{n}" for kind in ("bad", "good") for n in (1, *range(10, 20), *range(100, 130), 7)] + ["/a" * 40, "/", "/z" * 1500]
    pages = spark.createDataFrame([(i, f"http://s.org{p}") for i, p in enumerate(paths)], "page_id long, url string")
    got = dict(zip(paths, sorted(urls.judge(pages, rules).collect())))
    assert got[f"{deep}/bad/x/7"].verdict == "block" and got[f"{deep}/good/x/7"].verdict == "allow"
    assert got[f"{deep}/bad/x/7"].template == f"{deep}/bad/x/*" and got["/a" * 40].template == "/a" * 40 and got["/"].template == ""
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_method_decides_on_given_pages(spark):
    """Of the pages that no rule knows some are blocked and some not, and like branches are merged."""
    got = urls.judge(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), RULES)
    found = {(r.verdict, r.merged): r["count"] for r in got.selectExpr("rule", "verdict", "template LIKE '~%' AS merged").groupBy("rule", "verdict", "merged").count().filter("rule IS NULL").collect()}
    assert found["block", False] > 100 and found["allow", False] > 100
    assert got.filter("template LIKE '~%'").select("host").distinct().count() > 10


def test_unlabelled_branches_inherit(spark):
    rules = [("block", "s.org", f"/shop/{k}/") for k in "ab"] + [("allow", "s.org", "/news/")]
    paths = [f"/shop/{k}/{n}" for k in "abc" for n in range(30)] + [f"/news/{n}" for n in range(200)] + ["/else/1", "/shop/c/deep/er/1"]
    pages = spark.createDataFrame([(i, f"http://s.org{p}") for i, p in enumerate(paths)] + [(-1, "http://bare.org/x")], "page_id long, url string")
    got = dict(zip(["bare", *paths], sorted(urls.judge(pages, rules).collect())))
    assert got["/shop/a/3"].template == got["/shop/b/4"].template == "~/shop/*/*#1"
    assert got["/shop/c/5"].verdict == got["/shop/c/deep/er/1"].verdict == "block" and got["/shop/c/5"].rule is None
    assert got["/shop/c/5"].purity == 61 / 62 and got["/else/1"].purity == 61 / 262 and got["/else/1"].verdict == "allow"
    assert got["bare"].purity == 0.5


def plain_templates(leaves):
    """(host, parts) -> template by walking the tree level by level."""
    at, level = {k: "" for k in leaves}, 0
    while any(len(k[1]) > level for k in leaves):
        children = {}
        for host, parts in leaves:
            if len(parts) > level:
                kinds = children.setdefault((host, at[host, parts]), {})
                kinds[parts[level]] = kinds.get(parts[level], 0) + leaves[host, parts]
        for host, parts in leaves:
            if len(parts) > level:
                kinds = children[host, at[host, parts]]
                wide = len(kinds) >= urls.MANY or (len(kinds) >= urls.SOME and 2 * len(kinds) > sum(kinds.values()))
                at[host, parts] += "/" + ("*" if wide else parts[level])
        level += 1
    return at


def test_templates_equal_level_by_level(spark):
    rng = random.Random(6)
    leaves = {}
    for _ in range(1500):
        parts = tuple(rng.choice(["a", "b", f"x{rng.choice('abcdefghijklmnopqrstuvwxyz') * 2}", "long", "c"]) for _ in range(rng.choice([0, 1, 2, 3, 5, 9])))
        leaves["h" + str(len(parts) % 2), ("pre", "fix", *parts) if rng.random() < 0.5 else parts] = rng.choice([1, 1, 2, 9])
    rows = [(h, "/".join(p), n, 0, 0) for (h, p), n in leaves.items()]
    got = urls.templates(spark.createDataFrame(rows, "host string, lex string, n long, labelled long, blocked long")).collect()
    assert {(r.host, r.lex): r.template for r in got} == {(h, "/".join(p)): t for (h, p), t in plain_templates(leaves).items()}


@pytest.mark.parametrize("blocked, merges", [((40, 40), True), ((40, 0), False)])
def test_only_like_branches_merge(spark, blocked, merges):
    rules = [("block", "s.org", f"/{k}/x") for k, n in zip("ab", blocked) if n] + [("allow", "s.org", f"/{k}/x") for k, n in zip("ab", blocked) if not n]
    rows = [(i, f"http://s.org/{k}/x{n}") for i, (k, n) in enumerate((k, n) for k in "ab" for n in range(40))]
    found = {r.template for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert (len(found) == 1) == merges
