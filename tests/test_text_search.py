import math

import numpy as np
import time

import pytest
from pyspark.sql import functions as F

from verdant.functions import text as tx
from verdant.functions import vectors as vx
from verdant.operators import advice, graph, lexical, search, vectors


def one(spark, expr, *values, schema="t string"):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], schema).select(expr.alias("x")).collect()]


def test_language(spark):
    texts = ["Ғўза қандай ўсади?", "Как растет хлопок?", "Paxta uchun suv kerak", "How does the crop grow in this field?", "12345 !!", "xyz", None]
    assert one(spark, tx.language(F.col("t")), *texts) == ["uz-cyrl", "ru", "uz-latn", "en", None, None, None]


def test_mask(spark):
    masked = one(spark, tx.mask_secrets(F.col("t"), ("literal-secret", "abc")), "token sk-abcdef123456 Bearer xyz789 client_secret=topsecret value literal-secret abc")[0]
    for secret in ("abcdef123456", "xyz789", "topsecret", "literal-secret"):
        assert secret not in masked
    assert masked.endswith("value *** abc")


def test_tokens_split_at_letters_outside_the_alphabet(spark):
    assert one(spark, tx.tokens(F.col("t")), "G'o'za va ўсади a NDVI-2") == [["g'o'za", "va", "сади", "ndvi"]]


def test_normalise_takes_every_blank(spark):
    assert one(spark, tx.normalise(F.col("t")), " A  b\tC ") == ["a b c"]


def cut(spark, *texts, **options):
    return one(spark, tx.chunks(F.col("t"), **options), *texts)


def test_chunks_cut_at_sentences_and_step(spark):
    (pieces,) = cut(spark, "Bir ikki uch. " * 200)
    assert all(len(p) <= 650 for p in pieces) and pieces[0].endswith("uch")
    assert cut(spark, "x" * 700) == [["x" * 650, "x" * 49]]  # a hard cut skips one character
    assert cut(spark, "  a  b ", "", None) == [["a b"], [], []]
    assert cut(spark, "aaa bbb ccc ddd", size=8, overlap=3) == [["aaa bbb", "ccc ddd"]]


def test_overlap_mode_loses_nothing(spark):
    words = [f"w{i}" for i in range(900)]
    text = ". ".join(" ".join(words[i : i + 7]) for i in range(0, 900, 7))
    joined = " ".join(cut(spark, text, mode="overlap")[0])
    assert all(w in joined for w in words)


def test_bm25_equals_the_formula(spark):
    docs = ["paxta suv paxta", "bugdoy suv", "suv suv suv azot"]
    chunks = spark.createDataFrame(list(enumerate(docs)), "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "paxta suv paxta nomalum")], "query_id long, text string")
    got = {r.chunk_id: r.score for r in lexical.bm25_scores(asked, search.corpus_statistics(chunks), ["query_id"]).collect()}
    toks = [d.split() for d in docs]
    mean = sum(map(len, toks)) / 3

    def part(term, doc):
        df = sum(term in t for t in toks)
        tf = doc.count(term)
        idf = math.log((3 - df + 0.5) / (df + 0.5) + 1)
        return idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(doc) / mean)) if tf else 0.0

    for i, doc in enumerate(toks):
        assert got[i] == pytest.approx(2 * part("paxta", doc) + part("suv", doc), abs=1e-8)
    ranked = search.bm25_ranked(asked, search.corpus_statistics(chunks), ["query_id"]).orderBy("rank").collect()
    assert [r.chunk_id for r in ranked][0] == 0 and len(ranked) == 3


def test_bm25_pads_with_lowest_unmatched_ids(spark):
    chunks = spark.createDataFrame([(i, "paxta" if i in (3, 30) else "boshqa soz") for i in range(40)], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "paxta")], "query_id long, text string")
    ranked = search.bm25_ranked(asked, search.corpus_statistics(chunks), ["query_id"]).orderBy("rank").collect()
    assert [r.chunk_id for r in ranked] == [3, 30, 0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13]


def test_fusion(spark):
    rows = [(1, 5, 1), (1, 6, 2), (1, 6, 1), (1, 7, 2)]
    got = search.fuse(spark.createDataFrame(rows, "query_id long, chunk_id long, rank int")).orderBy("place").collect()
    assert [r.chunk_id for r in got] == [6, 5, 7]
    assert got[0].fused == pytest.approx(1 / 61 + 1 / 62)


def naive_mmr(query, vectors_, n, weight):
    unit = lambda v: v / np.linalg.norm(v)
    rel = [unit(query) @ unit(v) for v in vectors_]
    chosen = []
    while len(chosen) < n:
        rest = [i for i in range(len(vectors_)) if i not in chosen]
        score = lambda i: weight * rel[i] - (1 - weight) * max((unit(vectors_[i]) @ unit(vectors_[j]) for j in chosen), default=0) if chosen else rel[i]
        chosen.append(max(rest, key=score))
    return chosen


def test_mmr_equals_plain_greedy_choice(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(24, 6))
    query = rng.normal(size=6)
    pool = spark.createDataFrame([(1, i, i + 1) for i in range(24)], "query_id long, chunk_id long, place int")
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, query.tolist())], "query_id long, embedding array<double>")
    got = {r.chunk_id for r in search.diversify(pool, chunks, queries).collect()}
    assert got == set(naive_mmr(query, vecs, 10, 0.65))
    assert search.diversify(pool.limit(7), chunks, queries).count() == 7


def test_nearest_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(8, 5)), rng.normal(size=(50, 5))
    frame = lambda m, key: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{key} long, embedding array<double>")
    got = {}
    for r in vectors.nearest(frame(q, "query_id"), frame(c, "chunk_id"), 4).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {i: np.argsort(-(c @ v))[:4].tolist() for i, v in enumerate(q)}


def test_keep_rule(spark):
    df = spark.createDataFrame([(1, 0.2), (2, 0.1)], "rank int, score double")
    assert [r.rank for r in vectors.keep_rule(df, "score", None).collect()] == [1]
    assert vectors.keep_rule(df, "score", 0.3).count() == 0


def test_unit_vectors_and_cosine(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r.x for r in rows.select(vx.l2_normalise(F.col("v")).alias("x")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert [r.x for r in rows.select(vx.cosine(F.col("v"), F.col("v")).alias("x")).collect()] == [1.0, 0.0]


def test_graph_of_two_chunks(spark):
    chunks = spark.createDataFrame(
        [(1, "kitob.pdf", 10, "Paxta va azot. PAXTA NDVI"), (1, "kitob.pdf", 11, "azot, vilt")],
        "document_id long, document_name string, chunk_id long, text string",
    )
    nodes = {r.node_id: r.type for r in graph.extract_nodes(chunks).collect()}
    assert set(nodes) == {"kitob.pdf", "Paxta", "Azot", "Ndvi", "Vilt"}
    edges = {(r.source, r.target) for r in graph.extract_edges(chunks).collect()}
    assert ("Paxta", "Azot") in edges and ("Azot", "Vilt") in edges and ("kitob.pdf", "Ndvi") in edges
    assert ("Paxta", "Paxta") not in edges and ("Paxta", "Vilt") not in edges


def test_overlap_scores_parts(spark):
    queries = spark.createDataFrame([(1, "paxtazor va xx")], "query_id long, text string")
    texts = spark.createDataFrame([("Paxta vaqti",), ("boshqa",)], "text string")
    rows = {r.text: r.overlap for r in graph.text_overlap(queries, texts).collect()}
    assert rows == {"Paxta vaqti": pytest.approx((0.5 + 1.0) / 3)}  # paxta of paxtazor, va, not xx


def test_advice_shapes(spark):
    rows = ['{"red":["a "," ","b","c","d"],"yellow":[],"green":[]}', '{"red":"a","yellow":[],"green":[]}', '{"red":[],"yellow":[]}', "{", '{"red":[],"yellow":[],"green":[1]}']
    got = advice.clean_advice(spark.createDataFrame([(r,) for r in rows], "output_text string")).collect()
    assert [r.rejected for r in got] == [False, True, True, True, True]
    assert got[0].red == ["a", "b", "c"]


@pytest.mark.parametrize("mode", ["reference", "overlap"])
def test_chunking_takes_time_in_proportion(spark, mode, tmp_path):
    sentence = "Ärger und Öl, word after word. "
    took = {}
    for n in (800_000, 8_000_000):
        path = f"{tmp_path}/{n}"
        spark.createDataFrame([(sentence * (n // len(sentence)),)], "t string").write.parquet(path)
        start = time.perf_counter()
        rows = spark.read.parquet(path).select(F.explode(tx.chunks(F.col("t"), mode=mode)).alias("c")).agg(F.count("c"), F.max(F.length("c")), F.sum(F.length("c"))).first()
        took[n] = time.perf_counter() - start
        assert rows[1] <= 650 and rows[2] > 0.9 * n
    assert took[8_000_000] < 12 * took[800_000]


def test_overlapping_chunks_of_words_longer_than_a_window(spark):
    text = " ".join(["x" * 700, "y" * 100, "z" * 649 + " " + "a" * 640, "b"] * 40)
    (found,) = spark.createDataFrame([(text,)], "t string").select(tx.chunks(F.col("t"), mode="overlap").alias("c")).first()
    at = 0
    for c in found:  # every chunk is a stretch of the text, and none begins behind the end of those before
        start = text.find(c, max(0, at - 1400))
        assert 0 <= start <= at + 1
        at = max(at, start + len(c))
    assert at == len(text)


def walked(edges, seeds, depth, cap):
    """(nodes, touched edges) of one graph by serving a line of (name, level) one after another."""
    line, inside, touched = [(n, 0) for _, n in sorted((-s, n) for n, s in seeds.items())], set(seeds), set()
    for name, level in line:  # grows while it is served
        if len(inside) >= cap:
            break
        if level == depth:
            continue
        mine = [e for e in edges if name in e[:2]]
        touched.update(mine)
        for other in sorted({b if a == name else a for a, b, _ in mine} - inside)[: cap - len(inside)]:
            inside.add(other)
            line.append((other, level + 1))
    return inside, touched


@pytest.mark.parametrize("cap", [1, 4, 7, 25])
def test_expansion_serves_its_queue(spark, cap):
    rng = np.random.default_rng(cap)
    graphs = {d: {(f"n{a:02}", f"n{b:02}", "t") for a, b in rng.integers(0, 20, (int(rng.integers(1, 40)), 2)).tolist()} for d in range(12)}
    found = {(q, d): {f"n{n:02}": float(rng.integers(0, 3)) for n in rng.integers(0, 22, 1 + (q + d) % 4).tolist()} for q in range(3) for d in graphs}
    edges = spark.createDataFrame([(d, *e, "") for d, g in graphs.items() for e in g], "document_id long, source string, target string, type string, description string")
    seeds = spark.createDataFrame([(q, d, n, s, 0) for (q, d), ns in found.items() for n, s in ns.items()], "query_id long, document_id long, node_id string, score double, depth int")
    nodes, touched = graph.expand(seeds, edges, cap=cap)
    got_nodes, got_edges = {}, {}
    for r in nodes.collect():
        got_nodes.setdefault((r.query_id, r.document_id), set()).add(r.node_id)
    for r in touched.collect():
        got_edges.setdefault((r.query_id, r.document_id), set()).add((r.source, r.target, r.type))
    for key, start in found.items():
        assert (got_nodes[key], got_edges.get(key, set())) == walked(graphs[key[1]], start, 2, cap), key


def test_rarest_piece_finds_what_contains_the_needle(spark):
    texts = ["Theory of theories", "the other", "Bother", "zzz", "", "t h e", "THE End", "ab", "cab", "xabx"]
    asked = ["theory ab", "other zz", "qqqq the", "thoroughly"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = {(r.query_id, r.text): r.overlap for r in graph.text_overlap(queries, spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    want = {}
    for i, q in enumerate(asked):
        for t in texts:
            norm = " ".join(t.lower().split())
            points = [1.0 if w in norm else 0.5 if len(w) >= 4 and w[: len(w) * 65 // 100] in norm else 0.0 for w in q.split()]
            if t and any(points):
                want[i, t] = sum(points) / len(points)
    assert got == pytest.approx(want)


@pytest.mark.parametrize("blocks, batches", [(8, 1), (16, 3), (1024, 2)])
def test_ranked_lists_equal_all_scores(spark, blocks, batches, monkeypatch):
    """Pruned lists over blocks and batches against the scores of all chunks in one batch."""
    monkeypatch.setattr(lexical, "CHUNKS", blocks)
    monkeypatch.setattr(lexical, "QUERIES", 3)
    rng = np.random.default_rng(blocks)
    words = np.array([f"w{int(i)}x" for i in rng.zipf(1.3, 400) % 60])
    texts = [(i, " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(240)]
    asked = spark.createDataFrame([(q, " ".join(rng.choice(words, rng.integers(1, 6)))) for q in range(10)] + [(10, "unknown"), (11, "")], "query_id long, text string")
    whole = lexical.corpus_statistics(spark.createDataFrame(texts, "chunk_id long, text string"))
    corpus = None
    for k in range(batches):
        part = spark.createDataFrame(texts[k::batches], "chunk_id long, text string")
        corpus = lexical.corpus_statistics(part) if corpus is None else lexical.added(corpus, part)
    assert sorted(map(tuple, corpus.frequencies.collect())) == sorted(map(tuple, whole.frequencies.collect()))
    scores = {}
    for r in lexical.bm25_scores(asked, whole, ["query_id"]).collect():
        scores.setdefault(r.query_id, {})[r.chunk_id] = r.score
    got = {}
    for r in lexical.bm25_ranked(asked, corpus, ["query_id"], 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    for q in range(12):
        every = {i: scores.get(q, {}).get(i, 0.0) for i in range(240)}
        want = sorted(every.items(), key=lambda s: (-s[1], s[0]))[:5]
        assert [i for i, _ in got[q]] == [i for i, _ in want] and [s for _, s in got[q]] == pytest.approx([s for _, s in want])


def test_blocks_below_the_bar_are_not_read():
    block = {"ids": np.arange(4), "lengths": np.array([2, 2, 2, 2]), "terms": lexical.pa.array(["a", "b"]), "starts": np.array([0, 4, 6]), "members": np.array([0, 1, 2, 3, 0, 1]),
             "counts": np.array([1, 1, 1, 2, 1, 1]), "most": np.array([2, 1]), "shortest": np.array([2, 2])}
    query = {"terms": lexical.pa.array(["a", "b", "zz"]), "owners": np.array([0, 0, 1]), "weights": np.array([1.0, 2.0, 5.0])}
    numbers, ids, score = lexical._scored(block, query, np.full(2, -np.inf), 2.0, 2)
    assert numbers.tolist() == [0, 0] and ids.tolist() == [0, 1] and score.tolist() == pytest.approx([3.0, 3.0])
    assert lexical._scored(block, query, np.array([10.0, 0.0]), 2.0, 2) is None


def test_nearest_equals_brute_force(spark, monkeypatch):
    """Clusters far apart, so that blocks are skipped; vectors of two lengths, ties, NULLs and many blocks of queries."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "HELD", 2)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 4
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.1).tolist()) for i in range(400)] + [(400 + i, rng.normal(size=3).tolist()) for i in range(20)]
    rows += [(500, rows[7][1]), (501, rows[7][1]), (600, None), (601, []), (602, [1.0, None, 2.0]), (603, [1.0] * 5)]
    asked = [(q, rows[7 * q][1]) for q in range(20)] + [(20, rows[405][1]), (21, None), (22, [0.0] * 8), (23, [1.0, 2.0])]
    corpus = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    got = {}
    for r in vectors.nearest(spark.createDataFrame(asked, "query_id long, embedding array<double>"), corpus, 4).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    usable = [(i, v) for i, v in rows if v and None not in v]
    for q, v in asked:
        want = sorted([(-round(float(np.dot(v, w)), 9), i) for i, w in usable if len(w) == len(v)])[:4] if v else []
        assert [i for i, _ in got.get(q, [])] == [i for _, i in want], q
        assert [s for _, s in got.get(q, [])] == pytest.approx([-s for s, _ in want])
    assert sorted(r.chunk_id for r in vectors.unusable(corpus, 8).collect() if r.chunk_id >= 500) == [600, 601, 602, 603]


def test_reach_is_never_exceeded():
    rng = np.random.default_rng(3)
    for scale in (1e-3, 1.0, 1e4):
        centre = rng.normal(size=16) * scale
        rows, asked = centre + rng.normal(size=(50, 16)) * 0.05 * scale, rng.normal(size=(30, 16)) * scale
        apart = np.linalg.norm(rows - rows[0], axis=1)
        norms = np.linalg.norm(rows, axis=1)
        bound = vectors._reach(asked, rows[0], float(apart.min()), float(apart.max()), float(norms.max()))
        exact = asked @ rows.T
        assert (bound[:, None] >= exact).all()
        assert (bound < exact.max() * 50 + 1).any()


def test_scores_reach_every_document(spark):
    """Nodes and edges score in all documents that hold them; queries meet texts by classes of the same needles."""
    words = ("azot", "paxta", "vilt", "suv")
    nodes = [(d, w, "t", f"tavsif {w}") for d in range(6) for w in words[: 1 + d % 4]] + [(d, f"book-{d}", "b", "kitob") for d in range(6)]
    edges = [(d, f"book-{d}", w, "bor", "ichida") for d in range(6) for w in words[: 1 + d % 4]] + [(d, "azot", "paxta", "aloqa", "azot va paxta") for d in (1, 2, 5)]
    asked = {1: "azot paxtalik book", 2: "vilt ichidagi 5", 3: "yoq", 4: "azot paxta aloqa tavsif"}
    node_rows = spark.createDataFrame(nodes, "document_id long, node_id string, type string, description string")
    edge_rows = spark.createDataFrame(edges, "document_id long, source string, target string, type string, description string")
    texts = sorted({t for n in nodes for t in (n[1], n[3])} | {t for e in edges for t in e[1:]})
    classes = graph.text_classes(spark.createDataFrame(list(asked.items()), "query_id long, text string"), spark.createDataFrame([(t,) for t in texts], "text string"))

    def overlap(q, t):
        tokens = [w for w in asked[q].split() if len(w) >= 2]
        return sum(1.0 if w in t else 0.5 if len(w) >= 4 and w[: len(w) * 65 // 100] in t else 0.0 for w in tokens) / len(tokens)

    want = {(q, *n): overlap(q, n[1]) * 1.5 + overlap(q, n[3]) for q in asked for n in nodes}
    got = {tuple(r)[:-1]: r.score for r in graph.score_nodes(node_rows, *classes).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.2})
    want = {(q, *e): max(overlap(q, e[1]), overlap(q, e[2])) + overlap(q, e[3]) + 0.5 * overlap(q, e[4]) for q in asked for e in edges}
    got = {tuple(r)[:-1]: r.score for r in graph.score_edges(edge_rows, *classes).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.2})


def test_shared_seeds_expand_as_those_of_every_query(spark):
    """One expansion for all queries with the same seeds in a document; none is made per query and document."""
    words = ("azot", "paxta", "vilt", "suv")
    nodes = [(d, w, "t", f"tavsif {w}") for d in range(6) for w in words[: 1 + d % 4]] + [(d, f"book-{d}", "b", "kitob") for d in range(6)]
    edges = [(d, f"book-{d}", w, "bor", "ichida") for d in range(6) for w in words[: 1 + d % 4]] + [(d, "azot", "paxta", "aloqa", "azot va paxta") for d in (1, 2, 5)]
    asked = ["azot paxtalik", "paxta azotli", "vilt suv", "yoq", "book 5", "azot paxtalik", "tavsif", "kitob suv"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    node_rows = spark.createDataFrame(nodes, "document_id long, node_id string, type string, description string")
    edge_rows = spark.createDataFrame(edges, "document_id long, source string, target string, type string, description string")
    texts = sorted({t for n in nodes for t in (n[1], n[3])} | {t for e in edges for t in e[1:]})
    members, overlaps = graph.text_classes(queries, spark.createDataFrame([(t,) for t in texts], "text string"))
    plain = graph.seeds(graph.score_nodes(node_rows, members, overlaps), graph.score_edges(edge_rows, members, overlaps))
    rows = graph.classed(edge_rows, members, graph.LINKED)
    scored = graph.score_nodes(graph.first_nodes(node_rows), members, overlaps)
    found, starts, pairs = graph.shared_seeds(scored, rows, graph.score_edge_classes(rows, overlaps))
    want, got = sorted(map(tuple, plain.collect())), sorted(map(tuple, graph.for_queries(found, starts, pairs).collect()))
    assert got == want and len({r[:2] for r in want}) > found.select("query_id").distinct().count()


def test_alike_documents_are_walked_once(spark):
    """Documents that differ in their own name alone share a walk, unless the name changes its order; the first of all names are kept."""
    rng = np.random.default_rng(5)
    words = ("azot", "paxta", "vilt", "suv")
    names = [f"{('book', 'a', 'q', 'zz')[int(rng.integers(4))]}-{d}" for d in range(60)] + ["vilt", "book-1", "suv"]
    graphs = [words[: 1 + int(rng.integers(4))] for _ in names]
    kind = graph.K.DOCUMENT_NODE[0]
    nodes = [(d, w, "t", f"tavsif {w}") for d, g in enumerate(graphs) for w in g if w != names[d]] + [(d, n, kind, "kitob") for d, n in enumerate(names)]
    edges = [(d, names[d], w, "bor", "ichida") for d, g in enumerate(graphs) for w in g]
    edges += [(d, a, b, "aloqa", "") for d, g in enumerate(graphs) for a, b in zip(g, g[1:], strict=False)] + [(d, g[-1], names[d], "yana", "") for d, g in enumerate(graphs) if d % 3]
    asked = ["azot paxtalik", "vilt suv", "yoq", "book 5", "aloqa", "bor", "q 17 ichida", "zz"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    node_rows = spark.createDataFrame(nodes, "document_id long, node_id string, type string, description string")
    edge_rows = spark.createDataFrame(edges, "document_id long, source string, target string, type string, description string")
    texts = sorted({t for n in nodes for t in (n[1], n[3])} | {t for e in edges for t in e[1:]})
    members, overlaps = graph.text_classes(queries, spark.createDataFrame([(t,) for t in texts], "text string"))
    rows = graph.classed(edge_rows, members, graph.LINKED)
    scored = graph.score_nodes(graph.first_nodes(node_rows), members, overlaps)
    for cap, n in ((25, 3), (4, 7)):
        every, asked_all = graph.shared_starts(scored, rows, graph.score_edge_classes(rows, overlaps))
        alike = graph.alike_documents(rows, node_rows, scored, n)
        few = rows.join(alike, "document_id", "left_semi")
        starts, asked_few = graph.shared_starts(scored, few, graph.score_edge_classes(few, overlaps))
        whole, once = graph.walk(every, rows, cap=cap), graph.for_alike(graph.walk(starts, few, cap=cap), alike)
        assert starts.count() < every.count()
        for part, columns in (("nodes", ["node_id"]), ("touched", ["source", "target", "type"])):
            want, got = ({}, {})
            for walked_rows, hit, out in ((whole, asked_all, want), (once, asked_few, got)):
                for r in graph.first_for_queries(walked_rows, hit, part, columns, n).collect():
                    out.setdefault(r[0], set()).add(tuple(r[1:]))
            assert want and {q: sorted(v)[:n] for q, v in got.items()} == {q: sorted(v)[:n] for q, v in want.items()}


def test_graph_extraction_reads_no_vectors(spark, monkeypatch):
    """Chunks are profiled for searches only, and the nodes of a refresh are extracted once."""
    from verdant.queries import load
    from verdant.queries import standins as st

    def refused(text):
        raise AssertionError("no vector is needed")

    calls, extract = [], graph.extract_nodes
    monkeypatch.setattr(st, "letter_profile", refused)
    monkeypatch.setattr(graph, "extract_nodes", lambda *a: calls.append(1) or extract(*a))
    refreshed = load()[0]["graph_refresh"](spark, "/root/testdata/sf0.001")
    assert calls == [1] and "regexp" not in refreshed._jdf.queryExecution().optimizedPlan().toString()
    assert refreshed.filter("type = 'refreshed'").count() > 0


def test_walk_keeps_a_row_per_start(spark):
    """Every start is walked inside its row; a document without edges keeps its seeds, and a full one touches nothing."""
    edges = {("a", "b", "t"), ("b", "c", "t"), ("c", "d", "t"), ("a", "a", "t")}
    asked = [(0, 1, {"a": 0.0}, 25), (1, 1, {"b": 1.0, "d": 2.0}, 3), (2, 1, {"a": 0.0, "b": 0.0, "c": 0.0}, 3), (3, 2, {"x": 1.0}, 25)]
    edge_rows = spark.createDataFrame([(1, *e, "") for e in edges], "document_id long, source string, target string, type string, description string")
    for q, d, seeds, cap in asked:
        starts = spark.createDataFrame([(q, d, list(seeds.items()))], "query_id long, document_id long, seeds array<struct<node_id:string,score:double>>")
        (row,) = graph.walk(starts, edge_rows, cap=cap).collect()
        assert ({n.node_id for n in row.nodes}, {tuple(e) for e in row.touched}) == walked(edges if d == 1 else set(), seeds, 2, cap), q
        assert {n.node_id: n.score for n in row.nodes if n.depth == 0} == seeds


def test_graph_lookup_reads_texts_once_and_no_vectors(spark, monkeypatch):
    from verdant.queries import load
    from verdant.queries import standins as st

    def refused(*_):
        raise AssertionError("no vector of a chunk is needed")

    calls, mentions = [], graph._mentions
    monkeypatch.setattr(st, "embedded_chunks", refused)
    monkeypatch.setattr(graph, "_mentions", lambda *a: calls.append(1) or mentions(*a))
    assert load()[0]["graph_context"](spark, "/root/testdata/sf0.001").count() > 0 and calls == [1]


def test_letters_are_counted_in_batches(spark):
    """Odd texts, many slices and NULLs against a count per letter."""
    from verdant.queries import standins as st

    texts = ["", "abc zz", None, "Straße İi K", "aA" * 700, "12 ,."] * 400
    counts = st._letter_counts(lexical.pa.array(texts)).to_pylist()
    assert counts == [[None] * 26 if t is None else [float(t.count(c)) for c in st.LETTERS] for t in texts]
    (row,) = spark.createDataFrame([("Abba!",)], "t string").select(st.letter_profile(lexical.F.col("t")).alias("v")).collect()
    assert row.v == pytest.approx([2 / 8**0.5] * 2 + [0.0] * 24)


def test_blocks_know_how_many_chunks_hold_a_term(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CHUNKS", 2)
    texts = ["aa bb aa", "bb cc", "", "aa a", "cc aa"]
    corpus = lexical.corpus_statistics(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"))
    held = {}
    for r in corpus.blocks.collect():
        for term, n in zip(r.terms, r.held, strict=True):
            held[term] = held.get(term, 0) + n
    assert held == {"aa": 3, "bb": 2, "cc": 2} == {r.term: r.df for r in corpus.counts.collect()}
