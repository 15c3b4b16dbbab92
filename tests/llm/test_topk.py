from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from verdant.llm import topk

SCHEMA = "vec_id long, embedding array<double>, x int, own string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a") for i, v in rows], SCHEMA)


def plain(rows, every, k=5, scale=256):
    usable = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(scale * x) for x in v):
            continue
        usable.append((i, [math.floor(scale * x) for x in v]))
    out = []
    for a, (i, q) in enumerate(usable):
        if i % every:
            continue
        scored = [(-max(min(sum(x * y for x, y in zip(q, v)), (1 << 63) - 1), -(1 << 63)), j) for b, (j, v) in enumerate(usable) if b != a and len(v) == len(q)]
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(spark, rows, every, **options):
    return sorted(map(tuple, topk.search(table_of(spark, rows), F.col("vec_id") % every == 0, **options).collect()))


@pytest.mark.parametrize("dim", [1, 3, 16, 24])
def test_equals_brute_force_over_many_blocks(spark, monkeypatch, dim):
    for name, value in (("ROWS", 16), ("SLAB", 3), ("GROUP", 2), ("CHUNK", 3)):
        monkeypatch.setattr(topk, name, value)
    rnd = random.Random(dim)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = [(i, [c + rnd.gauss(0, 0.2) for c in rnd.choice(centres)]) for i in range(300)]
    assert found(spark, rows, 10) == plain(rows, 10)


def test_pruning_with_few_survivors(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 64)
    seen = []
    listed = topk.np.nonzero
    rnd = random.Random(2)
    rows = [(i, [(10.0 if i % 8 == 0 else 0.1) * (1 + rnd.random()) for _ in range(16)]) for i in range(256)]
    monkeypatch.setattr(topk.np, "nonzero", lambda x: seen.append(x.mean()) or listed(x))
    x = topk.np.array([v for _, v in rows])
    bars = topk.np.array([float(topk.np.sort(x @ x[0])[-5])])
    got = topk.best(x[:1], bars, x, topk.np.arange(256), 5)
    assert seen and max(seen) < topk.FEW
    assert sorted(got[0][0].tolist()) == sorted(topk.np.argsort(-(x @ x[0]), kind="stable")[:5].tolist())


def test_copies_ties_and_rows_that_take_no_part(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 8)
    rows = [(i, [0.5, 0.25, -1.0]) for i in range(60)] + [(100 + i, [0.5, 0.25, -1.0 + i / 512]) for i in range(20)]
    rows += [(0, [0.5, 0.25, -1.0]), (40, [1.0]), (41, [2.0]), (20, [-1.0, 1.0]), (30, []), (31, [])]
    rows += [(50, None), (10, [None, 1.0, 1.0]), (20, [math.nan, 1.0, 1.0]), (30, [math.inf, 0.0, 0.0]), (None, [9.0, 9.0, 9.0]), (10, [1e307, 0.0, 0.0])]
    got, want = found(spark, rows, 10), plain(rows, 10)
    assert got == want
    assert [r for r in got if r[0] == 40 and r[2] == 41] == [(40, 1, 41, 256 * 512)]


def test_large_components_are_exact(spark):
    rows = [(i, [1e12 + i * 7, -1e9 * i, 3.0]) for i in range(30)] + [(50, [1e18, 1.0, 1.0]), (60, [-1e200, 1e190, 0.0])]
    assert found(spark, rows, 10, k=3) == plain(rows, 10, k=3)


def test_few_and_no_rows(spark):
    assert found(spark, [], 2) == []
    assert found(spark, [(2, [1.0])], 2) == []
    assert found(spark, [(2, [1.0]), (3, [-2.0])], 2) == [(2, 1, 3, -2 * 256 * 256)]
    assert found(spark, [(1, [1.0]), (3, [-2.0])], 2) == []


def test_bounds_hold():
    rnd = topk.np.random.default_rng(1)
    for dim in (2, 7, 64):
        a, b = (topk.np.floor(rnd.normal(0, 100, (40, dim))) for _ in range(2))
        before = None
        for starts in topk.levels(dim):
            bound = topk.statistics(a, starts) @ topk.statistics(b, starts).T
            assert (bound + 1e-6 >= a @ b.T).all()
            before = bound if before is None else before
        assert (before + 1e-6 >= a @ b.T).all()
