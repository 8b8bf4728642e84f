"""Pivot search against all inner products."""

import math
import random

import pytest
from pyspark.sql import functions as F

from proofloom.llm import pivots


def plain(rows, k, every):
    good = sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    for q in sorted({i for i, _ in good if i % every == 0}):
        best = {}
        for _, a in [g for g in good if g[0] == q]:
            for i, b in good:
                if i != q:
                    s = sum(x * y for x, y in zip(a, b))
                    best[i] = max(best.get(i, s), s)
        for rank, (s, i) in enumerate(sorted((-s, i) for i, s in best.items())[:k], 1):
            yield q, rank, i, -s


@pytest.mark.parametrize("block, batch", [(8192, 2048), (16, 3)])
def test_equals_all_products(spark, monkeypatch, block, batch):
    monkeypatch.setattr(pivots, "BLOCK", block)
    monkeypatch.setattr(pivots, "BATCH", batch)
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(300, 420)] + [(500, [0.0] * 6), (501, [0.0] * 6)]
    rows += [(502, None), (503, [None] * 6), (504, [float("nan")] * 6), (505, [float("inf")] * 6), (None, [1.0] * 6), (510, [0.25, 1.0]), (520, []), rows[3], rows[5], (10, [0.9] * 6), (11, [0.9] * 6)]
    df = spark.createDataFrame([(v, i, 1, 2) for i, v in rows], "embedding array<float>, vec_id long, r int, score int")
    got = pivots.top_k(df, F.col("vec_id") % 10 == 0).collect()
    single = [(i, None if v is None else [None if x is None else float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got)) == sorted(plain(single, 5, 10))


def test_few_rows(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert pivots.top_k(df([]), F.col("vec_id") % 50 == 0).count() == 0
    assert pivots.top_k(df([(0, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0
    assert [tuple(r) for r in pivots.top_k(df([(0, [1.0]), (1, [-1.0])]), F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, -65536)]


def test_long_components_are_exact(spark):
    big = float(2**40)
    df = spark.createDataFrame([(0, [big, 1.0]), (1, [big, 1.0]), (2, [big, 0.0])], "vec_id long, embedding array<double>")
    got = pivots.top_k(df, F.col("vec_id") == 0, scale=1).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (2, 2**63 - 1)] and pivots._products(__import__("numpy").array([[big, 1.0]]), __import__("numpy").array([[2.0, 3.0]]))[0, 0] == 2**41 + 3


def test_every_annulus_in_parts(spark, monkeypatch):
    """All 64 x 16 annuli hold more vectors than a part may."""
    monkeypatch.setattr(pivots, "BLOCK", 1)
    rng = random.Random(12)
    rows = [(i, [float(rng.randrange(-40, 40)) / 64 for _ in range(4)]) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = pivots.top_k(df, F.col("vec_id") % 800 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, 5, 800))


def test_queries_ask_in_bounded_slices(spark, monkeypatch):
    import pandas as pd

    frames = [pd.DataFrame({"n": range(10)}), pd.DataFrame({"n": []}), pd.DataFrame({"n": range(3)})]
    assert [list(f["n"]) for f in pivots._slices(iter(frames), 4)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9], [0, 1, 2]]
    assert [len(f) for f in pivots._slices(iter(frames), 0)] == [1] * 13
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(pivots, "SENT_ROWS", 1)  # one query at a time
    assert sorted(map(tuple, pivots.top_k(df, F.col("vec_id") % 10 == 0).collect())) == sorted(plain(rows, 5, 10))
