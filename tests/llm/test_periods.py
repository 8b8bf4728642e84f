"""Periodic runs against a plain search over all lags."""

import random

import numpy as np
import pyarrow as pa
import pytest

from proofloom.llm import periods as P
from proofloom.llm import words as W


def plain(w, least=24, times=3):
    """(start, length, period) of all runs of a list, by start, then period."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            part = w[s:i + q]
            if len(part) >= max(least, times * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((s, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def document(rng):
    n, kinds = rng.randrange(160), rng.choice([1, 2, 3, 5, 40])
    words = [str(rng.randrange(kinds)) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        base = [str(rng.randrange(kinds)) for _ in range(rng.randrange(1, 25))]
        at, size = rng.randrange(n + 1), len(base) * rng.randrange(2, 6) + rng.randrange(len(base))
        words[at:at + size] = [base[i % len(base)] for i in range(size)]
    return words


@pytest.mark.parametrize("least", [24, 9, 3])
def test_scan_equals_plain_search(least):
    rng = random.Random(least)
    for _ in range(300):
        docs = [document(rng) for _ in range(3)]
        flat = [x for d in docs for x in d]
        codes, text = np.unique(flat, return_inverse=True)[1].astype(np.int64) if flat else np.zeros(0, np.int64), np.repeat(np.arange(3), [len(d) for d in docs])
        got = list(zip(*(x.tolist() for x in P.lag_scan(codes, *P.segments(codes, text, least), least))))
        begin = np.cumsum([0] + [len(d) for d in docs])
        assert got == [(int(s + b), l, q) for d, b in zip(docs, begin) for s, l, q in plain(d, least)]


def test_rare_words_split_until_stable():
    """`x` stands three times over all, but once in each part that the rare words leave."""
    words = ["a", "b"] * 15 + ["x"] + ["a", "b"] * 15 + ["r1", "x", "r2"] + ["c"] * 23 + ["r3", "x"]
    codes = np.unique(words, return_inverse=True)[1].astype(np.int64)
    place, segment = P.segments(codes, np.zeros(len(words), np.int64))
    assert place.tolist() == [*range(30), *range(31, 61)] and len(set(segment.tolist())) == 2


def test_words_and_slices():
    texts = [b"", b"  A b\tA\nc", None, "é ¡ b".encode(), b"b", b"x" * 50]
    got = W.cut(pa.array(texts, pa.binary()), W.separators(b" \t", b"\n"), lower=True)
    values = [v.as_py() for v in got.values]
    assert [values[c] for c in got.codes] == [b"a", b"b", b"a", b"c", "é".encode(), "¡".encode(), b"b", b"b", b"x" * 50]
    assert got.begins.tolist() == [0, 0, 4, 4, 7, 8, 9] and got.first.tolist() == [True, False, False, True, True, False, False, True, True]
    parts = list(W.slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).slice(1)], ["t"])]), 0, 12))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts[1:] and max(len(p) for p in parts) > 1


def test_rows(spark):
    rng = random.Random(8)
    docs = [document(rng) for _ in range(60)] + [["w"] * 30, ["w"] * 23, ["long", "text"] * 30_000]
    rows = [(i % 50, " ".join(d)) for i, d in enumerate(docs)] + [(None, None), (7, ""), (8, " \n\t"), (9, "  " * 24), (1, "tie tie " * 12 + "x " + "tie tie " * 12)]
    df = spark.createDataFrame([(t, i, 1, "r") for i, t in rows], "text string, doc_id long, n_words int, runs string")
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed, tuple(r.best or ())) for r in P.runs(df).withColumn("best", P.strongest(P.F.col("runs"))).collect())
    want = []
    for i, t in rows:
        w = [x for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        found = plain(w) if len(w) < 1000 else [(0, len(w), 2)]
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=())
        want.append((str(i), len(w), found, " ".join(x for k, x in enumerate(w) if k not in gone), best))
    assert got == sorted(want)
    assert spark.createDataFrame([(1, "x " * 30)], "doc_id long, text string").transform(P.runs).select(P.listed(P.F.col("runs"))).first()[0] == "0,30,1\n"


def test_empty(spark):
    assert P.runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
