"""The network's pooling, gradients by held-out accuracy, and edge rows."""

import random
import zlib

import numpy as np
import pytest

from proofloom.llm import quality as Q
from proofloom.llm.toxicity import learnable


@pytest.mark.parametrize("n", [1, 63, 64, 65, 191, 192, 193, 256, 257, 448, 449, 5000, 16384, 16385, 40000])
def test_pooled_equals_plain_chunks(n):
    net = Q.Network.fresh(np.random.default_rng(0))
    text = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
    pooled, filled = net.pooled(text)
    data = np.frombuffer(text + bytes(Q.WIDTH), np.uint8)
    values = net.convolved(data, n)
    covered = np.zeros(n, bool)
    for k in range(len(pooled)):
        lo, hi = k * Q.STRIDE, min(n, k * Q.STRIDE + Q.CHUNK)
        covered[lo:hi] = True
        assert np.allclose(pooled[k], np.maximum(values[lo:hi].max(0) + net.bias, 0)) and np.isclose(filled[k], (hi - lo) / Q.CHUNK)
    assert covered.all()


def test_held_out_accuracy_and_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(Q, "BATCH", 8)
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 8)))
    rows, labels = [], []
    for i in range(500):
        words = [word() for _ in range(rng.randrange(5, 120))]
        good = i % 3 > 0
        if not good:
            words = [w + "%%%" for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good)))
    extra = [(900, None), (901, ""), (None, "abc def"), rows[0], (902, "abc def " * 50_000)]
    df = spark.createDataFrame([(t, i, 1) for i, t in rows + extra], "text string, doc_id long, label int")
    lab = spark.createDataFrame(labels + [(None, 1), (5, None), (6, 9)], "doc_id long, quality int")
    got = Q.classify(df, lab, "quality", learnable(lab["doc_id"], 1, 3)).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 100 and sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held) >= 0.95 * len(held)


def test_empty_tables(spark):
    lab = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert len(Q.classify(one, lab.limit(0)).collect()) == 1 and Q.classify(one.limit(0), lab).count() == 0
