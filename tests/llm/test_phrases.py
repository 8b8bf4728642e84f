"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from proofloom.llm import phrases as P


def grams(rows, longest):
    """(lang, words) of every place, and words per language."""
    found, n = Counter(), Counter()
    for lang, text in rows:
        lower = "".join(c.lower() if c < "\x80" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang or "und"] += len(words)
            for i in range(len(words)):
                for m in range(1, min(longest, len(words) - i) + 1):
                    found[lang or "und", tuple(words[i:i + m])] += 1
    return found, n


def plain(rows, longest, least, top, share):
    f, n = grams(rows, longest)
    f = {k: c for k, c in f.items() if c >= least}
    scored = []
    for (lang, w), a in f.items():
        if len(w) > 1:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            around = [c for (other, v), c in f.items() if other == lang and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v)))]
            if not any(100 * c >= share * a for c in around):
                scored.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    out, place = [], Counter()
    for lang, score, a, phrase, l, r, total in sorted(scored):
        place[lang] += 1
        if place[lang] <= top:
            out.append((lang, place[lang], phrase.decode(), -a, l, r, total, -score))
    return out


def rows():
    rng = random.Random(5)
    words = ["the", "of", "New", "york", "city", "é", "ÀB", "a", "b", "c"]
    def text():
        parts = []
        for _ in range(rng.randrange(60)):
            parts += rng.choice([["New", "York", "City"], ["the", "of"], [rng.choice(words)], ["a", "b", "a", "b", "c"], [rng.choice([".", ", ", "\n", "!\r"])]])
        return rng.choice([" ", "  ", "\t"]).join(parts)
    return [(rng.choice(["en", "de", None, "x y"]), text()) for _ in range(120)] + [("en", "hot one hot two " * 300), ("en", None), (None, ""), ("fr", ".,;"), ("de", "same same same same")] + [("de", "copy of a copy")] * 9


@pytest.mark.parametrize("hot, longest, share", [(1 << 16, 5, 100), (3, 5, 100), (20, 3, 60)])
def test_equals_plain_counting(spark, monkeypatch, hot, longest, share):
    monkeypatch.setattr(P, "HOT", hot)
    data = rows()
    df = spark.createDataFrame([(i, t, l, 1, "r") for i, (l, t) in enumerate(data)], "rank long, text string, lang string, n int, route string").repartition(7)
    for least, top in ((9, 1000), (20, 5)):
        got = P.collocations(df, least=least, top=top, longest=longest, share=share)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == sorted(plain(data, longest, least, top, share))


def test_products_beyond_64_bits(spark):
    """Counts near a million million: the score is still the exact floor."""
    from pyspark.sql import functions as F
    a, n, left, right = 10**12 + 7, 9 * 10**15 + 1, 10**12 + 9, 10**12 + 11
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in dict(a=a, n=n, l=left, r=right).items()))
    assert row.select(P.cut_score()).first()[0] == 1000 * a * n // (left * right)


@pytest.mark.parametrize("seed", range(4))
def test_quicksort_counts_prefixes(seed):
    rng = np.random.default_rng(seed)
    rows, n = rng.integers(0, 4, (300, 4)), rng.integers(1, 5, 300)
    for r in rows:
        r[rng.integers(1, 5):] = -1
    want = Counter()
    for r, c in zip(rows.tolist(), n.tolist()):
        for d in range(1, 5):
            if r[d - 1] >= 0:
                want[tuple(r[:d])] += c
    got = {tuple(rows[i, :d].tolist()): c for i, d, c in P.quicksort(rows, n, 12)}
    assert got == {k: c for k, c in want.items() if c >= 12}


def test_without_pruning_and_in_small_batches(monkeypatch):
    """The map of frequent pairs only saves work; routes that go over several batches stay whole."""
    monkeypatch.setattr(P, "ROWS", 50)
    data = rows()
    batch = pa.RecordBatch.from_arrays([pa.array([l or "und" for l, _ in data]), pa.array([(t or "").encode() for _, t in data], pa.binary())], ["lang", "text"])
    for hot in (np.zeros(0, np.int64), np.unique(P._bucket(P._pairs(*P._cut(batch))[1]))[::2]):
        found = pa.Table.from_batches([P.pointers(batch, np.full(1 << (P.MAP_BITS - 3), 255, np.uint8), hot, routes=40)]).sort_by("route")
        got = Counter()
        for out in P.sort_routes(iter(found.to_batches(max_chunksize=7)), 9, 5):
            for lang, phrase, n in zip(*(c.to_pylist() for c in out.columns)):
                got[lang, tuple(phrase.split(" "))] += n
        assert {k: c for k, c in got.items() if c >= 9} == {k: c for k, c in grams(data, 5)[0].items() if c >= 9 and len(k[1]) > 1}


def test_empty(spark):
    assert P.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
