"""Exact and near benchmark matches against plain loops."""

import random
import re

import pytest

from proofloom.llm import leaks

LOWER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, window):
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for item, t in items:
            iw = split(t)
            n = min(len(iw), window)
            wins = {tuple(iw[k:k + n]) for k in range(len(iw) - n + 1)} if iw else set()
            for k in range(len(w) - n + 1 if wins else 0):
                if tuple(w[k:k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found.add("" if item is None else str(item))
        yield i, len(w), len(hit), ",".join(sorted(found)), bool(hit)


@pytest.mark.parametrize("window", [3, 10])
def test_contamination_equals_plain_search(spark, window):
    rng = random.Random(window)
    text = lambda n: " ".join(rng.choice(["a", "b", "c", "Dé", "ß9", "É"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 4, 9, 10, 14]))) for k in range(8 if window == 10 else 2)] + [(100, None), (101, ""), (102, "--"), (None, "unseen words only"), (9, text(20))]
    items += [(10, items[-1][1]), (9, items[-1][1].upper())]
    docs = [(i, text(rng.randrange(40))) for i in range(60)]
    for i in range(20):
        d = split(rng.choice(docs)[1])
        p = split(rng.choice(items)[1])
        docs.append((100 + i, "Pre, " + "-".join(d[:5] + p + d[5:])))
    docs += [(None, docs[-1][1]), (5, None), (6, ""), (7, "..."), docs[-2], (200, text(3000) + items[-1][1])]
    df = spark.createDataFrame([(t, i, 1, "x") for i, t in docs], "text string, doc_id long, n int, words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = leaks.contamination(df, bench, window=window).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got))) == sorted(map(str, plain(docs, items, window)))
    bad = sum(x[4] for x in plain(docs, items, window))
    left = leaks.clean(df, bench, window=window)
    assert left.columns == df.columns and left.count() == len(docs) - bad


def test_proximity(spark):
    df = spark.createDataFrame([(1, "x rare y z words"), (2, "rare " + "y " * 30 + "words"), (3, "words rare")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "rare words")], "item_id long, text string")
    got = leaks.proximity(leaks.build(df, bench), slop=3).collect()
    assert sorted((r.doc_id, r.off) for r in got) == [(1, 2), (3, 2)]


@pytest.mark.parametrize("docs, items", [([], [(1, "a b")]), ([(1, "a b")], []), ([], [])])
def test_empty_tables(spark, docs, items):
    got = leaks.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got.collect()] == [(2, 0, False)] * len(docs)
