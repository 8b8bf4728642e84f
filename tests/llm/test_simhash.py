"""SimHash links and components against all pairs."""

import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from proofloom.llm import simhash
from proofloom.llm.common import components


def plain(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(grams)) if grams else 0


def closed(ids, near):
    """Smallest id reachable, by plain repetition."""
    best = dict(ids)
    while True:
        new = {k: min([best[k], *(best[o] for o in best if near(k, o))]) for k in best}
        if new == best:
            return best
        best = new


def text_of(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=3)) for _ in range(n))


def docs_of(rng):
    texts = [text_of(rng, rng.choice([0, 1, 3, 4, 5, 60])) for _ in range(30)]
    for _ in range(40):
        words = rng.choice(texts).split()
        if words:
            words[rng.randrange(len(words))] = "x"
        texts.append(" ".join(words))
    return list(enumerate(texts, 5)) + [(2, None), (3, ""), (4, " \t\r\n\x0b\x0c"), (7, texts[2]), (None, texts[1]), (900, "Ünder THE Bridge"), (901, "Ünder the bridge"), (902, "ünder the bridge")]


@pytest.mark.parametrize("cold", [1, 32])
def test_components_equal_all_pairs(spark, monkeypatch, cold):
    monkeypatch.setattr(simhash, "COLD", cold)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rows = docs_of(random.Random(3))
    df = spark.createDataFrame([(t, i, "s", 0) for i, t in rows], "text string, doc_id long, key string, fp int")
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = {}
    for i, t in rows:
        fps.setdefault(plain(t), []).append(i)
    least = {f: min((i for i in ids if i is not None), default=10**9) for f, ids in fps.items()}
    roots = closed(least, lambda a, b: bin(a ^ b).count("1") <= 4)
    assert got == sorted(((i, plain(t), roots[plain(t)]) for i, t in rows), key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(roots.values()))


def test_spark_hash_is_the_same(spark):
    texts = ["a", "é b c d", "x" * 200]
    got = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t) h").collect()
    assert [r.h % 2**64 for r in got] == [xxh64_intdigest(t.encode(), 42) for t in texts]


def test_masks_are_pigeonholes():
    rng = random.Random(1)
    for distinct in (10, 10**5, 10**8):
        masks = [m % 2**64 for m in simhash.block_masks(4, distinct)]
        for _ in range(300):
            flip = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(flip & m == 0 for m in masks)


def test_forest_of_a_dense_group():
    rng = np.random.default_rng(0)
    fps = np.unique(rng.integers(0, 2**14, 3000).astype(np.uint64) << np.uint64(20))
    a, b = simhash.forest(fps, 4)
    assert len(a) == len(fps) - 1 and (np.bitwise_count(a ^ b) <= 4).all()


def test_long_texts_in_steps(monkeypatch):
    text = text_of(random.Random(2), 500)
    monkeypatch.setattr(simhash, "STEP", 7)
    assert simhash.fingerprint(text.encode()) % 2**64 == plain(text)


def test_components_of_chains(spark):
    rng = random.Random(0)
    ids = rng.sample(range(10**6), 60)
    links = list(zip(ids[:40], ids[1:40])) + [(ids[50], x) for x in ids[51:]]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: min(ids[:40]) for x in ids[:40] if x != min(ids[:40])} | {x: min(ids[50:]) for x in ids[50:] if x != min(ids[50:])}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_one(df).count() == 0


def gram_set(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("cold, chunk", [(32, 4096), (1, 4096), (1, 7)])
def test_similar_texts_equal_all_pairs(spark, monkeypatch, cold, chunk):
    monkeypatch.setattr(simhash, "COLD", cold)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(5)
    texts = [text_of(rng, rng.choice([0, 1, 4, 5, 90])) for _ in range(12)]
    for _ in range(70):  # edits of edits, so groups are chains and no set is near all others
        words = rng.choice(texts).split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            if words:
                words[rng.randrange(len(words))] = "x" + str(rng.random())
        texts.append(" ".join(words))
    rows = list(enumerate(texts, 5)) + [(2, None), (3, ""), (4, " \t"), (7, texts[2]), (None, texts[1])]
    sets = {i: gram_set(t) for i, t in rows if i is not None and (i, t) != (7, texts[2])}
    edges = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    far = [(a, b) for a, b in edges if bin(plain(dict(rows)[a]) ^ plain(dict(rows)[b])).count("1") > 4]
    roots = closed({i: i for i in sets}, lambda a, b: (a, b) in edges or (b, a) in edges)
    assert len(far) > 20  # what four bits would miss
    df = spark.createDataFrame([(t, i, "s") for i, t in rows if (i, t) != (7, texts[2])], "text string, doc_id long, key string")
    kept = simhash.keep_one(df, shingle=5, similarity=0.8)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(roots.values()))


def test_similar_texts_of_an_empty_table(spark):
    assert simhash.keep_one(spark.createDataFrame([], "doc_id long, text string"), shingle=5, similarity=0.8).count() == 0


def test_simhash_blocks_link_similar_texts_without_minima(spark):
    """With no bands of minima the pigeonhole blocks alone find every similar pair within the bits."""
    rng = random.Random(11)
    base = [text_of(rng, 150) for _ in range(12)]
    rows = []
    for text in base:
        for cut in (0, 1, 2, 8, 40):
            words = text.split()
            for k in rng.sample(range(len(words)), cut):
                words[k] = "x"
            rows.append(" ".join(words))
    rows += ["", " ", "a b"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    sets = [simhash.shingle_set(t.encode(), 5) for t in rows]
    fps = [simhash.simhash([s]) % 2**64 for s in sets]
    alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    near = lambda a, b: alike(a, b) and (fps[a] ^ fps[b]).bit_count() <= 4
    ids = dict.fromkeys(range(len(rows)))
    best = closed({i: i for i in ids}, near)
    found = {r.doc_id: r.root for r in simhash.similar(df, bands=0).collect()}
    groups = lambda of: {frozenset(i for i in ids if of[i] == of[k]) for k in ids}
    assert groups(found) == groups(best) and len(set(best.values())) < len(rows) - 5
