"""The stages of the pipeline, each against a plain version over its own input."""

import re

import pytest

import corpus_pipeline as P
from proofloom.llm import toxicity as T
from proofloom.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [{r.doc_id: r for r in docs.collect()}]
    for name, stage in P.STAGES:
        docs = P.stored(stage(spark, docs, SF), name)
        rows = docs.collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        out.append({r.doc_id: r for r in rows})
        if name != P.STAGES[-1][0]:
            assert docs.columns == P.COLUMNS
    return out


def test_names():
    assert [name for name, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mix_sources"]


def test_toxic_documents_go(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in T.classify(spark.read.parquet(f"{SF}/documents.parquet"), labels, "toxic", T.learnable(labels["doc_id"], 0, 5)).collect()}
    assert set(steps[1]) == {i for i, s in scores.items() if s < 0.5} and all(steps[1][i] == steps[0][i] for i in steps[1])


def test_boilerplate_lines_go(steps):
    sites, home = {}, {}
    for i, r in sorted(steps[1].items()):
        for k, line in enumerate(r.text.split("\n")):
            if x := line.strip(" \t\r"):
                sites.setdefault(x, set()).add(r.source)
                home.setdefault(x, (i, k))
    assert set(steps[2]) == set(steps[1])
    for i, r in steps[1].items():
        kept = [line for k, line in enumerate(r.text.split("\n")) if not (x := line.strip(" \t\r")) or len(sites[x]) < 10 or home[x] == (i, k)]
        assert steps[2][i].text == "\n".join(kept) and steps[2][i].n_chars == len(steps[2][i].text)


def test_one_of_near_duplicates_stays(steps):
    fps = {i: fingerprint(r.text.encode()) % 2**64 for i, r in steps[2].items()}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(steps[3]) == {find(i) for i in ids}


def test_benchmark_text_goes(spark, steps):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9))}
    assert all(len(w) == 10 for w in windows)
    hit = {i for i, r in steps[3].items() if any(tuple(w[k:k + 10]) in windows for w in [words(r.text)] for k in range(len(w) - 9))}
    assert hit and set(steps[4]) == set(steps[3]) - hit


def test_mix_counts_all_that_is_left(steps):
    assert set(steps[5]) == set(steps[4])
    taken, goal = {}, {}
    for r in steps[5].values():
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", steps[4][r.doc_id].text)) and 0 <= r.taken <= 3 * r.size
        taken[r.source], goal[r.source] = taken.get(r.source, 0) + r.taken, r.target
    assert all(abs(taken[s] - goal[s]) < 1 for s in goal)


def test_near_duplicates_by_all_pairs_of_shingle_sets(steps):
    """One document of each group linked by five-word shingle sets with a Jaccard similarity of 0.8 stays, the one with the smallest id."""
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}

    sets = {i: shingles(r.text) for i, r in steps[2].items()}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(steps[3]) == {find(i) for i in ids} and len(steps[3]) < len(ids)
