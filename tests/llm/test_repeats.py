"""The run-length index and the removal of long repeats against plain search."""

import hashlib
import random

import numpy as np
import pytest

from proofloom.llm import repeats as R


def plain(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + 1
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        yield gone


def texts_of(rng, n, alphabet):
    texts = [bytes(rng.choices(alphabet, k=rng.randrange(120))) for _ in range(n)]
    for _ in range(n):
        a, b = rng.choice(texts), rng.choice(texts)
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        texts.append(a[:i] + b[j:j + rng.randrange(60)] + a[i:])
    return texts + [b"", b"ab" * 90, b"abc" * 50, b"\0" * 100, texts[3]]


@pytest.mark.parametrize("seed", range(5))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    texts = texts_of(rng, 12, b"ab\0" if seed % 2 else bytes(range(256)))
    index = R.RunLengthIndex(texts)
    got = index.statistics()
    places = [(k, i) for k, t in enumerate(texts) for i in range(len(t))]
    for k, i in rng.sample(places, 150):
        want = max((next((n for n in range(min(len(texts[k]) - i, len(texts[q]) - j) + 1) if texts[k][i:i + n + 1] != texts[q][j:j + n + 1] or n == min(len(texts[k]) - i, len(texts[q]) - j)))
                    for q, j in places if (q, j) != (k, i)), default=0)
        assert got[index.begins[k] + i] == want
    assert index.runs <= len(index.symbols)


@pytest.mark.parametrize("block", [1 << 20, 37])
def test_segments_own_each_window_once(monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rng = random.Random(block)
    owner = {}
    for t in texts_of(rng, 20, b"abc"):
        starts = []
        for anchor, a, b in R.segments(t, 24, 8):
            for i in range(a, b - 23):
                starts.append(i)
                assert owner.setdefault(t[i:i + 24], anchor) == anchor
        assert starts == list(range(max(0, len(t) - 23)))


@pytest.mark.parametrize("part, batch", [(1024, 1_000_000), (2, 100)])
def test_dedup_equals_plain_search(spark, monkeypatch, part, batch):
    monkeypatch.setattr(R, "PART", part)
    monkeypatch.setattr(R, "BATCH", batch)
    rng = random.Random(part)
    texts = [t.decode("latin-1").replace("\0", "é") for t in texts_of(rng, 40, b"abcd\0")]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (900, None), (901, ""), (5, texts[5]), (902, "xyz" * 3000), (903, "p" + texts[6] + "q" * 50)]
    df = spark.createDataFrame([(t, i, 1, b"") for i, t in rows], "text string, doc_id long, key int, kept binary")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans or []), r.kept_sha256) for r in R.dedup(df, length=24).collect())
    data = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), t, gone in zip(rows, data, plain(data, 24)):
        left = bytes(b for b, g in zip(t, gone) if not g)
        want.append((str(i), len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    assert got == sorted(want)


def test_empty(spark):
    assert R.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shared_passage(rng, n):
    """Texts of their own with one passage of 40 bytes in all of them, some equal, some with more in common."""
    letters = b"abcdefghijklmnop"
    passage = bytes(rng.choices(letters, k=40))
    texts = [bytes(rng.choices(letters, k=rng.randrange(5, 30))) + passage + bytes(rng.choices(letters, k=rng.randrange(5, 30))) for _ in range(n)]
    return texts + texts[:5] + [t[:-3] + b"xyz" for t in texts[:5]] + [passage + t for t in texts[5:10]]


def written_records(spark):
    """Shuffle records of all stages so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_work_of_a_common_passage_grows_with_its_documents(spark, monkeypatch):
    monkeypatch.setattr(R, "PART", 2)
    moved = []
    for n in (100, 400):
        texts = shared_passage(random.Random(n), n)
        df = spark.createDataFrame(list(enumerate(t.decode() for t in texts)), "doc_id long, text string")
        before = written_records(spark)
        got = sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in R.dedup(df, length=24).collect())
        moved.append(written_records(spark) - before)
        assert got == [(i, int(gone.sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()) for i, (t, gone) in enumerate(zip(texts, plain(texts, 24)))]
    assert moved[1] < 6 * moved[0]


def test_cuts_own_each_window_once(spark):
    texts = shared_passage(random.Random(3), 60)
    pieces = [(anchor, i, a, 0, None, bytearray(t[a:b])) for i, t in enumerate(texts) for anchor, a, b in R.segments(t, 24, 8)]
    df = spark.createDataFrame(pieces, "anchor long, c1 long, c2 long, start int, place int, bytes binary")
    want = sorted((i, j) for i, t in enumerate(texts) for j in range(len(t) - 23))
    for width in (4, 1):
        df = R._cut(df, 24, 8, width)
        rows, owner = df.collect(), {}
        assert sorted((r.c1, r.c2 + r.start + k) for r in rows for k in range(r.size - 23)) == want
        for r in rows:
            assert len(r.bytes) == r.size and texts[r.c1][r.c2 + r.start:r.c2 + r.start + r.size] == r.bytes
            for k in range(r.size - 23):
                assert owner.setdefault(bytes(r.bytes[k:k + 24]), (r.g1, r.g2)) == (r.g1, r.g2)
    assert {r.size for r in rows} == {24}


def test_passages_of_over_50_words_go_from_400_bytes_on(spark):
    rng = random.Random(9)

    def words(n):
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzäß", k=6)) for _ in range(n))

    def cut(size):  # a passage of over 50 words of exactly so many bytes
        text = words(70)
        while len(text.encode()) > size - 1:
            text = text[:-1]
        return text + "x" * (size - len(text.encode()))

    passages = [cut(399), cut(400), cut(430)]
    texts = [words(20) + f" {k}" + passages[i] + f"{k} " + words(20) for i in range(3) for k in "pq"] + [words(150)]
    assert all(len(p.split()) > 50 for p in passages)
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in R.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i][0] for i in range(7)] == [len(t.encode()) for t in texts]
    assert [got[i][1] for i in range(7)] == [0, 0, 400, 400, 430, 430, 0]
