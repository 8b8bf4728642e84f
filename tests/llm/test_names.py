"""Exact duplicates by block names against grouping by text."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from proofloom.llm import names as N


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows):
    """doc_id, keep_id, group_size, sha of each row, and how many rows of each text are kept."""
    ids = defaultdict(list)
    for i, t in rows:
        ids[lower(t)].append(i)
    best = {t: max((i for i in found if i is not None), default=None) for t, found in ids.items()}
    return sorted(((i, best[lower(t)], len(ids[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows), key=repr)


def texts():
    rng = random.Random(3)
    some = ["".join(rng.choices("abAé\n", k=rng.randrange(40))) for _ in range(60)]
    return some + [t.upper() for t in some] + ["", None, "x" * 100_000, "x" * 99_999 + "y", "X" * 100_000, "İ", "i̇", "ÀB", "àb", "Àb", "ab" * 8, "ab" * 7, "ab" * 4 + "ba" * 4]


@pytest.mark.parametrize("route", [F.xxhash64, lambda b: F.octet_length(b).cast("long"), lambda b: F.lit(7).cast("long")], ids=["hash", "length", "one"])
@pytest.mark.parametrize("size", [4, 4096])
def test_groups_equal_grouping_by_text(spark, size, route):
    if size == 4:  # thousands of blocks of the long texts are not needed here
        found = [t for t in texts() if len(t or "") < 1000]
    else:
        found = texts()
    rows = [(i * 7 % 1000, t) for i, t in enumerate(found)] + [(None, "ab" * 8), (5, "once more"), (5, "once more"), (5, "ONCE more"), (None, None)]
    df = spark.createDataFrame([(t, i, 1, "k", "r") for i, t in rows], "text string, doc_id long, name int, `row` string, __sha string").repartition(5)
    got = N.groups(df, size=size, route=route).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == plain(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({lower(t) for _, t in rows}) and all(r.doc_id == r.keep_id for r in kept)


def test_levels_are_kept_apart(spark):
    """A pair without a second is not the text that ends there, and names of one level say nothing on another."""
    rows = [(1, "aaaa"), (2, "aaaaaaaa"), (3, "aaaaaaaaaaaa"), (4, "aaaaaaaaaaaaaaaa"), (5, "aaaaaaaaaaaa")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in N.groups(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (5, 2), 4: (4, 1), 5: (5, 2)}


def test_keep_last_keeps_columns(spark):
    df = spark.createDataFrame([(1, "A", "x"), (2, "a", "y"), (2, "a", "y"), (3, None, "z"), (4, "", "w")], "doc_id long, text string, `a.b` string")
    assert sorted(map(tuple, N.keep_last(df).collect())) == [(2, "a", "y"), (4, "", "w")]


def test_empty(spark):
    assert N.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
