"""Targets, schedule and word counts of the mix against plain loops."""

import random
import re
from fractions import Fraction

import pytest

from proofloom.llm import mixing


def plain_targets(size):
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        share = {s: 3 * size[s] if s in capped else Fraction(left * weight[s], free) for s in names}
        over = {s for s in names if share[s] > 3 * size[s]}
        if not over:
            return share
        capped |= over


def rows_of(seed):
    rng = random.Random(seed)
    sources = ["b", "a", "a", "a", "a", "ä", None, "Z", "empty"]
    rows = [(i if i % 17 else None, " ".join("w" * rng.randrange(9)), rng.choice(sources[:-1]), 0) for i in range(200)]
    return rows + [(7, None, "a", 1), (7, "", "empty", 2), (8, "x y\tz", "b", 3), (8, "x y\tz", "b", 3), (9, "v " * 900, "Z", 4)]


@pytest.mark.parametrize("block", [None, 5])
def test_mix_equals_plain_loops(spark, block):
    rows = rows_of(block or 0)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, at int")
    mix = mixing.plan(df, block=block)
    got = mixing.taken(mix).collect()
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(size)
    assert len(got) == len(rows)
    by_source = {}
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - float(want[r.source])) < 1e-6 and r.taken <= 3 * r.size
        by_source[r.source] = by_source.get(r.source, 0) + r.taken
    assert by_source == {s: int(t) for s, t in want.items()}
    parts = mixing.pieces(mix).collect()
    used = {}
    for p in parts:
        used[p.skey, p.block] = used.get((p.skey, p.block), 0) + p.words
    full = [n for n in used.values() if n == mix.block]
    assert max(used.values()) <= mix.block and len(full) >= len(used) - len(size)
    slots = [p for p in {(p.slot, p.skey, p.block) for p in parts} if p[0] is not None]
    assert len({s for s, _, _ in slots}) == len(slots)
    again = mixing.taken(mixing.plan(df, block=block)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_every_stretch_of_the_schedule_has_the_weights(spark):
    df = spark.createDataFrame([(i, "w " * 50, "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    mix = mixing.plan(df, block=10)
    order = [r.skey for r in mix.slots.orderBy("slot").collect()]
    for k in range(0, len(order) - 300, 100):
        part = order[k:k + 300]
        assert abs(part.count("=a") - 50) <= 4 and abs(part.count("=b") - 100) <= 4


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, "", "a")]])
def test_nothing_to_mix(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.taken(mixing.plan(df)).collect()] == [(0, 0.0, 0)] * len(rows)
