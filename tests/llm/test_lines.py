"""Line dedup against plain counts of sites."""

import random

import pytest

from proofloom.llm import lines


def plain(rows, sites, keep_first):
    """rows: (doc_id, text, source); equal (id, text) rows are one document for first occurrences."""
    where, home = {}, {}
    for i, t, s in rows:
        for k, line in enumerate(t.split("\n") if t is not None else []):
            x = line.strip(" \t\r")
            if x:
                where.setdefault(x, set()).add(s)
                home[x] = min(home.get(x, ((True, 0), 0)), ((i is None, i or 0), k))
    for i, t, s in rows:
        if t is None:
            yield i, None, 0, 0
            continue
        out = [line for k, line in enumerate(t.split("\n"))
               if not (x := line.strip(" \t\r")) or len(where[x]) < sites or keep_first and home[x] == ((i is None, i or 0), k)]
        yield i, "\n".join(out), len(t.split("\n")), len(t.split("\n")) - len(out)


@pytest.mark.parametrize("sites, keep_first", [(3, True), (10, False)])
def test_equals_plain_counts(spark, sites, keep_first):
    rng = random.Random(sites)
    pool = [f"line {k} of many" for k in range(25)] + ["", "  ", "ä\tö"]
    rows = []
    for i in range(150):
        own = [f"own {i} {k}" for k in range(rng.randrange(3))]
        common = [pool[min(27, int(rng.expovariate(0.15)))] + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(6))]
        both = own + common
        rng.shuffle(both)
        rows.append((i + 10, "\n".join(both), f"s{rng.randrange(40)}"))
    rows += [(1, None, "s1"), (2, "", "s1"), (3, "\n\n", None), (4, "line 0 of many\nline 0 of many", None), rows[5], (None, "line 1 of many", "s77"), (5, "line 2 of many\n" * 3000 + "end", "s1")]
    df = spark.createDataFrame([(t, i, s, 9, 9) for i, t, s in rows], "text string, doc_id long, source string, n_lines int, line int")
    out = lines.dedup(df, sites=sites, keep_first=keep_first)
    assert set(out.columns) == set(df.columns) | {"n_removed"}
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows, sites, keep_first)))


def test_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"all\nown {i}", f"s{i}") for i in range(12)], "doc_id long, text string, source string")
    monkeypatch.setattr(lines, "BROADCAST_DOCS", 0)
    assert sorted(r.text for r in lines.dedup(df).collect()) == sorted(["all\nown 0", *(f"own {i}" for i in range(1, 12))])


def test_empty(spark):
    assert lines.dedup(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_columns_of_any_name(spark):
    names = ["id", "key", "gone", "parts", "_id", "__id", "__key", "__gone", "__parts", "n_lines"]
    rows = [(k, f"same line\nown {k}", f"s{k}", *range(len(names))) for k in range(12)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"`{n}` long" for n in names)]))
    got = lines.dedup(df)
    assert got.columns == [*df.columns, "n_removed"] and sorted(r.n_removed for r in got.collect()) == [0] + [1] * 11
    assert got.select(*names[:-1]).distinct().collect() == [tuple(range(len(names) - 1))]
