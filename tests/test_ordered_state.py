"""Ordered decisions and joins against plain loops: quotas, structure, chunk starts, citation ranges, near-duplicate issues."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from proofloom.functions import scalars as X
from proofloom.functions.ordered import range_blocks
from proofloom.operators import models as M
from proofloom.operators import structure as T
from proofloom.operators import usage as U
from proofloom.operators import xref as Q
from proofloom.streaming import jobs as J

DAY = datetime(2024, 1, 1)


def admitted(rows, quotas):
    used, out = {}, {}
    for i, u, a, t in sorted(rows, key=lambda r: (r[3], r[0])):
        k = (u, t.strftime("%Y-%m"))
        out[i] = used.get(k, 0) + a <= quotas[u]
        used[k] = used.get(k, 0) + (a if out[i] else 0)
    return out


def test_a_hot_user_of_one_minute_is_split_and_decided_exactly(spark):
    rng = random.Random(2)
    rows = [(i, 0 if i % 3 else 1, rng.choice([0, 1, 3, 7, 8, 9, 1000, 10**6, 2**40]), DAY + timedelta(microseconds=rng.randrange(50_000_000))) for i in range(20_000)]
    rows += [(30_000 + i, 2, 2**k, DAY + timedelta(seconds=i)) for i, k in enumerate(range(40, -1, -1))]  # each is just too large until the last
    quotas = {0: 10**8 + 1, 1: 0, 2: 1}
    logs = spark.createDataFrame(rows, "id long, user_id long, amount long, created_at timestamp")
    ranges = range_blocks(logs, ["user_id"], ["created_at", "id"], parts=16).where("user_id = 0").groupBy("__block").count().collect()
    assert len(ranges) >= 8 and max(r["count"] for r in ranges) < 5000
    got = U.admit(logs, spark.createDataFrame(list(quotas.items()), "id long, token_quota long"), 16)
    assert {r.id: r.accepted for r in got.collect()} == admitted(rows, quotas)


def test_quota_stream_over_batches_and_restarts(spark, tmp_path):
    schema, rng = "id long, user_id long, amount long, created_at timestamp", random.Random(4)
    source, work, quotas = str(tmp_path / "in"), str(tmp_path / "work"), {0: 90, 1: 40, 2: 1000}
    profiles = spark.createDataFrame(list(quotas.items()), "id long, token_quota long")
    rows = [(i, rng.randrange(3), rng.choice([1, 2, 5, 30, 80]), DAY + timedelta(hours=i)) for i in range(1000)]  # two months
    late = (5000, 2, 1, DAY)
    for part in (rows[:300], rows[300:301], rows[301:990], [*rows[990:], late]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        got = J.keep_admitted(spark.readStream.schema(schema).parquet(source), profiles, work)
    assert {r.id: r.accepted for r in got.collect()} == admitted(rows, quotas)  # the late row is left out
    again = J.keep_admitted(spark.readStream.schema(schema).parquet(source), profiles, work)
    assert again.count() == 1000


def roles(marks):
    """Outcome of each element by a plain loop over the state-free facts of one document."""
    p = c = t = r = False
    for x in sorted(marks, key=lambda x: x.idx):
        cover = c and x.goes_on
        toc = not cover and t and x.filled and not x.is_h and x.toc_entry
        role = "cover" if cover else "toc" if toc else x.cls[2 * r + p].role
        leaves = x.filled and ((x.is_h and not x.toc_heading) or not x.toc_entry)
        t = (role == "heading" and x.toc_heading and not (cover or toc)) or (t and (cover or toc or not leaves))
        r = x.ref_heading if role == "heading" else r
        p = role == "cover"
        c = p if x.filled else c
        yield x.idx, role


def test_structure_equals_a_plain_loop_with_gaps(spark, elements, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 7)
    rng = random.Random(6)
    lines = ["目录", "第一章 概述......3", "1.1 背景 4", "作者：张三", "", "正文一段，较长的内容在这里。", "参考文献", "[1] 文", "图1 示意", "摘要", "2 方法", "短"]
    docs = [(d, rng.choice(["paragraph", "paragraph", "heading", "caption", "reference"]), rng.choice(lines)) for d in range(12) for _ in range(40)]
    rows = elements(*docs).where(F.pmod(F.xxhash64("doc_id", "element_index"), F.lit(9)) > 0)
    v = T.views(rows)
    want = {}
    for x in T._marks(v.join(T.baseline(v), "doc_id")).collect():
        want.setdefault(x.doc_id, []).append(x)
    want = {(d, i): role for d, marks in want.items() for i, role in roles(marks)}
    assert {(r.doc_id, r.element_index): r.role for r in T.classify(rows).collect()} == want


def test_range_pieces_hold_each_number_once(spark):
    rng = random.Random(7)
    cases = [(a, a + rng.choice([0, 1, 2, 5, 17, 100])) for a in [rng.randrange(200) for _ in range(60)]] + [(0, 0), (1, 999_999_999), (0, 2**31 - 1)]
    df = spark.createDataFrame(cases, "low int, high int")
    for low, high, pieces in df.select("low", "high", X.range_pieces(F.col("low"), F.col("high"))).collect():
        spans = sorted((p.block << p.level, ((p.block + 1) << p.level) - 1) for p in pieces)
        assert len(pieces) <= 62 and spans[0][0] == low and spans[-1][1] == high and all(b + 1 == c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_a_citation_of_a_huge_range(spark, elements):
    rows = elements((1, "paragraph", "见[1-999999999]和[3，5-2]"), (1, "heading", "参考文献"), (1, "reference", "[2] 甲"), (1, "reference", "[3] 乙"), (1, "reference", "[70000] 丙"))
    got = {r.citation: (r.ref_indices, r.numbers) for r in Q.body_citations(rows).collect()}
    assert got == {"[1-999999999]": ([2, 3, 4], [1, 999_999_999]), "[3，5-2]": ([3], [3])}


def test_many_texts_that_share_characters(spark):
    """Twenty thousand texts of one document with a space and a common start: candidates stay few."""
    n = 20_000
    texts = [f"见 第{chr(0x4e00 + i % 150)}{chr(0x5e00 + i // 150)}处" for i in range(n)]
    rows = spark.createDataFrame([(1, t) for t in texts], "doc_id long, t string")
    sets = M._with_sets(rows).persist()
    assert M._close_sets(sets, sets, 0.8).count() == n
    assert M._contained(rows, rows).count() == n
    sets.unpersist()


def test_merge_against_a_plain_loop_with_equal_sets(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 6))) for _ in range(120)] + ["".join(rng.sample("abcdefgh", rng.randint(5, 8))) for _ in range(80)]
    base, new = texts[::7], [t for k, t in enumerate(texts) if k % 7]

    def close(a, b):
        return len(a) > 1 and len(b) > 1 and (a in b or b in a or len(set(a) & set(b)) / len(set(a) | set(b)) > 0.8)

    kept = list(base)
    for t in new:
        if len(t.strip()) < 2 or not any(close(t.strip(), k.strip()) for k in kept):
            kept.append(t)
    got = M.merge_model_issues(spark.createDataFrame([(1, -1, t) for t in base], "doc_id long, n int, location_text string"),
                               spark.createDataFrame([(1, i, t) for i, t in enumerate(new)], "doc_id long, n int, location_text string"), ["n"]).collect()
    assert sorted(r.location_text for r in got) == sorted(kept)
