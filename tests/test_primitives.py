import random
import re

from pyspark.sql import functions as F

from proofloom.functions import ordered as O
from proofloom.functions import scalars as X
from proofloom.functions.spans import literal_spans, spans

TEXTS = ["", "a", "图1-2和图3，见表4。。", "aa" * 200, "x1y22z333 " * 60, "的的的了了，１２3", "no match here", "a\nb\n\nc"]


def test_spans_match_python_finditer(spark):
    for java, py in ((r"(?U)\d+", r"\d+"), (r"(.)\1", r"(.)\1"), (r"图\d+(?![\-\.])", r"图\d+(?![\-\.])"), ("a", "a")):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
        got = {r.i: [(s.hit, s.start, s.end) for s in r.s] for r in df.select("i", spans(F.col("t"), java).alias("s")).collect()}
        assert got == {i: [(m.group(0), m.start(), m.end()) for m in re.finditer(py, t)] for i, t in enumerate(TEXTS)}


def test_literal_spans_point_at_the_word(spark):
    df = spark.createDataFrame([("aXaXXa.", "X"), ("..", "."), ("none", "zz"), ("a" * 300, "aa")], "t string, w string")
    for r in df.select("t", "w", literal_spans(F.col("t"), F.col("w")).alias("s")).collect():
        want = [(m.start(), m.end()) for m in re.finditer(re.escape(r.w), r.t)]
        assert [(s.start, s.end) for s in r.s] == want


def test_blocked_order_matches_plain_order(spark):
    rng = random.Random(7)
    rows = [(k, i, rng.choice([None, 1, 2, 3])) for k in range(3) for i in range(rng.randint(1, 60))]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    for size in (4, 1000):
        block = [O.index_block("i", size)]
        out = O.running_sum(df, ["k"], ["i"], block, total=F.col("v"))
        out = O.last_seen(out, ["k"], ["i"], block, last=F.col("v"))
        out = O.previous(out, ["k"], ["i"], block, prev=F.col("v"))
        out = O.following(out, ["k"], ["i"], block, nxt=F.col("v"))
        got = {(r.k, r.i): (r.total, r.last, r.prev, r.nxt) for r in out.collect()}
        for k in range(3):
            vs = [v for kk, _, v in rows if kk == k]
            for i in range(len(vs)):
                last = next((v for v in reversed(vs[:i + 1]) if v is not None), None)
                want = (sum(v or 0 for v in vs[:i + 1]), last, vs[i - 1] if i else None, vs[i + 1] if i + 1 < len(vs) else None)
                assert got[(k, i)] == want


def test_results_do_not_depend_on_partitions(spark, elements):
    from proofloom.plans.qa import check

    rows = elements(*[(d, "paragraph", f"如图{i}-1，帐号{i}!! 1,000与1000") for d in range(3) for i in range(9)])
    seen = set()
    for n in ("1", "33"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(sorted(map(str, check(rows).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def test_citation_numbers(spark):
    cases = {"3": [3], "1,2,3": [1, 2, 3], "1，2": [1, 2], "1-3": [1, 2, 3], "2–4": [2, 3, 4], "1,3-5": [1, 3, 4, 5], "5-3": [], "1-3-5": [1, 2, 3]}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r.t: r.n for r in df.select("t", X.parse_citation_numbers(F.col("t")).alias("n")).collect()} == cases


def test_conversions(spark):
    row = spark.range(1).select(
        X.cn_size_to_pt(F.lit("小四")).alias("a"), X.cn_size_to_pt(F.lit("12磅")).alias("b"), X.cn_size_to_pt(F.lit("大")).alias("c"),
        X.pt_to_cn_size(F.lit(15.8)).alias("d"), X.pt_to_cn_size(F.lit(30.0)).alias("e"), X.parse_line_spacing(F.lit("1.5倍行距")).alias("f"),
        X.parse_margin_cm(F.lit("25.4mm")).alias("g"), X.paper_size(F.lit(29.7), F.lit(21.0)).alias("h"), X.cn_num_to_int(F.lit("十二")).alias("i"),
        X.int_to_cn_num(F.lit(21)).alias("j"), X.next_reset(F.lit("2024-12-31 10:00:00").cast("timestamp")).alias("k")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (12.0, 12.0, None, "三号", None)
    assert (row.f.type, row.f.value, round(row.g, 2), row.h, row.i, row.j) == ("one_point_five", 1.5, 2.54, "A4", 12, "21")
    assert str(row.k) == "2025-01-01 00:00:00"


def test_a_local_folder_only_in_one_process(spark, monkeypatch):
    import pytest

    from proofloom import session

    monkeypatch.setattr(session, "checkpoint_dir", lambda spark, default=None: None)
    first = session.shared_folder(spark)
    assert session.shared_folder(spark) == first and session.stored(spark.range(3), "x").count() == 3
    monkeypatch.setattr(session, "is_local", lambda spark: False)
    with pytest.raises(ValueError):
        session.stored(spark.range(3), "x")


def test_strip_trims_what_the_white_space_class_matches(spark):
    from pyspark.sql import functions as F

    from proofloom.functions.spans import strip

    chars = spark.createDataFrame([(i, chr(i)) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000], "id int, c string")
    rows = chars.select("id", F.concat("c", F.lit(" a"), "c", F.lit("b\t"), "c").alias("t"))
    old = F.regexp_replace("t", r"(?U)^\s+|\s+\z", "")
    assert rows.filter(strip(F.col("t")) != old).count() == 0 and rows.filter(F.length(old) == 3).count() > 20
