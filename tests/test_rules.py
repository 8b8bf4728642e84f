import pytest
from pyspark.sql import functions as F

from proofloom.operators import consistency as C
from proofloom.operators import detectors as D
from proofloom.operators import xref as Q
from proofloom.operators.structure import classify
from proofloom.plans.qa import check
from proofloom.sources.lexicon import builtin_lexicon, typo_issues

P, H = "paragraph", "heading"


def rule_ids(df):
    return sorted(r.rule_id for r in df.collect())


@pytest.mark.parametrize("rule, text, hits", [
    (D.mixed_punctuation, "结果如下,共3.5吨", ["下,"]),
    (D.repeat_punctuation, "好。。真的!!??", ["!!", "??", "。。"]),
    (D.fullwidth_digit, "共２０２５年", ["２０２５"]),
    (D.bracket_pair, "未闭合（括号", ["未闭合（括号"]),
    (D.repeat_char_3plus, "的的的问题", ["的的的"]),
    (D.repeat_char_2, "南海海表与生物物理", []),
    (D.repeat_char_2, "这是的的问题", ["的的"]),
    (D.unit_ug_per_l, "浓度 5 ug/L时", ["ug/L"]),
    (D.unit_celsius_spacing, "温度28 °C", ["8 °C"]),
    (D.de_di_de, "认真的分析与伟大的事业", ["认真的分析"]),
    (D.cjk_ascii_spacing, "用Python写Java", ["用P", "n写"]),
])
def test_element_rules(elements, rule, text, hits):
    found = D.detect(elements((1, P, text)), rule).collect()
    assert sorted(r.location_text for r in found) == sorted(hits)
    for r in found:
        if r.start_pos >= 0:
            assert text[r.start_pos:r.end_pos].replace(" ", "") == r.location_text.replace(" ", "")


def test_clean_adjectives_raise_no_sure_typo(spark, elements):
    rows = elements(*[(1, P, t) for t in ("快速的", "伟大的", "重要的", "大量的", "正确的")])
    issues = check(rows, ("typo",), builtin_lexicon(spark))
    assert issues.filter("confidence >= 0.8").count() == 0


def test_lexicon_words_overlap(spark, elements):
    rows = typo_issues(elements((1, P, "登录帐号和帐号")), builtin_lexicon(spark)).collect()
    assert sorted((r.location_text, r.start_pos) for r in rows) == [("帐号", 2), ("帐号", 5), ("登录帐号", 0)]


def test_consistency(elements):
    rows = elements(
        (1, P, "项目总投资为 1,000 万元"), (1, P, "第二期投资为1000万元"), (2, P, "投资金额为 1,000 万元"), (2, P, "回报率为 1,000 万元"),
        (3, P, "报告日期为 2024年3月15日"), (3, P, "截止日期为 2024-03-15"))
    assert {r.doc_id for r in C.number_format(rows).collect()} == {1}
    assert {r.doc_id for r in C.date_format(rows).collect()} == {3}


def test_similar_names(elements):
    rows = elements((1, P, "单位：清华大学"), (1, P, "再次：清华大学"), (1, P, "又见：清化大学"), (1, P, "无关：北京市政府"))
    found = C.proper_noun(rows).collect()
    assert [(r.location_text, r.related_text, r.element_index) for r in found] == [("清化大学", "清华大学", 2)]


def test_order_rules(elements):
    rows = elements((1, H, "第一章"), (1, H, "第二章"), (1, P, "2020年开始，2015年结束"), (1, P, "因为下雨"), (1, P, "停工"), (1, P, "如果可以"), (1, P, "那么继续"))
    assert [r.element_index for r in C.empty_section(rows).collect()] == [0]
    assert [r.element_index for r in C.timeline(rows).collect()] == [2]
    assert [r.element_index for r in C.causality(rows).collect()] == [3]
    assert C.conditionals(rows).count() == 0


CITATIONS = [
    ([(P, "本文参照 [1] 中的方法进行分析。"), (H, "参考文献"), (P, "[1] 张三. 研究报告. 2020."), (P, "[2] 李四. 分析报告. 2021.")], [True]),
    ([(P, "见 [99]。"), (H, "参考文献"), (P, "[1] 张三. 研究报告. 2020.")], [False]),
    ([(P, "本文对鱼类资源 [1] 进行了分析。")], []),
    ([(P, "正文见 [1]。"), (H, "参考文献"), (P, "[1] 张三. 研究，引用 [2]。")], [True]),
    ([("header", "[1] 页眉中的引用"), (P, "正文"), (H, "参考文献"), (P, "[1] 张三")], []),
    ([(P, "见 [2] 和 [4]。"), (H, "参考文献"), (P, "[2] 张三. 报告甲."), (P, "[4] 李四. 报告乙.")], [True, True]),
]


def test_citations(elements):
    rows = elements(*[(i, *r) for i, (doc, _) in enumerate(CITATIONS) for r in doc])
    got = {}
    for r in Q.citation_issues(rows).orderBy("doc_id", "start_pos").collect():
        got.setdefault(r.doc_id, []).append(r.fixable)
    assert got == {i: want for i, (_, want) in enumerate(CITATIONS) if want}
    assert [r.doc_id for r in Q.citation_warnings(rows).collect()] == [2]


def test_reference_order_is_reading_order(elements):
    rows = elements((1, H, "1 引言"), (1, P, "见文献[2,3,6,7]所示方法，另见[3]。"), (1, H, "参考文献"), *[(1, "reference", f"[{n}] 第{n}篇") for n in (2, 3, 6, 7)])
    points = Q.points(rows).orderBy("scan_index").collect()
    assert [p.ref_text for p in points] == ["[2]", "[3]", "[6]", "[7]", "[3]"]
    assert [p.scan_index for p in points] == list(range(5))
    matches = Q.matches(Q.targets(rows), Q.points(rows))
    assert {r.status for r in matches.filter("scan_index >= 0").collect()} == {"valid"}


def test_points_are_valid_or_dangling(elements):
    rows = elements((1, P, "如图1-2与图9，见表3"), (1, "caption", "图1-2 名称"), (1, "caption", "图1-2 重复"), (1, "caption", "表7 无人引用"))
    m = Q.matches(Q.targets(rows), Q.points(rows))
    by = {r.status: r.n for r in m.groupBy("status").agg(F.count("*").alias("n")).collect()}
    # Captions refer to themselves, so only the second figure is a duplicate.
    assert by["duplicate"] == 1 and "unreferenced" not in by
    assert m.filter("scan_index >= 0").filter("status NOT IN ('valid', 'dangling')").count() == 0


def test_structure_roles(elements):
    rows = elements(
        (1, P, "目录"), (1, P, "第一章 绪论......1"), (1, P, "结论 12"), (1, H, "第一章 绪论"), (1, P, "正文内容很长，超过二十个字的一段普通正文内容。"),
        (1, H, "参考文献"), (1, P, "张三. 某文."), (1, H, "附录"), (1, P, "这里又是正文内容，不是文献。"))
    roles = [r.role for r in classify(rows).orderBy("element_index").collect()]
    assert roles == ["heading", "toc", "toc", "heading", "body", "heading", "reference", "heading", "body"]


def test_long_document_keeps_state_past_the_opening(elements):
    head = [(1, P, f"第{i}段普通正文内容，长度足够。") for i in range(30)]
    rows = elements(*head, (1, H, "参考文献"), *[(1, P, f"文献条目甲{i}") for i in range(5)], (1, H, "附录"), (1, P, "附录正文内容。"))
    roles = [r.role for r in classify(rows).orderBy("element_index").collect()]
    assert roles[30:] == ["heading"] + ["reference"] * 5 + ["heading", "body"]


def test_chains_of_any_length_and_cycles(spark):
    from proofloom.operators.elements import ancestors

    rows = [("a", k, k - 1 if k else None) for k in range(45)] + [("b", k, (k + 1) % 5) for k in range(5)] + [("b", 9, 0), ("c", 1, 77)]
    got = ancestors(spark.createDataFrame(rows, "doc string, n int, up int"), ["doc"], "n", "up").collect()
    up = {(d, n): u for d, n, u in rows}
    want = set()
    for d, n, _ in rows:
        at, depth, seen = n, 0, set()
        while (d, at) in up and at not in seen:
            seen.add(at)
            want.add((d, n, at, depth))
            at, depth = up[d, at], depth + 1
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_first_object_of_a_model_answer(spark):
    from pyspark.sql import functions as F

    from proofloom.operators.models import _first_object

    cases = {'x {"a": {"b": 1}} {"c": 2}': '{"a": {"b": 1}}', "{no} then {\"y\": 1}": '{"y": 1}', "} {\"y\": 1}": None, "none": None, "": None, None: None, '{"é": "𝄞"}!': '{"é": "𝄞"}'}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", _first_object(F.col("t")).alias("o")).collect()
    assert {r.t: r.o for r in got} == cases


def test_elements_without_a_sign_of_a_rule_leave_before_the_rules(spark, elements, monkeypatch):
    import random

    from proofloom.operators import detectors as D
    from proofloom.sources import lexicon as L

    rng = random.Random(4)
    bits = ["中", "文", "了了", "了了了", "的", "认真的学习", "快速的分析", ",", "，，", "!!", "?", " ", "　", "\n", "３", "5", "5 ℃", "7  °c", "UG/l", "xug/L", "（", "）", "[", "】", "帐号", "做为", "a",
            "海洋观测技术的持续进步和数据积累不断增加速度"]
    kinds = ["paragraph", "heading", "reference"]
    docs = elements(*[(k, rng.choice(kinds), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for k in range(600)]).localCheckpoint()
    rules = list(D.TEXT_RULES.values())
    found = sorted(D.detect(docs, *rules).collect(), key=repr)
    plan = D.detect(docs, *rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan[plan.index("Filter"):] and len({r.rule_id for r in found}) == len(rules)
    words = L.builtin_lexicon(spark)
    hits = sorted(L.typo_hits(docs, words).collect(), key=repr)
    assert hits and "RLIKE" in L.typo_hits(docs, words)._jdf.queryExecution().optimizedPlan().toString()
    for rule in rules:
        one = sorted(D.detect(docs, rule).collect(), key=repr)
        assert one == [r for r in found if r.rule_id == one[0].rule_id]
        monkeypatch.delattr(rule, "sign")
    monkeypatch.setattr(L, "LOOKED_FOR", -1)
    assert found == sorted(D.detect(docs, *rules).collect(), key=repr)
    assert hits == sorted(L.typo_hits(docs, words).collect(), key=repr)
    assert L._any_of([]) == "(?!)" and L._any_of(["a", ""]) == ""
    odd = ["a-b", "^x", "[y]", "a\\c", "*", "z&&z", "q q", "-", "]]"]
    texts = spark.createDataFrame([(w, f"1{w}2") for w in odd] + [("none", "ac ^ [ y")], "w string, t string")
    assert sorted(r.w for r in texts.filter(F.col("t").rlike(L._any_of(odd))).collect()) == sorted(odd)
