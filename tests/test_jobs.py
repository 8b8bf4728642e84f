import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from proofloom.operators import incremental as N
from proofloom.operators import models as M
from proofloom.operators import usage as U
from proofloom.operators.elements import write_issues
from proofloom.operators.fixes import accept_suggestions
from proofloom.plans.qa import check
from proofloom.sources import ingest as G


def test_pack_chunks_matches_a_plain_loop(spark, elements):
    rng = random.Random(3)
    docs = {d: ["字" * rng.randint(1, 40) for _ in range(rng.randint(1, 70))] for d in range(6)}
    docs[6] = ["长" * 500, "x"]
    rows = elements(*[(d, "paragraph", t) for d, ts in docs.items() for t in ts])
    for block in (3, 1024):
        got = {(r.doc_id, r.chunk_start): r.chunk for r in M.pack_chunks(rows, 60, block=block).collect()}
        want = {}
        for d, ts in docs.items():
            cur, start = "", 0
            for i, t in enumerate(ts):
                if cur and len(cur) + len(t) > 60:
                    want[(d, start)] = cur.strip()
                    cur, start = t, i
                else:
                    start = start if cur else i
                    cur += t + "\n"
            want[(d, start)] = cur.strip()
        assert got == want


def test_quota_admission_matches_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 3), rng.choice([1, 2, 5, 30, 80]), datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 1500))) for i in range(600)]
    logs = spark.createDataFrame(rows, "id long, user_id long, amount long, created_at timestamp")
    quotas = {0: 100, 1: 333, 2: 0, 3: 100000}
    profiles = spark.createDataFrame(list(quotas.items()), "id long, token_quota long")
    used, want = {}, {}
    for i, u, a, t in sorted(rows, key=lambda r: (r[3], r[0])):
        k = (u, t.strftime("%Y-%m"))
        want[i] = used.get(k, 0) + a <= quotas[u]
        used[k] = used.get(k, 0) + (a if want[i] else 0)
    for rounds in (0, 2):
        assert {r.id: r.accepted for r in U.admit(logs, profiles, rounds).collect()} == want


def test_merge_model_issues_is_greedy_in_order(spark):
    rng = random.Random(11)
    letters = "abcdef"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(30)]
    base = spark.createDataFrame([(1, -1, t) for t in texts[:4]], "doc_id long, n int, location_text string")
    new = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts[4:])], "doc_id long, n int, location_text string")

    def close(a, b):
        return a in b or b in a or len(set(a) & set(b)) / len(set(a) | set(b)) > 0.8

    kept = list(texts[:4])
    for t in texts[4:]:
        if not any(close(t, k) for k in kept):
            kept.append(t)
    got = M.merge_model_issues(base, new, ["n"]).collect()
    assert sorted(r.location_text for r in got) == sorted(kept)


def test_split_long_text_loses_nothing_but_edges(spark):
    text = "。".join("句子内容" * 9 for _ in range(80)) + "\n\n" + "尾" * 900
    pieces = [r.chunk for r in M.split_long_text(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk_id").collect()]
    assert "".join(pieces).replace("\n", "") == text.replace("\n", "")
    assert all(len(p) <= 802 for p in pieces)


def test_model_answers(spark):
    body = '{"issues": [{"text": "t{x}", "confidence": 0.9, "category": "logic", "severity": "error"}]}'
    rows = spark.createDataFrame([(1, 0, 5, "comprehensive", f"```json\n{body}\n```"), (2, 0, 6, "typo", f"ok: {body} end"), (3, 0, 7, "typo", "nothing {")],
                                 "doc_id long, chunk_id int, start_index int, task string, response string")
    got = {r.doc_id: (r.category, r.severity, r.element_index, r.location_text) for r in M.score_responses(rows).collect()}
    assert got == {1: ("logic", "error", 5, "t{x}"), 2: ("typo", "warning", 6, "t{x}")}


MARKDOWN = """# 标题 *一*
正文 **粗** 行
- 续行不成列表

- 甲
- 乙
2. 丙

```sql
select | 1

```
| a | b |
|---|---|
| 1 | `2` |
> 引用
***
![图](p.png)
尾段"""


def test_markdown_blocks(spark):
    rows = G.segment_markdown(spark.createDataFrame([(1, MARKDOWN)], "doc_id long, text string")).orderBy("block", "part").collect()
    assert [(r.element_type, r.content) for r in rows] == [
        ("heading", "标题 一"), ("paragraph", "正文 粗 行\n- 续行不成列表"), ("list_item", "甲"), ("list_item", "乙"), ("list_item", "丙"),
        ("code_block", "select | 1\n"), ("paragraph", "引用"), ("image", "图"), ("paragraph", "尾段")]
    cells = G.markdown_cells(spark.createDataFrame([(1, MARKDOWN)], "doc_id long, text string")).orderBy("line_no", "col").collect()
    assert [(c.content, c.is_header) for c in cells] == [("a", True), ("b", True), ("1", False), ("2", False)]


def test_css_extends_existing_style(spark):
    html = '<P class="x">a</P><h1 style="color: red">b</h1><div>c</div>'
    out = spark.range(1).select(G.inject_css(F.lit(html)).alias("h")).first().h
    assert '<p class="x" style="font-family: 宋体; font-size: 10.5pt; line-height: 1.5">' in out
    assert '<h1 style="color: red; font-family: 宋体; font-size: 16pt; line-height: 1.5">' in out and "\u0001" not in out


def test_accepted_suggestions_replace_first_occurrence(spark, elements):
    rows = elements((1, "paragraph", "帐号和帐号，做为"))
    fixes = spark.createDataFrame([(1, 0, "帐号", "账号"), (1, 0, "做为", "作为"), (1, 0, "没有", "x")], "doc_id long, element_index int, original string, suggestion string")
    assert accept_suggestions(rows, fixes).first().corrected == "账号和帐号，作为"


def test_recheck_only_changed_chunks(spark, elements):
    old = elements(*[(1, "paragraph", f"第{i}段") for i in range(10)])
    new = elements(*[(1, "paragraph", f"第{i}段" + ("!!" if i == 7 else "")) for i in range(10)])
    diff = N.chunk_diff(N.chunk_hashes(new, 4), N.chunk_hashes(old, 4))
    assert sorted(r.element_index for r in N.changed_elements(new, diff, 4).collect()) == [4, 5, 6, 7]


def test_issue_table_round_trip(spark, elements, tmp_path):
    issues = check(elements((1, "paragraph", "好。。２０"), (1, "paragraph", "见[1]"), (1, "heading", "参考文献"), (1, "paragraph", "[1] 文")))
    write_issues(issues, str(tmp_path / "issues"))
    back = spark.read.parquet(str(tmp_path / "issues"))
    assert back.count() == issues.count()
    assert back.filter("category = 'reference' AND fixable").select("fix_payload.ref_numbers").first()[0] == [1]


def test_files_of_any_encoding(spark, tmp_path):
    text = "海洋环境监测报告：温度与盐度变化"
    for name, data in (("a.txt", text.encode("utf-8")), ("b.txt", text.encode("gbk")), ("c.md", b"\xef\xbb\xbf" + text.encode("utf-8")), ("d.exe", b"x")):
        (tmp_path / name).write_bytes(data)
    rows = G.read_text_files(spark, str(tmp_path)).collect()
    assert sorted(r.format for r in rows) == ["md", "txt", "txt"] and {r.text for r in rows} == {text}
