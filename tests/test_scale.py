"""Plans and inputs that only matter at size."""

from pyspark.sql import functions as F

from proofloom import catalog
from proofloom.functions.ordered import following, index_block, last_seen
from proofloom.operators import formatting, structure
from proofloom.plans import qa
from proofloom.sources import lexicon

SF = "/root/testdata/sf0.001"


def test_a_check_of_many_rules_merges_stored_reports(spark, elements):
    docs = elements((1, "paragraph", "见图1，浓度为5 ug/L。。"), (1, "caption", "图1 温度"), (2, "paragraph", "如果条件满足"))
    issues = qa.check(docs, ("consistency", "crossref", "format", "logic_rules"))
    plan = issues._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # no checker's own work is left in it
    assert {"format.repeat_punctuation", "format.unit.ug_per_l"} <= {r.rule_id for r in issues.collect()}


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    for name in ("documents",):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("L5_stream_doc_qa", "L6_stream_incremental_recheck"):
        one, many = (sorted(map(tuple, catalog.queries()[name](spark, d).collect())) for d in (SF, str(tmp_path)))
        assert one and one == many, name


def planned(df):
    """The physical plan before adaptive changes."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_small_rows_of_blocks_are_not_broadcast(spark):
    rows = spark.createDataFrame([(k // 3, k % 3, f"v{k}") for k in range(30)], "id long, n int, v string")
    for df in (last_seen(rows, ["id"], ["n"], [index_block("n")], x=F.col("v")), following(rows, ["id"], ["n"], [index_block("n")], x=F.col("v"))):
        assert "SortMergeJoin" in planned(df) and "Broadcast" not in planned(df)
    answers = rows.select(F.col("id").alias("template_id"), F.col("v").alias("key"), F.col("v").alias("value"))
    assert "Broadcast" not in planned(formatting.answer_mismatches(answers, answers.filter("value <> 'v1'")))
    assert [r.key for r in formatting.answer_mismatches(answers, answers.filter("value <> 'v1'")).collect()] == ["v1"]


def test_tasks_of_numbered_rows_follow_the_rows(spark, tmp_path):
    from proofloom.catalog import views
    from proofloom.functions import ordered

    rows = spark.range(1000).select((F.col("id") % 3).alias("doc"), F.col("id").alias("n"))
    df = ordered.numbered(rows, ["doc"], ["n"], [F.floor(F.col("n") / 100)], "at", parts=37)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 37), REPARTITION_BY_NUM") == 2  # the rows and what the blocks carry
    assert plan.count("Sort [") == 3  # the rows once, what is carried for its window and for the join
    assert all(r.at == r.n // 3 for r in df.collect())
    rows.write.parquet(str(tmp_path / "rows"))
    read = spark.read.parquet(str(tmp_path / "rows"))
    assert ordered.parts_for(read, 10) == 100 and ordered.parts_for(read) == 0
    dealt = views.parts_for
    try:
        views.parts_for = lambda lines: dealt(lines, 100)
        zh = views.zh_elements(spark, SF)
        assert "REPARTITION_BY_NUM" in zh._jdf.queryExecution().executedPlan().toString()
        many = sorted((r.doc_id, r.element_index, r.content) for r in zh.select("doc_id", "element_index", "content").collect())
    finally:
        views.parts_for = dealt
    assert many == sorted((r.doc_id, r.element_index, r.content) for r in views.zh_elements(spark, SF).select("doc_id", "element_index", "content").collect())


def test_requirement_texts_of_one_file_are_dealt_to_all_cores(spark):
    docs = spark.createDataFrame([(k, "正文：宋体，小四") for k in range(40)], "rule_text_id long, text string").coalesce(1)
    rules = formatting.rules_from_text(docs)
    plan = rules._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(rule_text_id") == plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert rules.filter("slot = 'body' AND attr = 'font_size_pt' AND value = '12.0'").count() == 40


def test_structure_blocks_hold_no_text(spark, elements):
    roles = structure.classify(elements((1, "heading", "第一章 绪论"), (1, "paragraph", "关键词：海洋"), (2, "heading", "参考文献"), (2, "paragraph", "[1] 张三")))
    folders = {f.rsplit("/", 1)[0] for f in roles.inputFiles()}
    fields = " ".join(spark.read.parquet(f).schema.simpleString() for f in folders if "/blocks-" in f)
    assert "cls" in fields and not any(f"{name}:" in fields for name in ("text", "hint", "reason", "confidence"))
    assert [(r.role, r.section_kind) for r in roles.orderBy("doc_id", "element_index").collect()] == [
        ("heading", "heading_1"), ("body", "keywords"), ("heading", "references_heading"), ("reference", "reference_item")]


def test_pieces_of_text_are_not_moved_to_a_small_lexicon(spark, elements, monkeypatch):
    docs, words = elements((1, "paragraph", "请登录帐号，做为基础")), lexicon.builtin_lexicon(spark)
    hits = lexicon.typo_hits(docs, words)
    assert "strategy=broadcast" in hits._jdf.queryExecution().analyzed().toString() and {"帐号", "做为"} <= {r.wrong for r in hits.collect()}
    monkeypatch.setattr(lexicon, "SENT_WORDS", 1)
    moved = lexicon.typo_hits(docs, words)
    assert "broadcast" not in moved._jdf.queryExecution().analyzed().toString() and sorted(moved.collect()) == sorted(hits.collect())


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_elements_without_forms_leave_before_the_functions_of_arrays(spark, elements):
    """The first filter on an element's text is a plain one, and it loses no hit."""
    from proofloom.operators import consistency as C

    df = elements((1, "paragraph", "长5 km，宽3 千米"), (1, "paragraph", "没有"), (1, "paragraph", "APP 和 app"), (1, "paragraph", ""))
    for rules in (C.unit_rules(), C.term_rules()):
        plan = _plan(C.alias_hits(df, rules))
        assert any(line.lstrip(" +-:").startswith("Filter") and "Contains(" in line for line in plan.split("\n"))
        hits = {(r.element_index, r.form) for r in C.alias_hits(df, rules).collect()}
        for standard, form, regex, exact in rules:
            text = C.F.col("content") if exact else C.F.lower("content")
            plain = df.filter(C.F.contains(text, C.F.lit(form if exact else form.lower())) & (C.F.col("content").rlike(regex) if regex else C.F.lit(True)))
            if form in ("km", "千米", "APP", "没有", "m"):
                assert {(r.element_index, form) for r in plain.collect()} == {h for h in hits if h[1] == form}
        assert all(i in (0, 2) or f in df.collect()[1].content for i, f in hits)


def test_elements_without_a_mark_leave_before_references_are_read(spark, elements):
    from proofloom.operators import xref as X
    from proofloom.rules import fixed as R

    assert len(R.POINT_MARKS) == len(R.POINT_PATTERNS) and all(m in regex for m, (_, regex) in zip(R.POINT_MARKS, R.POINT_PATTERNS))
    lines = ["见图 1-2", "附图 3", "表2", "（1-2）与(3.4 )", "式 1.2", "公式3-4", "第二章", "3.1 节", "[1, 2]", "没有"]
    found = X.points(elements(*[(1, "paragraph", t) for t in lines])).collect()
    assert {r.element_index for r in found} == set(range(len(lines))) - {1, 9}
    assert sorted(r.number for r in found if r.element_index == 3) == ["1-2", "3-4"]


def test_alias_hits_are_made_once(spark, elements):
    from proofloom.operators import consistency as C

    issues = C.unit_alias(elements((1, "paragraph", "长5 km，宽3 千米")))
    assert "Generate" not in _plan(issues.select("doc_id", "location_text")) and issues.count() == 1


def _kept_by_a_loop(base, new):
    def close(a, b):
        return len(a) > 1 and len(b) > 1 and (a in b or b in a or len(set(a) & set(b)) / len(set(a) | set(b)) > 0.8)

    kept, apart = list(base), [t for t in new if not any(close(t.strip(), k.strip()) for k in base)]
    for t in new:
        if not any(close(t.strip(), k.strip()) for k in kept):
            kept.append(t)
    return sorted(kept), sorted(apart)


def test_texts_of_ordinary_documents_meet_without_their_pieces(spark, monkeypatch):
    """Documents of all sizes give what a plain loop gives; no piece of a text of an ordinary one is moved."""
    import random

    from proofloom.operators import models as M

    rng, base, new = random.Random(5), {}, {}
    for doc, n in ((1, 30), (2, 90), (3, 4)):
        texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 7))) for _ in range(n)] + ["".join(rng.sample("abcdefghij", 9)) for _ in range(n // 3)]
        base[doc], new[doc] = texts[::5], [t for k, t in enumerate(texts) if k % 5]
    table = lambda side: spark.createDataFrame([(d, i, t) for d, texts in side.items() for i, t in enumerate(texts)], "doc_id long, n int, location_text string")
    old, fresh = table(base), table(new)
    want = {d: _kept_by_a_loop(base[d], new[d]) for d in base}
    for rows in (512, 50, 0):  # all documents ordinary, one large, all large
        monkeypatch.setattr(M, "PAIR_ROWS", rows)
        apart = M.drop_near_duplicates(fresh, old)
        assert rows < 512 or "Generate" not in _plan(apart)
        for got, k in ((M.merge_model_issues(old, fresh, ["n"]).collect(), 0), (apart.collect(), 1)):
            assert {d: sorted(r.location_text for r in got if r.doc_id == d) for d in base} == {d: w[k] for d, w in want.items()}, (rows, k)


def test_flat_texts_move_each_text_once(spark, monkeypatch):
    """The wording is made once, and no text is sent to each element above it; large documents give the same."""
    from proofloom.operators import elements as E

    up = {1: [None, 0, 0, 2, 3, None, 5], 2: [None] + list(range(20)), 3: [1, 0, None]}
    rows = spark.createDataFrame([(d, k, p, "" if (d, k) == (1, 2) else f"{d}-{k}") for d, ups in up.items() for k, p in enumerate(ups)],
                                 "doc_id long, element_index int, parent_index int, content string")
    want = {}
    for d, ups in up.items():
        for k in range(len(ups)):
            at, seen = k, set()
            while at is not None and at not in seen:
                seen.add(at)
                want.setdefault((d, at), []).append(k)
                at = ups[at]
    want = {(d, at): "\n".join(f"{d}-{k}" for k in sorted(ks) if (d, k) != (1, 2)) for (d, at), ks in want.items()}
    flat = E.flat_text(rows)
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan and "root_index#" in plan
    assert not any("Exchange hashpartitioning(doc_id" in line and "root_index" in line for line in plan.split("\n"))
    for size in (4096, 10, 0):
        monkeypatch.setattr(E, "FLAT_ROWS", size)
        assert {(r.doc_id, r.root_index): r.text for r in E.flat_text(rows).collect()} == want


def test_lines_are_numbered_in_their_order_whatever_the_part_keys(spark, tmp_path, monkeypatch):
    from proofloom.catalog import views
    from proofloom.functions import ordered

    lines = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_partkey", F.col("l_partkey") + 65436)
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = lines.selectExpr("l_orderkey ok", "l_partkey pk", "l_suppkey sk", "l_linenumber ln").collect()
    docs = {}
    for r in sorted(map(tuple, rows)):
        docs.setdefault(r[0] // 16, []).append(r[1:])
    want = sorted((doc, i, *r) for doc, rows in docs.items() for i, r in enumerate(rows))
    assert {r[2] // 65536 for r in want} == {0, 1}  # part keys on both sides of a block's edge, in one document
    numbered = lambda: sorted(map(tuple, views.zh_flat(spark, str(tmp_path)).select("doc_id", "element_index", "pk", "sk", "ln").collect()))
    assert numbered() == want
    monkeypatch.setattr(views, "hot_key", lambda *a: True)
    assert numbered() == want
    keys = spark.range(20000).select(F.when(F.col("id") < 5000, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    assert ordered.hot_key(keys, F.col("k"), 4000) and not ordered.hot_key(keys.filter("k >= 0"), F.col("k"), 4000)
    assert not ordered.hot_key(keys.limit(0), F.col("k"))
