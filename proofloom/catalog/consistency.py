"""Queries for document-level consistency (D4-D7, C10-C12) and logic rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofloom.catalog import sqlgen as S
from proofloom.catalog.registry import query
from proofloom.catalog.views import LATIN_SQL, ZH_SQL, latin_elements, zh_elements
from proofloom.operators import consistency as C
from proofloom.operators import detectors as D
from proofloom.rules import fixed as R

COLS = ["doc_id", "element_index", "location_text", "title", "description", "suggestion", "severity"]


def _run(fn, *cols, source=zh_elements):
    return lambda spark, d: fn(source(spark, d)).select(*(cols or COLS))


def _spelling_sql(occ, title, desc, severity, with_sql=ZH_SQL):
    return f"""WITH {with_sql}, occ AS ({occ}),
      r AS (SELECT doc_id, value, raw, count(*) AS n, min(element_index * 1000000 + s) AS f FROM occ GROUP BY ALL),
      v AS (SELECT doc_id, value, count(*) AS k, string_agg(raw, ', ' ORDER BY encode(raw)) AS forms,
              arg_max(raw, n * 100000000000 - f) AS best FROM r GROUP BY ALL HAVING count(*) > 1)
      SELECT doc_id, element_index, raw AS location_text, {title} AS title, {desc} AS description,
        '统一使用格式：' || best AS suggestion, '{severity}' AS severity
      FROM occ JOIN v USING (doc_id, value) WHERE raw <> best"""


_NUM = r"(?:[0-9０-９][0-9０-９,，]*[0-9０-９]|[0-9０-９])(?:\.[0-9０-９]+)?"
_NUM_RAW = r"regexp_extract(hit, '([0-9０-９][0-9０-９,，]*[0-9０-９]|[0-9０-９])(?:\.[0-9０-９]+)?', 1)"
_NUM_OCC = f"""SELECT doc_id, element_index, s, {_NUM_RAW} AS raw, replace(replace({_NUM_RAW}, ',', ''), '，', '') AS value
      FROM ({{hits}})"""
query("I13_number_format", _spelling_sql(
    _NUM_OCC.format(hits=S.hits("zh", _NUM)), "'数字格式不一致：' || raw",
    "'数值 ' || value || ' 在文档中存在多种格式表示：' || forms", "info"))(_run(C.number_format))
query("D4_number_groups_latin", f"""WITH {LATIN_SQL}, occ AS ({_NUM_OCC.format(hits=S.hits("la", _NUM))})
    SELECT doc_id, value, raw, count(*) AS n FROM occ GROUP BY ALL""")(
    lambda spark, d: C.number_occurrences(latin_elements(spark, d)).groupBy("doc_id", "value", "raw").agg(
        F.count("*").alias("n")))

_DATES = [r"[0-9]{4}\s*年\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日", r"[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}",
          r"[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}"]
_DATE_OCC = " UNION ALL ".join(f"""
    SELECT doc_id, element_index, s, hit AS raw, n[1] || '-' || lpad(n[2], 2, '0') || '-' || lpad(n[3], 2, '0') AS value
    FROM (SELECT *, regexp_extract_all(hit, '[0-9]+') AS n FROM ({S.hits("zh", r)}))""" for r in _DATES)
query("I14_date_format", _spelling_sql(
    _DATE_OCC, "'日期格式不一致：' || raw", "'日期 ' || value || ' 存在多种格式：' || forms", "warning"))(_run(C.date_format))

# DuckDB counts edits in bytes, so the characters used are mapped to letters first.
_N = "'清华化大学北京研究院所海洋', 'abcdefghijklm'"
query("I15_proper_noun", f"""WITH {ZH_SQL}, n AS (
      SELECT doc_id, hit AS name, count(*) AS n, min(element_index * 1000000 + s) AS f
      FROM ({S.hits("zh", R.ORG_NAME_PATTERN)}) GROUP BY ALL),
    p AS (SELECT a.doc_id, CASE WHEN a.n <= b.n THEN a.name ELSE b.name END AS suspect,
            CASE WHEN a.n <= b.n THEN b.name ELSE a.name END AS other, CASE WHEN a.n <= b.n THEN a.f ELSE b.f END AS f
          FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.f < b.f AND levenshtein(translate(a.name, {_N}), translate(b.name, {_N})) <= 2)
    SELECT doc_id, CAST(floor(f / 1000000) AS INT) AS element_index, suspect AS location_text,
      '专有名词疑似不一致："' || suspect || '"' AS title, '文档中同时出现"' || other || '"和"' || suspect || '"，可能是笔误' AS description,
      '请确认是否应统一为"' || other || '"或"' || suspect || '"' AS suggestion, 'warning' AS severity FROM p""")(_run(C.proper_noun))


def _alias_hits(rows):
    """One branch per form: a plain substring test, then a constant pattern."""
    return " UNION ALL ".join(
        f"SELECT doc_id, element_index, {S.lit(st)} AS standard, {S.lit(f)} AS form FROM zh WHERE "
        + (f"contains(lower(content), {S.lit(f.lower())}) AND regexp_matches(content, {S.lit(p)})" if p
           else f"contains(content, {S.lit(f)})")
        + (f" AND contains(content, {S.lit(f)})" if exact else "")
        for st, f, p, exact in rows)


_W = r"\p{L}\p{N}_"
_TERM_ROWS = [(s, f, "" if (not rx) else rf"(?i)(?:^|[^A-Za-z0-9])\Q{f}\E(?:$|[^A-Za-z0-9])", not rx)
              for s, f, rx, _ in C.term_rules()]
_UNIT_ROWS = []
for _s, _f, _rx, _ in C.unit_rules():
    _esc = "".join("\\" + c if not c.isalnum() else c for c in _f) if _f.isascii() else _f
    if len(_f) == 1 and _f in R.ONE_LETTER_UNITS:
        _UNIT_ROWS.append((_s, _f, rf"\p{{Nd}}\s*{_esc}(?:$|[^{_W}])", True))
    else:
        # A word edge is a change between word and other characters.
        _word = lambda c: c.isalnum() or c == "_"
        _l = rf"(?:^|[^{_W}])" if _word(_f[0]) else f"[{_W}]"
        _r = rf"(?:$|[^{_W}])" if _word(_f[-1]) else f"[{_W}]"
        _UNIT_ROWS.append((_s, _f, f"{_l}{_esc}{_r}", True))


def _alias_sql(rows, title, desc, sug):
    return f"""WITH {ZH_SQL}, h AS ({_alias_hits(rows)}),
      g AS (SELECT doc_id, standard, string_agg(DISTINCT form, ', ' ORDER BY form) AS forms FROM h GROUP BY ALL
            HAVING count(DISTINCT form) > 1)
      SELECT doc_id, element_index, form AS location_text, {title} || form AS title,
        {desc} || standard || '''在文档中有多种表达：' || forms AS description, {sug} || standard AS suggestion, 'info' AS severity
      FROM h JOIN g USING (doc_id, standard) WHERE form <> standard"""


query("I16_term_alias", _alias_sql(_TERM_ROWS, "'术语不统一：'", "'术语'''", "'建议统一使用标准术语：'"))(_run(C.term_alias))
query("I17_unit_alias", _alias_sql(_UNIT_ROWS, "'单位不统一：'", "'单位'''", "'建议统一使用标准单位：'"))(_run(C.unit_alias))
query("C11_term_alias_hits", f"WITH {ZH_SQL} {_alias_hits(_TERM_ROWS)}")(
    lambda spark, d: C.alias_hits(zh_elements(spark, d), C.term_rules()))
query("C12_unit_alias_hits", f"WITH {ZH_SQL} {_alias_hits(_UNIT_ROWS)}")(
    lambda spark, d: C.alias_hits(zh_elements(spark, d), C.unit_rules()))

# --- logic ------------------------------------------------------------------

_PAIR = "coalesce(" + ", ".join(
    f"CASE WHEN contains(before, {S.lit(p)}) AND contains(after, {S.lit(n)}) THEN {S.lit(p + '|' + n)} END" for p, n in R.OPPOSITES) + ")"
query("I18_contradiction", f"""WITH {ZH_SQL}, mk(marker) AS (VALUES {", ".join(f"({S.lit(m)})" for m in R.TURN_MARKERS)}),
    p AS (SELECT zh.*, marker, CAST(strpos(content, marker) - 1 AS INT) AS pos FROM zh JOIN mk ON contains(content, marker)),
    q AS (SELECT *, substr(content, 1, pos) AS before, substr(content, pos + length(marker) + 1) AS after FROM p),
    r AS (SELECT *, {_PAIR} AS pair FROM q)
    SELECT doc_id, element_index, '可能存在前后矛盾' AS title, '' AS suggestion, 'warning' AS severity,
      '在"' || marker || '"前后分别出现了"' || split_part(pair, '|', 1) || '"和"' || split_part(pair, '|', 2) || '"，请确认是否存在逻辑矛盾' AS description,
      substr(content, greatest(pos - 20, 0) + 1, pos + length(marker) + 30 - greatest(pos - 20, 0)) AS location_text
    FROM r WHERE pair IS NOT NULL""")(lambda spark, d: D.detect(zh_elements(spark, d), D.contradiction).select(*COLS))

_YEARS = S.hits("zh", r"[0-9]{4}\s*年")
query("I19_timeline", f"""WITH {ZH_SQL}, y AS (
      SELECT doc_id, element_index, s, CAST(substr(hit, 1, 4) AS INT) AS yr,
        substr(content, greatest(s - 15, 0) + 1, e + 5 - greatest(s - 15, 0)) AS ctx FROM ({_YEARS})
      WHERE CAST(substr(hit, 1, 4) AS INT) BETWEEN {R.YEAR_MIN} AND {R.YEAR_MAX}),
    l AS (SELECT *, lag(yr) OVER w AS pyr, lag(ctx) OVER w AS pctx FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY element_index, s))
    SELECT doc_id, element_index, ctx AS location_text, pctx AS related_text,
      '时间线可能矛盾：' || pyr || '年 → ' || yr || '年' AS title FROM l WHERE pyr - yr > 1""")(
    _run(C.timeline, "doc_id", "element_index", "location_text", "related_text", "title"))

query("I20_empty_section", f"""WITH {ZH_SQL}, l AS (SELECT *, lead(element_type) OVER w AS nt, lead(level) OVER w AS nl FROM zh
      WINDOW w AS (PARTITION BY doc_id ORDER BY element_index))
    SELECT doc_id, element_index, content AS location_text, '章节内容为空："' || content || '"' AS title, 'error' AS severity
    FROM l WHERE element_type = 'heading' AND level <= 2 AND nt = 'heading' AND nl <= level""")(
    _run(C.empty_section, "doc_id", "element_index", "location_text", "title", "severity"))

_NEXT = "lead(content) OVER (PARTITION BY doc_id ORDER BY element_index)"
query("I21_causality", f"""WITH {ZH_SQL}, l AS (SELECT *, {_NEXT} AS nx FROM zh WHERE content <> '')
    SELECT doc_id, element_index, substr(content, 1, 50) || '...' AS location_text,
      '第' || (element_index + 1) || '段使用了"因为"但未找到对应的结论词（所以/因此/导致）' AS description
    FROM l WHERE contains(content, '因为') AND NOT {S.any_word('content', R.RESULT_WORDS)}
      AND nx IS NOT NULL AND NOT {S.any_word('nx', R.RESULT_WORDS)}""")(
    _run(C.causality, "doc_id", "element_index", "location_text", "description"))

_MARKER = "coalesce(" + ", ".join(f"CASE WHEN contains(content, {S.lit(w)}) THEN {S.lit(w)} END" for w in R.CONCLUSION_WORDS) + ")"
query("I22_conclusion", f"""WITH {ZH_SQL} SELECT doc_id, element_index, substr(content, 1, 80) || '...' AS location_text,
      '包含"' || {_MARKER} || '"的段落中没有发现数据或引用，建议补充数据支撑' AS description FROM zh
    WHERE {_MARKER} IS NOT NULL AND NOT regexp_matches(content, '[0-9０-９]') AND NOT {S.any_word('content', R.DATA_WORDS)}""")(
    lambda spark, d: D.detect(zh_elements(spark, d), D.conclusion_without_data).select(
        "doc_id", "element_index", "location_text", "description"))

query("I23_argument", f"""WITH {ZH_SQL} SELECT doc_id, element_index, substr(content, 1, 80) || '...' AS location_text FROM zh
    WHERE element_type = 'paragraph' AND length(content) < 100 AND {S.any_word('content', R.OPINION_WORDS)}
      AND NOT {S.any_word('content', R.EVIDENCE_WORDS)} AND NOT regexp_matches(content, '[0-9０-９]')""")(
    lambda spark, d: D.detect(zh_elements(spark, d), D.argument_without_evidence).select("doc_id", "element_index", "location_text"))

query("I24_conditional", f"WITH {ZH_SQL}, l AS (SELECT *, coalesce({_NEXT}, '') AS nx FROM zh WHERE content <> '') " + " UNION ALL ".join(
    f"""SELECT doc_id, element_index, substr(content, 1, 60) || '...' AS location_text,
      '使用了"{w}"但未找到对应的结论词（{"/".join(t)}）' AS description
      FROM l WHERE contains(content, '{w}') AND NOT {S.any_word('content', t)} AND NOT {S.any_word('nx', t)}""" for w, t in R.IF_THEN))(
    _run(C.conditionals, "doc_id", "element_index", "location_text", "description"))

_CMP = S.any_word("content", R.COMPARE_WORDS)
query("I25_comparison", f"""WITH {ZH_SQL} SELECT doc_id, element_index, 'logic.comparison.unclear_target' AS rule_id,
      '句子包含比较词，但未明确指出与什么进行比较' AS description FROM zh
    WHERE {_CMP} AND length(content) - length(replace(content, '比', '')) = 1 AND NOT {S.any_word('content', ['与', '和', '跟'])} AND length(content) < 50
    """ + "".join(f"""UNION ALL SELECT doc_id, element_index, 'logic.comparison.dimension_mismatch', '同时提及"{a}"和"{b}"，请确认比较维度是否一致'
      FROM zh WHERE {_CMP} AND contains(content, '{a}') AND contains(content, '{b}') """ for a, b in R.DIMENSION_PAIRS))(
    lambda spark, d: D.detect(zh_elements(spark, d), D.comparison).select("doc_id", "element_index", "rule_id", "description"))
