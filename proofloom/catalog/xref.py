"""Queries for cross references and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofloom.catalog import sqlgen as S
from proofloom.catalog.registry import query
from proofloom.catalog.views import ZH_SQL, zh_elements
from proofloom.functions import scalars as X
from proofloom.operators import xref as Q
from proofloom.rules import fixed as R

_CN_LIST = "[" + ", ".join(S.lit(c) for c in R.CN_NUMERALS) + "]"
_CN_INT = f"coalesce(list_position({_CN_LIST}, {{x}}), 0)"
_INT_CN = f"CASE WHEN {{n}} BETWEEN 1 AND 20 THEN {_CN_LIST}[{{n}}] ELSE CAST({{n}} AS VARCHAR) END"
_BIB = r"'(?i)参考文献|references?\b|bibliography'"

STATE_SQL = f"""st AS (SELECT doc_id, element_index, element_type, content, trim(content) AS t,
      CASE WHEN element_type = 'heading' THEN CASE WHEN regexp_matches(content, {_BIB}) THEN element_index ELSE -1 END END AS ev
    FROM zh WHERE content <> ''),
  sec AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY element_index
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS ss FROM st)"""


def _cap(kind, mark, prefix):
    return f"""
      SELECT doc_id, element_index, '{kind}' AS target_type, num AS number,
        '{mark}' || num || CASE WHEN title <> '' THEN ' ' || title ELSE '' END AS label, title,
        '{prefix}' || replace(num, '-', '_') AS bookmark_name
      FROM (SELECT doc_id, element_index, t,
          CASE WHEN regexp_matches(t, '^{mark}\\s*[0-9]+[\\-\\.][0-9]+')
            THEN regexp_extract(t, '^{mark}\\s*([0-9]+)[\\-\\.]', 1) || '-' || regexp_extract(t, '^{mark}\\s*[0-9]+[\\-\\.]([0-9]+)', 1)
            ELSE regexp_extract(t, '^{mark}\\s*([0-9]+)', 1) END AS num,
          trim(CASE WHEN regexp_matches(t, '^{mark}\\s*[0-9]+[\\-\\.][0-9]+')
            THEN regexp_extract(t, '^{mark}\\s*[0-9]+[\\-\\.][0-9]+\\s*(.*)', 1)
            ELSE regexp_extract(t, '^{mark}\\s*[0-9]+\\s*(.*)', 1) END) AS title
        FROM sec WHERE ss < 0 AND element_type IN ('caption', 'paragraph') AND regexp_matches(t, '^{mark}\\s*[0-9]+'))"""


_EQ = r"[(（]\s*([0-9]+)[\-\.]([0-9]+)\s*[)）]\s*$"
TARGETS_SQL = f"""{STATE_SQL}, ch AS (
      SELECT *, {_CN_INT.format(x="raw")} AS cn FROM (SELECT doc_id, element_index, t,
        CASE WHEN regexp_matches(t, '^第[一二三四五六七八九十百零〇0-9]+章') THEN regexp_extract(t, '^第([一二三四五六七八九十百零〇0-9]+)章', 1)
             ELSE regexp_extract(t, '^([0-9]+)\\s*[\\.、]', 1) END AS raw,
        CASE WHEN regexp_matches(t, '^第[一二三四五六七八九十百零〇0-9]+章') THEN trim(regexp_extract(t, '章\\s*(.*)$', 1))
             ELSE trim(regexp_extract(t, '^[0-9]+\\s*[\\.、](.*)$', 1)) END AS title
        FROM sec WHERE ss < 0 AND element_type = 'heading')),
    ch2 AS (SELECT *, CASE WHEN cn > 0 THEN cn ELSE TRY_CAST(raw AS INT) END AS n FROM ch),
    ent AS (SELECT *, regexp_matches(t, '^\\[[0-9]+\\]') AS written FROM sec
            WHERE ss >= 0 AND element_type IN ('paragraph', 'reference') AND t <> ''),
    ent2 AS (SELECT *, sum(CASE WHEN written THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, ss ORDER BY element_index) AS pos FROM ent),
    ent3 AS (SELECT *, CASE WHEN written THEN CAST(CAST(regexp_extract(t, '^\\[([0-9]+)\\]', 1) AS BIGINT) AS VARCHAR) ELSE CAST(pos AS VARCHAR) END AS num,
               substr(CASE WHEN written THEN trim(regexp_extract(t, '^\\[[0-9]+\\]\\s*(.*)', 1)) ELSE t END, 1, 120) AS title FROM ent2),
    tg AS (
      SELECT doc_id, element_index, 'chapter' AS target_type, CAST(n AS VARCHAR) AS number,
        '第' || ({_INT_CN.format(n="n")}) || '章' || CASE WHEN title <> '' THEN ' ' || title ELSE '' END AS label, title,
        '_chapter_' || n AS bookmark_name FROM ch2 WHERE n > 0
      UNION ALL {_cap("figure", "图", "_fig_")} UNION ALL {_cap("table", "表", "_tbl_")}
      UNION ALL SELECT doc_id, element_index, 'equation', num, '(' || num || ')', title, '_eq_' || replace(num, '-', '_') FROM (
        SELECT doc_id, element_index, regexp_extract(t, '{_EQ}', 1) || '-' || regexp_extract(t, '{_EQ}', 2) AS num,
          trim(regexp_replace(t, '{_EQ}', '')) AS title FROM sec
        WHERE ss < 0 AND element_type = 'paragraph' AND regexp_matches(t, '{_EQ}') AND NOT regexp_matches(t, '^[图表]\\s*[0-9]'))
      UNION ALL SELECT doc_id, element_index, 'reference', num, '[' || num || ']', title, '_ref_' || num FROM (
        SELECT doc_id, element_index, CAST(CAST(regexp_extract(t, '^\\[([0-9]+)\\]', 1) AS BIGINT) AS VARCHAR) AS num,
          trim(regexp_extract(t, '^\\[[0-9]+\\]\\s*(.*)', 1)) AS title FROM sec
        WHERE ss < 0 AND element_type = 'reference' AND regexp_matches(t, '^\\[[0-9]+\\]'))
      UNION ALL SELECT doc_id, element_index, 'reference', num, '[' || num || ']', title, '_ref_' || num FROM ent3)"""

_SRC = dict(source="zh", where="element_type NOT IN ('heading', 'reference')")
_PAIR_NUM = "regexp_extract_all(hit, '[0-9]+')[1] || '-' || regexp_extract_all(hit, '[0-9]+')[2]"


def _pair_points(no, kind, regex):
    return f"""SELECT doc_id, element_index, s, e, {no} AS pattern_no, '{kind}' AS target_type, hit, 0 AS sub_pos, {_PAIR_NUM} AS number
      FROM ({S.hits(regex=regex, **_SRC)})"""


def _single_points(no, kind, mark, guard):
    return f"""SELECT doc_id, element_index, s, e - cut AS e, {no} AS pattern_no, '{kind}' AS target_type,
        substr(hit, 1, length(hit) - cut) AS hit, 0 AS sub_pos, substr(dg, 1, length(dg) - cut) AS number
      FROM (SELECT *, regexp_extract(hit, '[0-9]+$') AS dg, CASE WHEN {S.ch('content', 'e')} IN ('-', '.') THEN 1 ELSE 0 END AS cut
            FROM ({S.hits(regex=f"{mark}[[:space:]]*[0-9]+", **_SRC)}))
      WHERE length(dg) > cut {f"AND {S.ch('content', '(s - 1)')} <> '{guard}'" if guard else ""}"""


POINTS_SQL = f"""pt AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY element_index, s, pattern_no, sub_pos) - 1 AS INT) AS scan_index,
      CASE WHEN target_type = 'reference' THEN '[' || number || ']' ELSE hit END AS ref_text FROM (
    {_pair_points(0, "figure", "图[[:space:]]*[0-9]+[-.][0-9]+")} UNION ALL {_single_points(1, "figure", "图", "附")}
    UNION ALL {_pair_points(2, "table", "表[[:space:]]*[0-9]+[-.][0-9]+")} UNION ALL {_single_points(3, "table", "表", "")}
    UNION ALL {_pair_points(4, "equation", "[（(][[:space:]]*[0-9]+[-.][0-9]+[[:space:]]*[）)]")}
    UNION ALL {_pair_points(5, "equation", "式[[:space:]]*[0-9]+[-.][0-9]+")}
    UNION ALL {_pair_points(6, "equation", "公式[[:space:]]*[0-9]+[-.][0-9]+")}
    UNION ALL SELECT doc_id, element_index, s, e, 7, 'chapter', hit, 0, num FROM (
      SELECT *, CASE WHEN cn > 0 THEN CAST(cn AS VARCHAR) ELSE CAST(TRY_CAST(raw AS BIGINT) AS VARCHAR) END AS num FROM (
        SELECT *, {_CN_INT.format(x="raw")} AS cn FROM (SELECT *, regexp_extract(hit, '第(.*)章', 1) AS raw
          FROM ({S.hits(regex="第[一二三四五六七八九十百0-9]+章", **_SRC)})))) WHERE num IS NOT NULL
    UNION ALL SELECT doc_id, element_index, s, e, 8, 'chapter', hit, 0, regexp_extract(hit, '^([0-9]+)', 1)
      FROM ({S.hits(regex="[0-9]+[.][0-9.]*[[:space:]]*节", **_SRC)})
    UNION ALL SELECT doc_id, element_index, s, e, 9, 'reference', hit, CAST(j - 1 AS INT), nums[j] FROM (
      SELECT *, unnest(range(1, len(nums) + 1)) AS j FROM (SELECT *, regexp_extract_all(hit, '[0-9]+') AS nums
        FROM ({S.hits(regex="[[][0-9]+(?:[[:space:]]*[,，;；][[:space:]]*[0-9]+)*[]]", **_SRC)})))))"""

FIRST_SQL = """ft AS (SELECT * FROM tg QUALIFY row_number() OVER (PARTITION BY doc_id, target_type, number ORDER BY element_index) = 1)"""
MATCH_SQL = f"""{FIRST_SQL}, mt AS (
      SELECT pt.doc_id, pt.target_type, pt.number, ref_text, pt.element_index, s AS start_pos, scan_index,
        CASE WHEN ft.label IS NULL THEN 'dangling' ELSE 'valid' END AS status, ft.element_index AS target_index,
        coalesce(label, '未知' || pt.target_type) AS label, bookmark_name
      FROM pt LEFT JOIN ft USING (doc_id, target_type, number)
      UNION ALL SELECT doc_id, target_type, number, '', -1, -1, -1, 'unreferenced', element_index, label, bookmark_name FROM tg
        WHERE (doc_id, target_type, number) NOT IN (SELECT (doc_id, target_type, number) FROM pt)
      UNION ALL SELECT doc_id, target_type, number, '', -1, -1, -1, 'duplicate', element_index, label, bookmark_name FROM tg
        QUALIFY row_number() OVER (PARTITION BY doc_id, target_type, number ORDER BY element_index) > 1)"""
ALL_SQL = f"WITH {ZH_SQL}, {TARGETS_SQL}, {POINTS_SQL}, {MATCH_SQL}"
_M = ["doc_id", "target_type", "number", "ref_text", "element_index", "start_pos", "scan_index", "status", "target_index", "label"]


def _parts(spark, d):
    z = zh_elements(spark, d)
    return Q.targets(z), Q.points(z)


def _matches(spark, d):
    return Q.matches(*_parts(spark, d))


query("E1_ref_section_state", f"""WITH {ZH_SQL}, {STATE_SQL} SELECT doc_id, element_index,
    CASE WHEN ss >= 0 THEN ss END AS section_start FROM sec""")(
    lambda spark, d: Q.bibliography_state(zh_elements(spark, d)).select("doc_id", "element_index", "section_start"))
query("E2_ref_sequence", f"""WITH {ZH_SQL}, {TARGETS_SQL} SELECT doc_id, element_index, num AS number, title FROM ent3""")(
    lambda spark, d: (lambda z: Q.targets(z).join(
        Q.bibliography_state(z).filter("section_start IS NOT NULL").select("doc_id", "element_index"), ["doc_id", "element_index"])
        .select("doc_id", "element_index", "number", "title"))(zh_elements(spark, d)))
query("I29_xref_targets", f"""WITH {ZH_SQL}, {TARGETS_SQL}
    SELECT doc_id, element_index, target_type, number, label, title, bookmark_name FROM tg""")(
    lambda spark, d: Q.targets(zh_elements(spark, d)).select(
        "doc_id", "element_index", "target_type", "number", "label", "title", "bookmark_name"))
query("I30_xref_points", f"""WITH {ZH_SQL}, {POINTS_SQL} SELECT doc_id, element_index, s AS start_pos, e AS end_pos,
    target_type, number, ref_text FROM pt""")(
    lambda spark, d: Q.points(zh_elements(spark, d)).select(
        "doc_id", "element_index", "start_pos", "end_pos", "target_type", "number", "ref_text"))
query("E3_scan_index", f"WITH {ZH_SQL}, {POINTS_SQL} SELECT doc_id, scan_index, element_index, s AS start_pos, ref_text FROM pt")(
    lambda spark, d: Q.points(zh_elements(spark, d)).select("doc_id", "scan_index", "element_index", "start_pos", "ref_text"))
query("E5_first_target", f"WITH {ZH_SQL}, {TARGETS_SQL}, {FIRST_SQL} SELECT doc_id, target_type, number, element_index, label FROM ft")(
    lambda spark, d: Q.first_targets(Q.targets(zh_elements(spark, d))).select("doc_id", "target_type", "number", "element_index", "label"))
query("C2_xref_match", f"{ALL_SQL} SELECT {', '.join(_M)} FROM mt WHERE status IN ('valid', 'dangling')")(
    lambda spark, d: Q.matched(*_parts(spark, d)).select(*_M))
query("C3_xref_unreferenced", f"{ALL_SQL} SELECT {', '.join(_M)} FROM mt WHERE status = 'unreferenced'")(
    lambda spark, d: Q.unreferenced(*_parts(spark, d)).select(*_M))
query("D13_xref_duplicates", f"{ALL_SQL} SELECT {', '.join(_M)} FROM mt WHERE status = 'duplicate'")(
    lambda spark, d: Q.duplicates(_parts(spark, d)[0]).select(*_M))
query("E4_match_order", f"""{ALL_SQL} SELECT doc_id, ref_text, status, target_index,
    scan_index FROM mt""")(
    lambda spark, d: Q.in_scan_order(_matches(spark, d)).select("doc_id", "ref_text", "status", "target_index", "scan_index"))
query("D12_xref_summary", f"""{ALL_SQL},
    a AS (SELECT doc_id, count(*) AS target_count, count_if(target_type = 'figure') AS figure_targets,
      count_if(target_type = 'table') AS table_targets, count_if(target_type = 'equation') AS equation_targets,
      count_if(target_type = 'chapter') AS chapter_targets, count_if(target_type = 'reference') AS reference_targets FROM tg GROUP BY 1),
    b AS (SELECT doc_id, count(*) AS ref_point_count FROM pt GROUP BY 1),
    c AS (SELECT doc_id, count_if(status = 'valid') AS valid_count, count_if(status = 'dangling') AS dangling_count,
      count_if(status = 'unreferenced') AS unreferenced_count FROM mt GROUP BY 1)
    SELECT doc_id, coalesce(target_count, 0) AS target_count, coalesce(figure_targets, 0) AS figure_targets,
      coalesce(table_targets, 0) AS table_targets, coalesce(equation_targets, 0) AS equation_targets,
      coalesce(chapter_targets, 0) AS chapter_targets, coalesce(reference_targets, 0) AS reference_targets,
      coalesce(ref_point_count, 0) AS ref_point_count, coalesce(valid_count, 0) AS valid_count,
      coalesce(dangling_count, 0) AS dangling_count, 0 AS mismatch_count, coalesce(unreferenced_count, 0) AS unreferenced_count
    FROM a FULL JOIN b USING (doc_id) FULL JOIN c USING (doc_id)""")(
    lambda spark, d: (lambda t, p: Q.summary(t, p, Q.matches(t, p)))(*_parts(spark, d)))
query("I26_xref_issues", f"""{ALL_SQL} SELECT doc_id, 'xref.' || status || '.' || target_type AS rule_id,
      CASE status WHEN 'dangling' THEN element_index ELSE target_index END AS element_index,
      CASE status WHEN 'dangling' THEN ref_text ELSE label END AS location_text,
      CASE status WHEN 'dangling' THEN 'error' ELSE 'warning' END AS severity,
      CASE status WHEN 'dangling' THEN 0.95 WHEN 'unreferenced' THEN 0.8 ELSE 0.85 END AS confidence,
      CASE status WHEN 'dangling' THEN '悬空引用："' || ref_text WHEN 'unreferenced' THEN '未被引用目标："' || label
        ELSE '重复编号："' || label END || '"' AS title
    FROM mt WHERE status <> 'valid'""")(
    lambda spark, d: Q.match_issues(_matches(spark, d)).select(
        "doc_id", "rule_id", "element_index", "location_text", "severity", "confidence", "title"))
query("I31_xref_suggestions", f"""{ALL_SQL} SELECT doc_id, status AS type, CASE status WHEN 'dangling' THEN ref_text ELSE label END AS subject,
      CASE status WHEN 'dangling' THEN '找不到目标："' || ref_text WHEN 'unreferenced' THEN '目标未被引用："' || label
        ELSE '重复编号："' || label END || '"' AS message,
      CASE status WHEN 'dangling' THEN '请检查引用"' || ref_text || '"是否正确'
        WHEN 'unreferenced' THEN '目标"' || label || '"未被引用，是否需要添加引用？' ELSE '存在重复编号"' || label || '"，请检查' END AS suggestion,
      scan_index, target_index FROM mt WHERE status <> 'valid'""")(
    lambda spark, d: Q.suggestions(_matches(spark, d)))
query("C5_adoptable_refs", f"""{ALL_SQL}, rf AS (SELECT * FROM mt WHERE target_type = 'reference' AND ref_text <> ''),
    fl AS (SELECT DISTINCT doc_id, '[' || (sk % 7) || ']' AS ref_text FROM zh)
    SELECT doc_id, 'unreferenced' AS type, ref_text AS target_label, bookmark_name, element_index, scan_index, '可创建字段：' || ref_text AS title
      FROM rf WHERE status = 'valid' AND (doc_id, ref_text) NOT IN (SELECT (doc_id, ref_text) FROM fl)
      QUALIFY row_number() OVER (PARTITION BY doc_id, ref_text ORDER BY scan_index) = 1
    UNION ALL SELECT doc_id, 'dangling', ref_text, NULL, element_index, scan_index, '悬空引用：' || ref_text FROM rf WHERE status = 'dangling'""")(
    lambda spark, d: Q.adoptable(_matches(spark, d), zh_elements(spark, d, "sk").selectExpr("doc_id", "'[' || (sk % 7) || ']' AS ref_text")).select(
        "doc_id", "type", "target_label", "bookmark_name", "element_index", "scan_index", "title"))
query("B11_xref_exclusions", f"""WITH {ZH_SQL.replace("zh AS (", "zz AS (", 1)},
    zh AS (SELECT * FROM zz WHERE q % 6 <> 0), {TARGETS_SQL} SELECT doc_id, target_type, number, element_index FROM tg""")(
    lambda spark, d: Q.targets(zh_elements(spark, d, "q").withColumn("metadata", F.create_map(
        F.lit("exclude_from_xref_targets"), F.when(F.col("q") % 6 == 0, "true").otherwise("false")))).select(
        "doc_id", "target_type", "number", "element_index"))

# --- citations ---------------------------------------------------------------

_CITE = "[[][0-9]+(?:[,，–-][0-9]+)*[]]"
CITE_SQL = f"""WITH {ZH_SQL}, bs AS (SELECT doc_id, min(element_index) AS bib_start FROM zh
      WHERE element_type = 'heading' AND regexp_matches(content, {_BIB}) GROUP BY 1),
    en AS (SELECT doc_id, CAST(regexp_extract(trim(content), '^\\[([0-9]+)\\]', 1) AS INT) AS n, max(element_index) AS ix
      FROM zh JOIN bs USING (doc_id) WHERE element_index > bib_start AND regexp_matches(trim(content), '^\\[[0-9]+\\]') GROUP BY ALL),
    ct AS (SELECT * FROM ({S.hits("zh", _CITE)}) JOIN bs USING (doc_id) WHERE element_index < bib_start),
    nb AS (SELECT *, unnest(string_split_regex(substr(hit, 2, length(hit) - 2), '[,，]')) AS part, unnest(range(9)) AS pos FROM ct),
    nx AS (SELECT doc_id, element_index, s, pos, unnest(CASE WHEN regexp_matches(part, '[–-]')
        THEN range(CAST(regexp_extract(part, '^([0-9]+)', 1) AS BIGINT), CAST(regexp_extract(part, '[–-]([0-9]+)', 1) AS BIGINT) + 1)
        ELSE [CAST(part AS BIGINT)] END) AS n FROM nb WHERE part IS NOT NULL),
    fd AS (SELECT doc_id, element_index, s, string_agg(CAST(ix AS VARCHAR), ',' ORDER BY pos, n) AS found FROM nx JOIN en USING (doc_id, n) GROUP BY ALL)"""
query("C4_citation_ref_join", f"""{CITE_SQL} SELECT doc_id, element_index, s AS start_pos, hit AS citation,
      found IS NOT NULL AS fixable, coalesce(found, '') AS found FROM ct LEFT JOIN fd USING (doc_id, element_index, s)""")(
    lambda spark, d: Q.body_citations(zh_elements(spark, d)).select(
        "doc_id", "element_index", "start_pos", "citation", "fixable",
        F.coalesce(F.array_join(F.col("ref_indices").cast("array<string>"), ","), F.lit("")).alias("found")))
query("I27_plain_text_citation", f"""{CITE_SQL} SELECT doc_id, element_index, s AS start_pos, e AS end_pos,
      '手动引用 ' || hit || ' 未使用交叉引用功能' AS title, trim(substr(content, greatest(s - 10, 0) + 1, e + 10 - greatest(s - 10, 0))) AS location_text,
      found IS NOT NULL AS fixable, CASE WHEN found IS NOT NULL THEN trim(substr(content, 1, 40)) END AS para_fingerprint
    FROM ct LEFT JOIN fd USING (doc_id, element_index, s)""")(
    lambda spark, d: Q.citation_issues(zh_elements(spark, d)).select(
        "doc_id", "element_index", "start_pos", "end_pos", "title", "location_text", "fixable",
        F.col("fix_payload.para_fingerprint").alias("para_fingerprint")))
query("I27_no_bibliography_warning", f"""{CITE_SQL} SELECT DISTINCT doc_id, '{R.NO_BIBLIOGRAPHY_WARNING}' AS warning FROM zh
    WHERE doc_id NOT IN (SELECT doc_id FROM bs)""")(lambda spark, d: Q.citation_warnings(zh_elements(spark, d)))

_NUMS = "q || ',' || ln || '-' || (ln + q % 4) || '，' || (q % 3) || '–' || (q % 3 + 1) || ',9-1'"
query("H2_parse_citation_numbers", f"""WITH {ZH_SQL}, p AS (SELECT doc_id, element_index, unnest(string_split_regex({_NUMS}, '[,，]')) AS part FROM zh)
    SELECT doc_id, element_index, sum(n) AS total, count(*) AS numbers FROM (SELECT doc_id, element_index, unnest(
      CASE WHEN regexp_matches(part, '[–-]') THEN range(CAST(regexp_extract(part, '^([0-9]+)', 1) AS BIGINT), CAST(regexp_extract(part, '[–-]([0-9]+)', 1) AS BIGINT) + 1)
      ELSE [CAST(part AS BIGINT)] END) AS n FROM p) GROUP BY ALL""")(
    lambda spark, d: zh_elements(spark, d, "q", "ln").select(
        "doc_id", "element_index", F.explode(X.parse_citation_numbers(F.expr(_NUMS))).alias("n")).groupBy(
        "doc_id", "element_index").agg(F.sum("n").alias("total"), F.count("*").alias("numbers")))
query("H1_cn_num", f"""WITH {ZH_SQL} SELECT doc_id, element_index, {_INT_CN.format(n="(q % 24)")} AS cn,
    {_CN_INT.format(x="substr('一二三四五六七八九十百', q % 12 + 1, 1)")} AS n FROM zh""")(
    lambda spark, d: zh_elements(spark, d, "q").select(
        "doc_id", "element_index", X.int_to_cn_num(F.col("q") % 24).alias("cn"),
        X.cn_num_to_int(F.expr("substr('一二三四五六七八九十百', q % 12 + 1, 1)")).alias("n")))
