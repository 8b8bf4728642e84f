"""Queries for formatting (B9, C6-C9, C21-C22, D10, D27, E10, H3-H12, H18, H21, J*, M8, M10), lint and increments."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofloom.catalog import sqlgen as S
from proofloom.catalog.registry import query
from proofloom.catalog.views import LATIN_SQL, ZH_SQL, _split, latin_elements, table, zh_elements
from proofloom.functions import scalars as X
from proofloom.operators import formatting as M
from proofloom.operators import incremental as C
from proofloom.operators import lint as L
from proofloom.rules import fixed as R

# --- conformance: one rule per slot, taken from the fixed style labels --------------------------

_RULES = [("heading_1", "黑体", 12.0), ("heading_2", "宋体", 10.5), ("heading_3", "", 0.0), ("paragraph_0", "宋体", 11.25)]
_RULES_SQL = "ru(slot, want_font, want_size) AS (VALUES " + ", ".join(f"('{s}', '{f}', CAST({z} AS DOUBLE))" for s, f, z in _RULES) + ")"


def _rules(spark):
    return spark.createDataFrame(_RULES, "slot string, font string, size double")




def _meta():
    return F.create_map(F.lit("structure_role"), F.when(F.col("q") % 10 == 0, "heading").otherwise("body"), F.lit("heading_level"), (F.col("q") % 6).cast("string"),
                     F.lit("exclude_from_format_body"), F.when(F.col("q") % 9 == 0, "true").otherwise("false"))



def _formatted(spark, d):
    return zh_elements(spark, d, "q").withColumn("metadata", _meta())


_SLOT = "CASE WHEN q % 10 = 0 AND q % 6 > 0 THEN 'heading_' || least(q % 6, 4) WHEN element_type = 'heading' THEN 'heading_' || least(level, 4) ELSE 'paragraph_0' END"
CHECK_SQL = f"""WITH {ZH_SQL}, {_RULES_SQL}, c AS (SELECT *, trim(substr(content, 1, 40)) AS loc, CASE WHEN font_name_cn <> '' THEN font_name_cn ELSE font_name_en END AS font_now,
    CASE slot WHEN 'heading_1' THEN '一级标题' WHEN 'heading_2' THEN '二级标题' WHEN 'heading_3' THEN '三级标题' WHEN 'heading_4' THEN '四级标题' ELSE '正文段落' END AS label
  FROM (SELECT *, {_SLOT} AS slot FROM zh WHERE q % 9 <> 0) JOIN ru USING (slot))"""


def _checked(spark, d):
    return M.checked_elements(_formatted(spark, d), _rules(spark))


query("J1_semantic_slot", f"WITH {ZH_SQL} SELECT doc_id, element_index, {_SLOT} AS slot FROM zh")(
    lambda spark, d: _formatted(spark, d).select("doc_id", "element_index", M.semantic_slot().alias("slot")))
query("C6_format_rule_join", f"{CHECK_SQL} SELECT doc_id, element_index, slot, want_font, want_size, font_now FROM c")(
    lambda spark, d: _checked(spark, d).select("doc_id", "element_index", "slot", "want_font", "want_size", "font_now"))
query("J2_format_font", f"""{CHECK_SQL} SELECT doc_id, element_index, 'format_font_' || slot AS rule_id, label || '字体不符规范' AS title, '规范要求 ' || want_font || '，实际为 ' || font_now AS description,
    want_font AS fix_value FROM c WHERE want_font <> '' AND font_now <> '' AND font_now <> want_font""")(
    lambda spark, d: M.font_issues(_checked(spark, d)).select("doc_id", "element_index", "rule_id", "title", "description", F.col("fix_payload.value").alias("fix_value")))
query("J3_format_size", f"""{CHECK_SQL} SELECT doc_id, element_index, 'format_size_' || slot AS rule_id, label || '字号不符规范' AS title, loc AS location_text FROM c
    WHERE want_size <> 0 AND abs(font_size_pt - want_size) > 0.5""")(
    lambda spark, d: M.size_issues(_checked(spark, d)).select("doc_id", "element_index", "rule_id", "title", "location_text"))
_SPACING = """{check}, b AS (SELECT * FROM c WHERE NOT (line_spacing_type = 'single' AND line_spacing_value = 1) AND (line_spacing_type <> '{mode}' OR abs(line_spacing_value - {value}) > {tol}))
    SELECT doc_id, element_index, description FROM (SELECT *, {desc} AS description FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY element_index) <= 5)"""
query("J4_format_line_spacing", _SPACING.format(check=CHECK_SQL, mode="multiple", value=1.5, tol=0.05, desc="""'规范要求 1.5 倍行距，实际为' || CASE WHEN line_spacing_type = 'multiple'
    THEN printf('%.2f', line_spacing_value) || ' 倍' ELSE '非倍数行距（' || line_spacing_type || '）' END"""))(
    lambda spark, d: M.spacing_issues(_checked(spark, d), "multiple", 1.5).select("doc_id", "element_index", "description"))
query("E10_per_doc_cap", _SPACING.format(check=CHECK_SQL, mode="exact", value=22.0, tol=1.0, desc="""'规范要求固定值 22.0pt，实际为' || CASE WHEN line_spacing_type = 'exact'
    THEN '固定值 ' || printf('%.1f', line_spacing_value) || 'pt' ELSE '非固定值行距（' || line_spacing_type || '）' END"""))(
    lambda spark, d: M.spacing_issues(_checked(spark, d), "exact", 22.0).select("doc_id", "element_index", "description"))
_RAW_NULL = ", ".join(f"CAST(NULL AS STRING) AS {c}" for c in ("h2Font", "h2Size", "h3Font", "h3Size", "h4Font", "h4Size", "bFont", "bSize"))
query("J5_format_rules_load", """WITH r AS (SELECT p_partkey AS rule_set_id, p_name, p_size FROM part WHERE p_size % 4 <> 0)
    SELECT rule_set_id, 'heading_1' AS slot, p_name AS font, CAST(p_size AS DOUBLE) AS size FROM r
    UNION ALL SELECT rule_set_id, s, '', 0.0 FROM r, (VALUES ('heading_2'), ('heading_3'), ('heading_4'), ('paragraph_0')) t(s)""")(
    lambda spark, d: M.load_rule_sets(table(spark, d, "part").selectExpr("p_partkey AS rule_set_id", "CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_name END AS h1Font",
                                                                        "CASE WHEN p_size % 4 = 0 THEN 'x' ELSE CAST(p_size AS STRING) END AS h1Size", *_split(_RAW_NULL))))
_TR = "p_partkey AS rule_set_id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 3 = 1 END AS saved_by_user, CASE p_partkey % 4 WHEN 0 THEN ' Manual' WHEN 1 THEN 'ai_reviewed' WHEN 2 THEN NULL ELSE 'guess' END AS save_source"
query("B9_trusted_rules", """SELECT p_partkey AS rule_set_id, CASE p_partkey % 4 WHEN 0 THEN ' Manual' WHEN 1 THEN 'ai_reviewed' ELSE 'team_manual' END AS save_source FROM part
    WHERE p_size % 3 = 1 AND p_partkey % 4 < 3""")(
    lambda spark, d: M.trusted_rules(table(spark, d, "part").selectExpr(*[c.strip() for c in _split(_TR)]), "team_manual").select("rule_set_id", "save_source"))

# --- applying and inferring --------------------------------------------------------------------

_STYLES = [("heading1", "黑体", 16.0, "center"), ("body", "宋体", None, None), ("figure_caption", None, 9.0, "center"), ("table_caption", "楷体", None, None)]
query("C7_apply_style_rules", f"""WITH {ZH_SQL}, s AS (SELECT *, CASE WHEN element_type = 'heading' AND level = 1 THEN 1 WHEN element_type IN ('heading', 'paragraph', 'list_item') THEN 2
      WHEN element_type = 'caption' AND starts_with(content, '图') THEN 3 WHEN element_type = 'caption' THEN 4 END AS sl FROM zh)
    SELECT doc_id, element_index, CASE sl WHEN 1 THEN '黑体' WHEN 2 THEN '宋体' WHEN 4 THEN '楷体' ELSE font_name_cn END AS cn,
      CASE sl WHEN 1 THEN 16.0 WHEN 3 THEN 9.0 ELSE font_size_pt END AS size, CASE WHEN sl IN (1, 3) THEN 'center' ELSE alignment END AS align FROM s""")(
    lambda spark, d: M.apply_styles(zh_elements(spark, d), spark.createDataFrame(_STYLES, "slot string, font_name_cn string, font_size_pt double, alignment string")).select(
        "doc_id", "element_index", F.col("font.font_name_cn").alias("cn"), F.col("font.font_size_pt").alias("size"), F.col("para.alignment").alias("align")))
query("C8_apply_page_section_rules", "SELECT doc_id, 'A4' AS paper_size, 3.8 AS margin_top_cm, CAST(n_chars AS DOUBLE) AS margin_left_cm, '页眉' AS header, 10.5 AS header_size FROM documents")(
    lambda spark, d: M.apply_page_rules(table(spark, d, "documents").select("doc_id", F.lit("A3").alias("paper_size"), F.lit(1.0).alias("margin_top_cm"), F.col("n_chars").cast("double").alias("margin_left_cm")),
                                        {"paper_size": "A4", "margin_top_cm": 3.8, "margin_left_cm": None}, [{"name": "正文", "header_text": "页眉"}]).select(
        "doc_id", "paper_size", "margin_top_cm", "margin_left_cm", F.col("sections")[0]["header_text"].alias("header"), F.col("sections")[0]["header_size_pt"].alias("header_size")))
query("C9_apply_table_style", "SELECT p_partkey, p_partkey % 10 = 0 AS is_header, CASE WHEN p_partkey % 10 = 0 THEN p_brand ELSE '宋体' END AS font_name_cn, CAST(p_size AS DOUBLE) AS font_size_pt FROM part")(
    lambda spark, d: M.apply_table_style(table(spark, d, "part").selectExpr("p_partkey", "p_partkey % 10 = 0 AS is_header", "p_brand AS font_name_cn", "CAST(p_size AS DOUBLE) AS font_size_pt"),
                                         {"font_name_cn": "宋体", "font_size_pt": None}))
_ST = ("CAST(floor(p_partkey / 8) AS BIGINT) AS template_id, 's' || p_partkey % 8 AS style_name, CASE WHEN p_partkey % 8 = 0 THEN CASE WHEN p_size % 5 = 0 THEN 's7' END ELSE 's' || (p_partkey % 8 - 1) END AS base_style, "
       "CASE WHEN p_size % 3 = 0 THEN p_name END AS east_asia, CASE WHEN p_size % 4 = 0 THEN p_brand END AS ascii, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS size_pt")
_RESOLVED = f"""WITH RECURSIVE st AS (SELECT {_ST} FROM part), w AS (SELECT template_id, style_name, style_name AS at, 0 AS depth FROM st
      UNION ALL SELECT w.template_id, w.style_name, st.base_style, depth + 1 FROM w JOIN st ON st.template_id = w.template_id AND st.style_name = w.at WHERE st.base_style IS NOT NULL AND depth < 100),
    j AS (SELECT w.template_id, w.style_name, depth, east_asia, ascii, size_pt FROM w JOIN st ON st.template_id = w.template_id AND st.style_name = w.at),
    rs AS (SELECT template_id, style_name, arg_min(east_asia, depth) FILTER (east_asia IS NOT NULL) AS east_asia, arg_min(ascii, depth) FILTER (ascii IS NOT NULL) AS ascii,
      arg_min(size_pt, depth) FILTER (size_pt IS NOT NULL) AS size_pt FROM j GROUP BY ALL)"""


def _styles(spark, d):
    return table(spark, d, "part").selectExpr(*[c.strip() for c in _split(_ST)])


query("C21_style_inheritance", f"{_RESOLVED} SELECT * FROM rs")(lambda spark, d: M.resolve_styles(_styles(spark, d)))
query("C22_run_font_fallback", f"""{_RESOLVED} SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'own' ELSE east_asia END AS font_eastAsia, coalesce(CASE WHEN p_size % 9 = 0 THEN 1.5 END, size_pt) AS font_size_pt,
      coalesce(ascii, CASE WHEN p_size % 7 = 0 THEN 'own' ELSE east_asia END) AS font_name
    FROM part LEFT JOIN rs ON template_id = floor(p_partkey / 8) AND style_name = 's' || p_partkey % 8""")(
    lambda spark, d: M.run_fonts(table(spark, d, "part").selectExpr(
        "p_partkey", "CAST(floor(p_partkey / 8) AS BIGINT) AS template_id", "'s' || p_partkey % 8 AS style_name", "CASE WHEN p_size % 7 = 0 THEN 'own' ELSE '' END AS font_eastAsia",
        "CAST(NULL AS STRING) AS font_ascii", "CAST(NULL AS STRING) AS font_name", "CASE WHEN p_size % 9 = 0 THEN 1.5D END AS font_size_pt"), M.resolve_styles(_styles(spark, d))).select(
        "p_partkey", "font_eastAsia", "font_size_pt", "font_name"))

# Template paragraphs: the lines of an order, styles by line number.
_PARA = ("doc_id AS template_id, element_index AS para_index, style_name, content AS text, {cn} AS cn_font, font_name_en AS en_font, {sz} AS size_pt, {bold} AS bold, {al} AS alignment, "
         "{lt} AS spacing_type, {lv} AS spacing_value, CAST(q AS DOUBLE) AS space_before, CASE WHEN q % 4 = 0 THEN NULL ELSE q * 0.5 END AS space_after, q % 5 > 0 AS has_runs, CAST(q AS DOUBLE) AS first_indent_pt")
_PARA_SQL = f"pa AS (SELECT {_PARA.format(cn='font_name_cn', sz='font_size_pt', bold='bold', al='alignment', lt='line_spacing_type', lv='line_spacing_value')} FROM zh)"


def _paragraphs(spark, d):
    z = zh_elements(spark, d, "q")
    return z.select(F.col("doc_id").alias("template_id"), F.col("element_index").alias("para_index"), "style_name", F.col("content").alias("text"), F.col("font.font_name_cn").alias("cn_font"),
                    F.col("font.font_name_en").alias("en_font"), F.col("font.font_size_pt").alias("size_pt"), F.col("font.bold").alias("bold"), F.col("para.alignment").alias("alignment"),
                    F.col("para.line_spacing_type").alias("spacing_type"), F.col("para.line_spacing_value").alias("spacing_value"), F.col("q").cast("double").alias("space_before"),
                    F.when(F.col("q") % 4 != 0, F.col("q") * 0.5).alias("space_after"), (F.col("q") % 5 > 0).alias("has_runs"), F.col("q").cast("double").alias("first_indent_pt"))


query("D10_infer_template_style", f"""WITH {ZH_SQL}, {_PARA_SQL}, tp AS (SELECT *, row_number() OVER (PARTITION BY template_id, style_name ORDER BY para_index) AS rank FROM pa QUALIFY rank <= 3),
    ag AS (SELECT template_id, style_name, {", ".join(f"max(CASE WHEN rank = {i} THEN {c} END) AS {c}{i}" for c in ("cn_font", "size_pt", "alignment", "spacing_type") for i in (1, 2, 3))},
      round(avg(space_before), 1) AS space_before_pt, round(avg(space_after), 1) AS space_after_pt FROM tp GROUP BY ALL),
    mk AS (SELECT DISTINCT template_id, style_name, 'table_caption' AS cap FROM pa WHERE starts_with(text, '表'))
    SELECT template_id, style_name, CASE style_name WHEN 'Heading 1' THEN 'heading1' WHEN 'Heading 2' THEN 'heading2' WHEN 'Normal' THEN 'body' WHEN 'Caption' THEN cap END AS slot,
      {", ".join(f"CASE WHEN {c}2 = {c}3 THEN {c}2 ELSE {c}1 END AS {o}" for c, o in (("cn_font", "font_name_cn"), ("size_pt", "font_size_pt"), ("alignment", "alignment"), ("spacing_type", "line_spacing_type")))},
      space_before_pt, space_after_pt FROM ag LEFT JOIN mk USING (template_id, style_name)""")(
    lambda spark, d: M.infer_template_style(_paragraphs(spark, d)).select(
        "template_id", "style_name", "slot", "font_name_cn", "font_size_pt", "alignment", "line_spacing_type", "space_before_pt", "space_after_pt"))
query("D27_first_style_sample", f"""WITH {ZH_SQL}, {_PARA_SQL}, f AS (SELECT *, CASE style_name WHEN 'Heading 1' THEN 'h1' WHEN 'Heading 2' THEN 'h2' WHEN 'Normal' THEN 'body' END AS slot FROM pa WHERE has_runs),
    g AS (SELECT * FROM f WHERE slot IS NOT NULL QUALIFY row_number() OVER (PARTITION BY template_id, slot ORDER BY para_index) = 1)
    SELECT template_id, slot || 'Font' AS key, coalesce(cn_font, en_font) AS value FROM g UNION ALL SELECT template_id, 'westFont', en_font FROM g WHERE slot = 'body'
    UNION ALL SELECT template_id, 'align', alignment FROM g WHERE slot = 'body'""")(
    lambda spark, d: M.first_style_sample(_paragraphs(spark, d)).filter("key LIKE '%Font' OR key = 'align'"))
_EMU = ("CAST(floor(p_partkey / 3) AS BIGINT) AS template_id, CAST(p_partkey % 3 AS INT) AS section_index, p_size * 100000 AS top, p_size * 36000 AS bottom, "
        "CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 54321 END AS left, 360000 AS right")
query("D27_section_margins", f"""WITH s AS (SELECT {_EMU.replace('AS left', 'AS "left"').replace('AS right', 'AS "right"')} FROM part), f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY template_id ORDER BY section_index) = 1)
    SELECT template_id, 'margin' || k AS key, CAST(round(v / 360000.0, 2) AS DOUBLE)::VARCHAR AS value FROM (SELECT template_id, unnest(['Top', 'Bottom', 'Left', 'Right']) AS k, unnest([top, bottom, "left", "right"]) AS v FROM f) WHERE v IS NOT NULL""")(
    lambda spark, d: M.first_section_margins(table(spark, d, "part").selectExpr(*[c.strip() for c in _split(_EMU)])))
query("H12_merge_style_rules", f"WITH {ZH_SQL} SELECT doc_id, element_index, coalesce(nullif(font_name_cn, ''), font_name_en) AS font, CASE WHEN q % 2 = 0 THEN 20.0 ELSE font_size_pt END AS size FROM zh")(
    lambda spark, d: zh_elements(spark, d, "q").select("doc_id", "element_index", *M.merge_styles(
        {"font": F.col("font.font_name_en"), "size": F.col("font.font_size_pt")}, {"font": F.nullif("font.font_name_cn", F.lit("")), "size": F.when(F.col("q") % 2 == 0, 20.0)})))

# --- conversions -------------------------------------------------------------------------------

_SIZES = list(R.CN_SIZES.items())
_SIZE_TEXT = "CASE p_partkey % 4 WHEN 0 THEN element_at(array({a}), p_size % 16 + 1) WHEN 1 THEN p_size || 'pt' WHEN 2 THEN p_size || '.5 磅' ELSE p_brand END".format(a=", ".join(S.lit(k) for k, _ in _SIZES))
query("H3_cn_size_to_pt", f"""SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN [{', '.join(str(v) for _, v in _SIZES)}][p_size % 16 + 1] WHEN 1 THEN p_size WHEN 2 THEN p_size + 0.5 END AS DOUBLE) AS pt,
    (SELECT arg_min(n, d * 1000 + i) FROM (SELECT n, i, abs(v - p_size * 0.7) AS d FROM (VALUES {', '.join(f"('{k}', {v}, {i})" for i, (k, v) in enumerate(_SIZES))}) t(n, v, i)) WHERE d < 0.3) AS cn FROM part""")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", X.cn_size_to_pt(F.expr(_SIZE_TEXT)).alias("pt"), X.pt_to_cn_size(F.col("p_size") * 0.7).alias("cn")))
_ALIGN = ["左对齐", " CENTER", "靠右", "两端", "middle"]
query("H4_parse_alignment", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'left' WHEN 1 THEN 'center' WHEN 2 THEN 'right' WHEN 3 THEN 'justify' END AS alignment FROM part")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", X.parse_alignment(F.expr(f"element_at(array({', '.join(S.lit(a) for a in _ALIGN)}), p_size % 5 + 1)")).alias("alignment")))
_LS = "CASE p_size % 7 WHEN 0 THEN '固定值 ' || p_size || ' 磅' WHEN 1 THEN p_size || '磅' WHEN 2 THEN '单倍行距' WHEN 3 THEN '双倍' WHEN 4 THEN '1.5倍行距' WHEN 5 THEN p_size || ' 倍' ELSE '随意' END"
query("H5_parse_line_spacing", """SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'exact' WHEN 1 THEN 'exact' WHEN 2 THEN 'single' WHEN 3 THEN 'double' WHEN 4 THEN 'one_point_five' WHEN 5 THEN 'multiple' END AS type,
    CAST(CASE p_size % 7 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 1.5 WHEN 5 THEN p_size END AS DOUBLE) AS value FROM part""")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", X.parse_line_spacing(F.expr(_LS)).alias("s")).select("p_partkey", "s.type", "s.value"))
query("H6_parse_margin", """SELECT p_partkey, CAST(CASE p_size % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size / 10.0 WHEN 2 THEN p_size / 10.0 END AS DOUBLE) AS cm, CASE p_size % 3 WHEN 0 THEN 'arabic' WHEN 1 THEN 'upper_roman' END AS page_format FROM part""")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", X.parse_margin_cm(F.expr("CASE p_size % 4 WHEN 0 THEN p_size || ' CM' WHEN 1 THEN p_size || 'mm' WHEN 2 THEN p_size || '毫米' ELSE p_size || 'in' END")).alias("cm"),
        X.parse_page_number_format(F.expr("CASE p_size % 3 WHEN 0 THEN '数字' WHEN 1 THEN '罗马数字' ELSE 'abc' END")).alias("page_format")))
query("H7_normalize_style_map", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '宋体' END AS font_name_cn, CASE WHEN p_size % 2 = 1 THEN 'Arial' END AS font_name_en, CAST(p_size AS DOUBLE) AS font_size_pt,
    CASE WHEN p_size % 3 = 0 THEN true END AS bold, 2.0 AS first_indent_chars FROM part""")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", M.normalize_style_map(F.expr(
        "map('字体', CASE WHEN p_size % 2 = 0 THEN '宋体' ELSE 'Arial' END, 'size', p_size || 'pt', '加粗', CASE WHEN p_size % 3 = 0 THEN 'true' ELSE 'false' END, '首行缩进', '2字符')")).alias("s")).select(
        "p_partkey", "s.font_name_cn", "s.font_name_en", "s.font_size_pt", "s.bold", "s.first_indent_chars"))
_TPL = "CAST(floor(p_partkey / 3) AS BIGINT) AS template_id, CASE WHEN p_partkey % 3 = 0 THEN 'page' ELSE 'body' END AS slot, CASE p_partkey % 3 WHEN 0 THEN 'paper_size' WHEN 1 THEN 'font_name_cn' ELSE 'bold' END AS attr, p_name AS value"
query("H8_fill_style_defaults", f"""WITH t AS (SELECT {_TPL} FROM part), w AS (SELECT DISTINCT template_id, s, a, v FROM t, (VALUES ('body', 'font_name_cn', '宋体'), ('body', 'font_name_en', 'Times New Roman'),
      ('body', 'font_size_pt', '12.0'), ('body', 'first_indent_chars', '2'), ('page', 'paper_size', 'A4')) d(s, a, v))
    SELECT * FROM t UNION ALL SELECT template_id, s, a, v FROM w WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.template_id = w.template_id AND t.slot = s AND t.attr = a)""")(
    lambda spark, d: M.fill_defaults(table(spark, d, "part").selectExpr(*[c.strip() for c in _split(_TPL)])))
_TEXT = ("'纸张A4，上边距' || p_size || 'cm，左右：' || (p_size + 1) || 'cm。标题（黑体，二号，居中）。一级标题：楷体，' || p_size || 'pt，加粗。正文：宋体，小四。行距：' || (p_size % 3 + 1) || '倍。' "
         "|| CASE WHEN p_size % 2 = 0 THEN '金额单位：万元。请注意千位分隔。' ELSE '图序号：图' || p_size || '，引用规范。' END")
_HEAD = "'页眉：' || CASE p_size % 3 WHEN 0 THEN '年度报告' WHEN 1 THEN '楷体，' || p_size || '号' ELSE '某校论文 Arial, ' || p_size || '.5pt，居中' END || '。'"
query("H9_header_rules", f"""WITH r AS (SELECT p_partkey AS rule_text_id, p_size AS z, {_HEAD} AS t FROM part)
    SELECT rule_text_id, 'header' AS slot, 'header_text' AS attr, substr(t, 4, length(t) - 4) AS value FROM r
    UNION ALL SELECT rule_text_id, 'header', 'header_font', CASE z % 3 WHEN 1 THEN '楷体' ELSE 'Arial' END FROM r WHERE z % 3 > 0
    UNION ALL SELECT rule_text_id, 'header', 'header_size_pt', z || CASE z % 3 WHEN 1 THEN '.0' ELSE '.5' END FROM r WHERE z % 3 > 0""")(
    lambda spark, d: M.rules_from_text(table(spark, d, "part").selectExpr("p_partkey AS rule_text_id", f"{_HEAD} AS text")).filter("slot = 'header'"))
query("H9_extract_rules_from_text", """WITH r AS (SELECT p_partkey AS rule_text_id, p_size AS z FROM part)
    SELECT rule_text_id, 'page' AS slot, 'margin_top_cm' AS attr, z || '.0' AS value FROM r UNION ALL SELECT rule_text_id, 'page', 'margin_left_cm', (z + 1) || '.0' FROM r
    UNION ALL SELECT rule_text_id, 'page', 'margin_right_cm', (z + 1) || '.0' FROM r UNION ALL SELECT rule_text_id, 'page', 'paper_size', 'A4' FROM r
    UNION ALL SELECT rule_text_id, 'title', a, v FROM r, (VALUES ('font_name_cn', '黑体'), ('font_size_pt', '22.0'), ('alignment', 'center')) t(a, v)
    UNION ALL SELECT rule_text_id, 'heading1', 'font_name_cn', '楷体' FROM r UNION ALL SELECT rule_text_id, 'heading1', 'font_size_pt', z || '.0' FROM r UNION ALL SELECT rule_text_id, 'heading1', 'bold', 'true' FROM r
    UNION ALL SELECT rule_text_id, 'body', a, v FROM r, (VALUES ('font_name_cn', '宋体'), ('font_name_en', 'Times New Roman'), ('font_size_pt', '12.0'), ('first_indent_chars', '2.0')) t(a, v)
    UNION ALL SELECT rule_text_id, 'body', 'line_spacing_type', 'multiple' FROM r UNION ALL SELECT rule_text_id, 'body', 'line_spacing_value', (z % 3 + 1) || '.0' FROM r
    UNION ALL SELECT rule_text_id, 'special', a, v FROM r, (VALUES ('money_unit', '万元'), ('number_format', '千位分隔符')) t(a, v) WHERE z % 2 = 0
    UNION ALL SELECT rule_text_id, 'xref', 'enabled', 'true' FROM r WHERE z % 2 = 1 UNION ALL SELECT rule_text_id, 'xref', 'figure_pattern', '图' || z FROM r WHERE z % 2 = 1""")(
    lambda spark, d: M.rules_from_text(table(spark, d, "part").selectExpr("p_partkey AS rule_text_id", f"{_TEXT} AS text")))
query("H10_detect_doc_type", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'academic' WHEN 1 THEN 'business' WHEN 2 THEN 'technical' WHEN 3 THEN 'official' ELSE 'general' END AS doc_type FROM part")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", X.detect_doc_type(F.expr("p_name || element_at(array('毕业论文报告', '商业方案', '技术说明通知', '公告', '信'), p_size % 5 + 1)")).alias("doc_type")))
query("H11_preset_rules", "WITH p(preset, slot, attr, value) AS (VALUES " + ", ".join(f"({', '.join(S.lit(x) for x in r)})" for r in R.PRESET_RULES) + """)
    SELECT p_partkey, slot, attr, value FROM part JOIN p ON preset = CASE p_size % 4 WHEN 0 THEN 'academic' WHEN 1 THEN 'business' WHEN 2 THEN 'technical' ELSE 'official' END""")(
    lambda spark, d: table(spark, d, "part").selectExpr("p_partkey", "element_at(array('academic', 'business', 'technical', 'official'), p_size % 4 + 1) AS preset").join(M.preset_rules(spark), "preset").drop("preset"))
query("H18_paper_size", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'A4' WHEN 1 THEN 'A3' ELSE printf('%.1fx%.1fcm', p_size + 50.0, p_size + 60.0) END AS paper FROM part""")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", X.paper_size(
        F.expr("CASE p_size % 3 WHEN 0 THEN 21.2D WHEN 1 THEN 42.1D ELSE p_size + 50.0D END"), F.expr("CASE p_size % 3 WHEN 0 THEN 29.5D WHEN 1 THEN 29.6D ELSE p_size + 60.0D END")).alias("paper")))
query("H21_ref_field_test", """SELECT p_partkey AS doc_id, p_name AS ref_text FROM part WHERE p_size % 4 = 0 AND p_partkey % 3 > 0""")(
    lambda spark, d: (lambda p: L.fielded_references(
        p.selectExpr("p_partkey AS doc_id", "element_at(array(' REF _b \\\\h', 'PAGEREF _b', 'ref', 'NOREF x'), p_size % 4 + 1) AS instruction", "p_name || ' ' AS display"),
        p.filter("p_partkey % 3 > 0").selectExpr("p_partkey AS doc_id", "'_b' AS bookmark")))(table(spark, d, "part")))
_MJ = "'{\"page\": {\"paper_size\": \"A4\", \"junk\": \"1\"}, \"heading1\": {\"font_size_pt\": ' || p_size || ', \"bold\": true, \"odd\": 1}, \"other\": {\"bold\": true}}'"
query("M8_rules_from_model_json", """SELECT p_partkey AS template_id, 'page' AS slot, 'paper_size' AS attr, 'A4' AS value FROM part UNION ALL SELECT p_partkey, 'heading1', 'font_size_pt', CAST(p_size AS VARCHAR) FROM part
    UNION ALL SELECT p_partkey, 'heading1', 'bold', 'true' FROM part""")(
    lambda spark, d: M.rules_from_model_json(table(spark, d, "part").selectExpr("p_partkey AS template_id", f"{_MJ} AS json")))
_AK = "array('# 规范', '## 1 主标题', '- 字体：`' || p_name || '`', '- 字号: 二号', '## 2 一级标题', '- 中文字体：黑体', '- 字号：' || p_size || 'pt', '- 行距：固定值 ' || p_size || ' 磅', '## 页边距', '- 上：' || p_size || ' cm', 'note')"


def _answers(spark, d):
    return M.answer_key(table(spark, d, "part").select(F.col("p_partkey").alias("template_id"), F.posexplode(F.expr(_AK)).alias("line_no", "line")))


_AK_SQL = """ak AS (SELECT p_partkey AS template_id, 'titleFont' AS key, p_name AS value FROM part UNION ALL SELECT p_partkey, 'titleSize', '22.0' FROM part UNION ALL SELECT p_partkey, 'h1Font', '黑体' FROM part
    UNION ALL SELECT p_partkey, 'h1Size', p_size || '.0' FROM part UNION ALL SELECT p_partkey, 'lineSpacingMode', 'exact' FROM part UNION ALL SELECT p_partkey, 'lineSpacingValue', p_size || '.0' FROM part
    UNION ALL SELECT p_partkey, 'marginTop', p_size || '.0' FROM part)"""
query("M10_rule_answer_check", f"WITH {_AK_SQL} SELECT template_id, key, value, CASE WHEN template_id % 5 > 0 THEN 'x' END AS parsed FROM ak WHERE key = 'h1Font'")(
    lambda spark, d: (lambda a: M.answer_mismatches(a, a.filter("key <> 'h1Font'").unionByName(a.filter("key = 'h1Font' AND template_id % 5 > 0").withColumn("value", F.lit("x")))))(_answers(spark, d)))
query("M10_answer_key", f"WITH {_AK_SQL} SELECT template_id, key, value FROM ak")(_answers)

# --- lint --------------------------------------------------------------------------------------

_DIAG = ("doc_id, element_index + 1 AS line, 3 AS col, CASE q % 4 WHEN 0 THEN substr(content, 2, 4) WHEN 1 THEN '2024年' WHEN 2 THEN '无此。文' ELSE 'Abc' END AS old, "
         "CASE q % 4 WHEN 0 THEN substr(content, 2, 3) || '，' WHEN 1 THEN '2024 年' WHEN 2 THEN '无此文.' ELSE 'abc' END AS new, CASE WHEN q % 3 = 0 THEN 'info' ELSE 'Error' END AS severity")
query("I28_lint", f"""WITH {ZH_SQL}, b AS (SELECT doc_id, min(element_index) AS bib FROM zh WHERE element_type = 'heading' AND content = '参考文献' GROUP BY 1),
    g AS (SELECT {_DIAG}, element_index, content, q FROM zh WHERE q % 4 <> 1), k AS (SELECT g.*, CASE WHEN q % 4 = 3 THEN '文案规范' WHEN q % 4 = 0 AND regexp_matches(new, '[a-zA-Z0-9]\\s+[一-鿿]|[一-鿿]\\s+[a-zA-Z0-9]') THEN '中英文空格规范' ELSE '标点规范' END AS kind FROM g LEFT JOIN b USING (doc_id)
      WHERE bib IS NULL OR element_index <= bib OR q % 4 = 3 OR (q % 4 = 0 AND regexp_matches(new, '[a-zA-Z0-9]\\s+[一-鿿]|[一-鿿]\\s+[a-zA-Z0-9]')))
    SELECT doc_id, element_index, CASE WHEN severity = 'info' THEN 'info' ELSE 'warning' END AS severity, '建议规范化（' || kind || '）："' || old || '"' AS title,
      CASE WHEN q % 4 = 0 AND old <> '' THEN old WHEN q % 4 = 2 AND contains(content, '。') THEN '。' ELSE old END AS location_text,
      CAST(CASE WHEN q % 4 = 0 AND old <> '' THEN strpos(content, old) - 1 WHEN q % 4 = 2 AND contains(content, '。') THEN strpos(content, '。') - 1 ELSE 2 END AS INT) AS start_pos FROM k""")(
    lambda spark, d: (lambda z: L.lint_issues(z.selectExpr(*[c.strip() for c in _split(_DIAG)]), z).select(
        "doc_id", "element_index", "severity", "title", "location_text", "start_pos"))(zh_elements(spark, d, "q")))

# --- increments --------------------------------------------------------------------------------

_HASH = """{name} AS (SELECT doc_id, CAST(floor(element_index / 20) AS INT) AS chunk_no, min(element_index) AS start_index, max(element_index) + 1 AS end_index,
    md5(string_agg({text}, '' ORDER BY element_index)) AS content_hash FROM {src} GROUP BY ALL)"""
_EDIT = "CASE WHEN element_index % 97 = 5 THEN content || '!' ELSE content END"
_INC = f"WITH {LATIN_SQL}, {_HASH.format(name='o', text='content', src='la')}, {_HASH.format(name='n', text=_EDIT, src='la WHERE NOT (doc_id % 7 = 0 AND element_index >= 40)')}"


def _versions(spark, d):
    old = latin_elements(spark, d)
    new = old.filter("NOT (doc_id % 7 = 0 AND element_index >= 40)").withColumn("content", F.expr(_EDIT))
    return old, new


query("D22_chunk_hash", f"{_INC} SELECT * FROM o")(lambda spark, d: C.chunk_hashes(latin_elements(spark, d), 20))
query("C16_chunk_diff", f"{_INC} SELECT doc_id, chunk_no, n.content_hash IS NULL AS removed, NOT coalesce(n.content_hash = o.content_hash, false) AS modified FROM n FULL JOIN o USING (doc_id, chunk_no)")(
    lambda spark, d: (lambda v: C.chunk_diff(C.chunk_hashes(v[1], 20), C.chunk_hashes(v[0], 20)).select("doc_id", "chunk_no", "removed", "modified"))(_versions(spark, d)))
query("C17_reuse_unchanged", f"""{_INC}, df AS (SELECT doc_id, chunk_no, NOT coalesce(n.content_hash = o.content_hash, false) AS modified FROM n JOIN o USING (doc_id, chunk_no))
    SELECT doc_id, element_index, {_EDIT} AS content, modified AS rechecked FROM la JOIN df ON df.doc_id = la.doc_id AND chunk_no = floor(element_index / 20)
    WHERE NOT (la.doc_id % 7 = 0 AND element_index >= 40)""".replace("SELECT doc_id, element_index, CASE", "SELECT la.doc_id AS doc_id, element_index, CASE"))(
    lambda spark, d: (lambda v: (lambda diff: C.reuse_issues(
        v[0].select("doc_id", "element_index", "content", F.lit(False).alias("rechecked")), C.changed_elements(v[1], diff, 20).select("doc_id", "element_index", "content", F.lit(True).alias("rechecked")), diff, 20))(
        C.chunk_diff(C.chunk_hashes(v[1], 20), C.chunk_hashes(v[0], 20))))(_versions(spark, d)))
