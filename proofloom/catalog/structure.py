"""Queries for document structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofloom.catalog import sqlgen as S
from proofloom.catalog.registry import query
from proofloom.catalog.views import ZH_SQL, zh_elements
from proofloom.operators import structure as T
from proofloom.rules import fixed as R

VIEW_SQL = f"""{ZH_SQL}, v AS (SELECT doc_id, element_index AS idx, trim(content) AS text, lower(style_name) AS style,
      CASE element_type WHEN 'heading' THEN 'h' || level WHEN 'paragraph' THEN 'p' WHEN 'list_item' THEN 'li' WHEN 'reference' THEN 'ref' WHEN 'caption' THEN 'caption' END AS hint,
      font_size_pt AS size, alignment AS align, first_indent_twips AS indent, bold FROM zh),
    bs AS (SELECT doc_id, size, sum(length(text)) AS w, min(idx) AS f FROM v WHERE hint IN ('p', 'li') AND length(text) >= 4 GROUP BY ALL),
    ba AS (SELECT doc_id, align, count(*) AS w, min(idx) AS f FROM v WHERE hint IN ('p', 'li') AND length(text) >= 4 GROUP BY ALL),
    bl AS (SELECT doc_id, coalesce(body_size, 0.0) AS body_size, coalesce(body_align, '') AS body_align FROM (SELECT DISTINCT doc_id FROM v)
      LEFT JOIN (SELECT doc_id, arg_max(size, w * 1000000 - f) AS body_size FROM bs GROUP BY 1) USING (doc_id)
      LEFT JOIN (SELECT doc_id, arg_max(align, w * 1000000 - f) AS body_align FROM ba GROUP BY 1) USING (doc_id))"""
query("D8_body_baseline", f"WITH {VIEW_SQL} SELECT doc_id, body_size, body_align, 8 AS boundary FROM bl")(
    lambda spark, d: T.baseline(T.views(zh_elements(spark, d))))

_HD = r"'(?i)^(目\s*录|contents?|table of contents)\s*$'"
_SEC = r"'(?i)^(摘\s*要|abstract|引\s*言|绪\s*论|结\s*论|参考文献|references?|bibliography|致\s*谢|附\s*录|关键词|keywords?)\s*$'"
_NUM = (r"(regexp_matches(text, '^第\s*[一二三四五六七八九十百零〇0-9]+\s*[章节篇部回卷]') OR regexp_matches(text, '^[0-9]+(?:\.[0-9]+){0,3}(?:[\.?])?\s*\S')"
        r" OR regexp_matches(text, '^[一二三四五六七八九十]+\s*[、．\.]\s*\S'))")


def _class(in_ref, after_cover):
    ref = "WHEN hint IN ('p', 'li', 'ref') THEN 'reference|0.9|in_reference_section'" if in_ref else ""
    near = "true" if after_cover else "idx <= 2"
    return f"""CASE WHEN text = '' THEN 'body|0.3|empty_text' WHEN toc_heading AND idx < 16 THEN 'heading|0.85|section_name:toc_heading' WHEN leader THEN 'toc|0.85|dotted_leader' {ref}
      WHEN ref_item THEN 'reference|0.8|ref_item_pattern' WHEN contains(style, 'caption') THEN 'caption|0.95|style:caption' WHEN caption_line THEN 'caption|0.85|caption_pattern'
      WHEN is_h AND section_name THEN 'heading|0.95|section_name' WHEN is_h THEN 'heading|0.9|style:' || hint
      WHEN idx < 8 AND align = 'center' AND size > 0 AND body_size > 0 AND size >= body_size * 1.3 AND indent <= 1 THEN 'cover|0.85|cover_first_page_centered_large'
      WHEN idx < 8 AND author AND length(text) <= 40 AND indent <= 1 AND {near} THEN 'cover|0.82|cover_author_line'
      WHEN idx < 3 AND align = 'center' AND length(text) <= 30 AND indent <= 1 THEN 'cover|0.7|cover_short_centered'
      WHEN section_name AND length(text) <= 12 THEN 'heading|0.85|section_name'
      WHEN numbered AND length(text) <= 60 AND ((size > 0 AND body_size > 0 AND size > body_size + 0.5) OR bold OR align = 'center') THEN 'heading|0.75|numbered_heading'
      WHEN numbered AND length(text) <= 60 AND size = 0 THEN 'heading|0.6|numbered_heading_no_size' ELSE 'body|0.5|default' END"""


ROLE_SQL = f"""WITH RECURSIVE {VIEW_SQL}, m AS (SELECT *, hint IN ('h1', 'h2', 'h3') AS is_h, regexp_matches(text, {_HD}) AS toc_heading,
      regexp_matches(text, '[\\.…·•]{{3,}}\\s*[0-9]+\\s*$') AS leader, regexp_matches(text, '(?i)(?:\\s+[-–—]?\\s*(?:[0-9]+|[ivxlcdm]+)\\s*[-–—]?\\s*)$') AS trail_pg,
      regexp_matches(text, {_SEC}) AS section_name, {_NUM} AS numbered, regexp_matches(text, '^\\[[0-9]+\\]') AS ref_item,
      regexp_matches(text, '^(图|表|Figure|Table)\\s*[0-9]') AS caption_line, regexp_matches(text, '(?i)^(作者，?|author)\\s*[:：]?\\s*\\S.{{0,30}}$') AS author,
      contains(text, '参考文献') OR lower(text) IN ('references', 'reference', 'bibliography') AS ref_heading FROM v JOIN bl USING (doc_id)),
    k AS (SELECT *, text <> '' AND (leader OR (length(text) <= 80 AND (trail_pg OR toc_heading OR section_name OR numbered))) AS toc_entry,
      text <> '' AND length(text) <= 40 AND NOT toc_heading AND NOT section_name AND NOT trail_pg AND indent <= 1 AND (align IN ('center', '') OR size >= body_size) AND idx < 24 AS goes_on,
      [{_class(False, False)}, {_class(False, True)}, {_class(True, False)}, {_class(True, True)}] AS cls FROM m),
    w AS (SELECT doc_id, -1 AS idx, '' AS res, false AS p, false AS c, false AS t, false AS r, '' AS text, '' AS hint FROM bl
      UNION ALL SELECT doc_id, idx, res, split_part(res, '|', 1) = 'cover', CASE WHEN text <> '' THEN split_part(res, '|', 1) = 'cover' ELSE c END,
        (split_part(res, '|', 1) = 'heading' AND toc_heading) OR (t AND (cover OR toc OR NOT leaves)),
        CASE WHEN split_part(res, '|', 1) = 'heading' THEN ref_heading ELSE r END, text, hint
      FROM (SELECT *, CASE WHEN cover THEN 'cover|0.78|cover_continuation' WHEN toc THEN 'toc|0.88|in_toc_section'
                      ELSE cls[1 + CASE WHEN r THEN 2 ELSE 0 END + CASE WHEN p THEN 1 ELSE 0 END] END AS res
        FROM (SELECT k.*, w.p, w.c, w.t, w.r, w.c AND k.goes_on AS cover, NOT (w.c AND k.goes_on) AND w.t AND k.text <> '' AND NOT k.is_h AND k.toc_entry AS toc,
                k.text <> '' AND ((k.is_h AND NOT k.toc_heading) OR NOT k.toc_entry) AS leaves
              FROM w JOIN k ON k.doc_id = w.doc_id AND k.idx = w.idx + 1))),
    ro AS (SELECT doc_id, idx AS element_index, text, hint, split_part(res, '|', 1) AS role, CAST(split_part(res, '|', 2) AS DOUBLE) AS confidence, split_part(res, '|', 3) AS reason FROM w WHERE idx >= 0),
    rl AS (SELECT *, CASE WHEN role = 'heading' THEN CASE WHEN hint = 'h1' THEN 1 WHEN hint = 'h2' THEN 2 WHEN hint = 'h3' THEN 3
      WHEN regexp_matches(text, '(?i)^(摘\\s*要|abstract|引\\s*言|绪\\s*论|前\\s*言|结\\s*论|参考文献|references?|bibliography|目\\s*录|contents?)\\s*$')
        OR regexp_matches(text, '^第\\s*[一二三四五六七八九十百零〇0-9]+\\s*[章节篇部回卷]') OR regexp_matches(text, '^[一二三四五六七八九十]+\\s*[、．\\.]\\s*\\S') THEN 1
      WHEN regexp_matches(text, '^([0-9]+(?:\\.[0-9]+){{0,3}})[\\.、]?\\s*\\S') THEN length(regexp_extract(text, '^([0-9]+(?:\\.[0-9]+){{0,3}})[\\.、]?\\s*\\S', 1))
        - length(replace(regexp_extract(text, '^([0-9]+(?:\\.[0-9]+){{0,3}})[\\.、]?\\s*\\S', 1), '.', '')) + 2 END END AS heading_level FROM ro),
    rs AS (SELECT *, CASE WHEN role = 'toc' THEN 'toc_entry' WHEN role = 'reference' THEN 'reference_item' WHEN role IN ('caption', 'cover') THEN role
      WHEN lower(text) IN ('目录', 'contents') THEN 'toc_heading' WHEN text = '摘要' THEN 'abstract_heading_zh' WHEN lower(text) = 'abstract' THEN 'abstract_heading_en'
      WHEN lower(text) IN ('参考文献', 'references', 'reference', 'bibliography') THEN 'references_heading' WHEN regexp_matches(text, '(?i)^(关键词|keywords?)\\s*[:：]') THEN 'keywords'
      WHEN role = 'heading' THEN coalesce('heading_' || heading_level, 'heading') END AS section_kind,
      role IN ('cover', 'toc', 'reference', 'caption', 'table') AND confidence >= 0.6 AS xf, role IN ('cover', 'toc') AND confidence >= 0.7 AS xt FROM rl)"""

query("E12_structure_classify", f"{ROLE_SQL} SELECT doc_id, element_index, role, confidence, reason FROM rs")(
    lambda spark, d: T.classify(zh_elements(spark, d)).select("doc_id", "element_index", "role", "confidence", "reason"))
query("E13_heading_level", f"{ROLE_SQL} SELECT doc_id, element_index, heading_level FROM rs WHERE role = 'heading'")(
    lambda spark, d: T.classify(zh_elements(spark, d)).filter("role = 'heading'").select("doc_id", "element_index", "heading_level"))
query("E14_section_kind", f"{ROLE_SQL} SELECT doc_id, element_index, section_kind FROM rs WHERE section_kind IS NOT NULL")(
    lambda spark, d: T.classify(zh_elements(spark, d)).filter("section_kind IS NOT NULL").select("doc_id", "element_index", "section_kind"))
query("E15_exclusion_flags", f"{ROLE_SQL} SELECT doc_id, element_index, xf AS exclude_from_format_body, xt AS exclude_from_xref_targets FROM rs WHERE xf OR xt")(
    lambda spark, d: T.classify(zh_elements(spark, d)).filter("exclude_from_format_body OR exclude_from_xref_targets").select(
        "doc_id", "element_index", "exclude_from_format_body", "exclude_from_xref_targets"))
query("D26_structure_profile", f"{ROLE_SQL} SELECT role, section_kind, xf AS exclude_from_format_body, xt AS exclude_from_xref_targets, count(*) AS n FROM rs GROUP BY ALL")(
    lambda spark, d: T.profile(T.classify(zh_elements(spark, d))))

_RUNS = ("array(named_struct('text', substr(content, 1, 3), 'font_name', 'Arial', 'font_eastAsia', font.font_name_cn, 'font_size_pt', font.font_size_pt, 'bold', q % 2 = 0), "
         "named_struct('text', substr(content, 4, 100), 'font_name', '楷体', 'font_eastAsia', '', 'font_size_pt', 9.0D, 'bold', q % 3 = 0), "
         "named_struct('text', ' ', 'font_name', 'Skip', 'font_eastAsia', '', 'font_size_pt', 90.0D, 'bold', true))")
query("D9_dominant_font", f"""WITH {ZH_SQL}, r AS (SELECT *, length(trim(substr(content, 1, 3))) AS a, length(trim(substr(content, 4, 100))) AS b,
      CASE WHEN font_name_cn = '' THEN 'Arial' ELSE font_name_cn END AS fa FROM zh)
    SELECT doc_id, element_index, CASE WHEN b > a THEN '楷体' ELSE fa END AS font, CASE WHEN b > a THEN 9.0 ELSE font_size_pt END AS size,
      (CASE WHEN q % 2 = 0 THEN a ELSE 0 END + CASE WHEN q % 3 = 0 THEN b ELSE 0 END) * 1.0 / (a + b) >= 0.6 AS bold FROM r""")(
    lambda spark, d: zh_elements(spark, d, "q").select("doc_id", "element_index", T.dominant_run_style(F.expr(_RUNS)).alias("s")).select(
        "doc_id", "element_index", "s.font", "s.size", "s.bold"))
