"""Queries for sources, segmentation, stores (A*) and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofloom.catalog import sqlgen as S
from proofloom.catalog.registry import query
from proofloom.catalog.views import LATIN_SQL, ZH_SQL, latin_elements, table, usage_sql, usage_view, zh_elements
from proofloom.operators import elements as E
from proofloom.operators import plans as P
from proofloom.sources import ingest as G

# --- structured JSON: each document's lines as front-end elements, built in the row ---------

_TYPES = "element_at(array('h1', 'h2', 'h3', 'p', 'li', 'caption', 'REF'), CAST(i % 7 + 1 AS INT))"


def _json_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(
        f"to_json(transform(split(text, '\\n', -1), (x, i) -> struct({_TYPES} AS type, x AS text, map('n', CAST(i AS STRING)) AS metadata)))"
    ).alias("elements_json"))


def _json_sql(kind, level):
    return f"""WITH {LATIN_SQL}, k AS (SELECT *, element_index % 7 AS i, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS t FROM la)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY element_index) - 1 AS INT) AS element_index,
        {kind} AS element_type, {level} AS level, t AS content, CAST(element_index AS VARCHAR) AS n FROM k WHERE t <> ''"""


_LEVEL = "CASE WHEN i < 3 THEN i + 1 ELSE 0 END"
_JSON_COLS = ["doc_id", "element_index", "element_type", "level", "content"]
query("A1_ingest_elements_json", _json_sql("CASE WHEN i < 3 THEN 'heading' ELSE 'paragraph' END", _LEVEL))(
    lambda spark, d: G.elements_from_json(_json_docs(spark, d)).select(*_JSON_COLS, F.col("metadata")["n"].alias("n")))
query("A2_ingest_elements_xref", _json_sql(
    "CASE WHEN i < 3 THEN 'heading' WHEN i = 5 THEN 'caption' WHEN i = 6 THEN 'reference' ELSE 'paragraph' END", _LEVEL))(
    lambda spark, d: G.elements_from_json(_json_docs(spark, d), for_xref=True).select(*_JSON_COLS, F.col("metadata")["n"].alias("n")))

# --- plain text ------------------------------------------------------------------------------

_KIND = """CASE WHEN regexp_matches(t, '^[一二三四五六七八九十]+、') THEN 'heading1' WHEN regexp_matches(t, '^（[一二三四五六七八九十]+）') THEN 'heading2'
  WHEN regexp_matches(t, '^[0-9]+\\.\\s') AND length(t) < 50 THEN 'heading3' WHEN regexp_matches(t, '^（[0-9]+）') THEN 'heading4'
  WHEN regexp_matches(t, '^第[一二三四五六七八九十0-9]+[章节篇部]') THEN 'heading1'
  WHEN starts_with(t, '#') THEN 'heading' || least(length(regexp_extract(t, '^#+')), 6)
  WHEN regexp_matches(t, '^\\[[0-9,\\-–]+\\]') THEN 'reference0'
  WHEN length(t) < 30 AND NOT regexp_matches(t, '[，。！？；：、]') THEN 'heading0' ELSE 'paragraph0' END"""
_TRIM = "regexp_replace(content, '^\\s+|\\s+$', '', 'g')"
query("A3_segment_txt", f"""WITH {LATIN_SQL}, k AS (SELECT doc_id, element_index, {_TRIM} AS t FROM la)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY element_index) - 1 AS INT) AS element_index,
      regexp_replace({_KIND}, '[0-9]$', '') AS element_type, CAST(right({_KIND}, 1) AS INT) AS level, t AS content
    FROM k WHERE t <> ''""")(lambda spark, d: G.segment_txt(table(spark, d, "documents")))
query("A3_txt_line_types_zh", f"""WITH {ZH_SQL}, k AS (SELECT doc_id, element_index, content AS t FROM zh)
    SELECT doc_id, element_index, regexp_replace({_KIND}, '[0-9]$', '') AS element_type, CAST(right({_KIND}, 1) AS INT) AS level FROM k""")(
    lambda spark, d: zh_elements(spark, d).select("doc_id", "element_index", G.txt_line_type(F.col("content")).alias("k")).select(
        "doc_id", "element_index", "k.element_type", "k.level"))
_PLAIN = "CASE WHEN t = '' THEN '' WHEN {i} % 8 = 0 THEN '# ' || t WHEN {i} % 8 = 1 THEN '## ' || t WHEN {i} % 8 = 2 THEN '#### ' || t WHEN {i} % 8 = 3 THEN '- ' || t WHEN {i} % 8 = 4 THEN '12. ' || t WHEN {i} % 8 = 5 THEN '[3]' || t WHEN {i} % 8 = 6 THEN 'Table 4 ' || t ELSE t END"
query("A4_segment_plain_lines", f"""WITH {LATIN_SQL}, k AS (SELECT doc_id, element_index AS i, {_TRIM} AS t FROM la)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS element_index,
      CASE i % 8 WHEN 0 THEN 'h1' WHEN 1 THEN 'h2' WHEN 2 THEN 'h3' WHEN 3 THEN 'li' WHEN 4 THEN 'li' WHEN 5 THEN 'ref' WHEN 6 THEN 'caption'
        ELSE CASE WHEN starts_with(t, '- ') OR starts_with(t, '* ') OR regexp_matches(t, '^[0-9]+\\.\\s') THEN 'li' ELSE 'p' END END AS type,
      CASE i % 8 WHEN 3 THEN '• ' || t WHEN 4 THEN '12. ' || t WHEN 5 THEN '[3]' || t WHEN 6 THEN 'Table 4 ' || t
        ELSE CASE WHEN i % 8 = 7 AND regexp_matches(t, '^[-*]\\s') THEN '• ' || regexp_replace(t, '^[-*]\\s+', '') ELSE t END END AS text
    FROM k WHERE t <> ''""")(
    lambda spark, d: G.segment_plain_lines(table(spark, d, "documents").select("doc_id", F.expr(
        "array_join(transform(transform(split(text, '\\n', -1), x -> regexp_replace(x, '(?U)^\\\\s+|\\\\s+\\\\z', '')), (t, i) -> "
        + _PLAIN.format(i="i") + "), '\\n')").alias("text"))))

# --- Markdown: marks put before the lines of every document ----------------------------------

_MD = ("CASE i % 13 WHEN 0 THEN '# ' || t WHEN 2 THEN '```sql' WHEN 4 THEN '```' WHEN 5 THEN '- **' || t || '**' WHEN 6 THEN '2. ' || t "
       "WHEN 7 THEN '' WHEN 8 THEN '| a | `b` |' WHEN 9 THEN '|---|---|' WHEN 10 THEN '| ' || length(t) || ' | ' || i || ' |' WHEN 11 THEN '> ' || t ELSE t END")


def _md_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(
        f"array_join(transform(transform(split(text, '\\n', -1), x -> replace(trim(x), '|', '/')), (t, i) -> {_MD}), '\\n')").alias("text"))


def _clean_sql(x):
    for pattern in (r"\*\*\*(.+?)\*\*\*", r"\*\*(.+?)\*\*", r"\*(.+?)\*", r"__(.+?)__", r"_(.+?)_", r"`(.+?)`", r"\[([^\]]+)\]\([^)]+\)", r"!\[([^\]]*)\]\([^)]+\)"):
        x = f"regexp_replace({x}, '{pattern}', '\\1', 'g')"
    return _trim_sql(x)


def _trim_sql(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


#: The automaton of the lines as one letter per line, upper case where a block begins; then blocks, elements and items.
A5_SQL = f"""WITH {LATIN_SQL}, m AS (SELECT doc_id, element_index AS i, {_MD.replace("CASE i % 13", "CASE element_index % 13").replace("|| i ||", "|| element_index ||")} AS line FROM (SELECT *, replace(trim(content), '|', '/') AS t FROM la)),
    b AS (SELECT *, {_trim_sql("line")} AS bare, coalesce(regexp_matches({_trim_sql("lead(line) OVER (PARTITION BY doc_id ORDER BY i)")}, '^\\|[\\s\\-:|]+\\|$'), false) AS rule,
      regexp_matches(line, '^\\s*([0-9]+\\.\\s|[-*+]\\s)') AS item, regexp_matches(line, '^\\s*[0-9]+\\.\\s') AS ordered FROM m),
    f AS (SELECT *, CASE WHEN starts_with(line, '#') THEN 'h' WHEN starts_with(bare, '```') THEN 'c' WHEN contains(line, '|') AND rule THEN 't' WHEN item THEN 'l'
        WHEN regexp_matches(bare, '^!\\[[^\\]]*\\]\\([^)]+\\)') THEN 'i' WHEN starts_with(line, '>') THEN 'q' WHEN regexp_matches(bare, '^(-{{3,}}|\\*{{3,}}|_{{3,}})\\s*$') THEN 'r' ELSE 'p' END
      || CAST(starts_with(bare, '```') AS INT) || CAST(contains(line, '|') AS INT) || CAST(bare = '' AS INT) || CAST(item AS INT)
      || CAST(NOT (starts_with(line, '#') OR ordered OR (regexp_matches(bare, '^(```|\\||>|- |\\* |\\+ )') AND NOT regexp_matches(line, '^\\s*[-*+]\\s'))) AS INT) AS x FROM b),
    w AS (SELECT doc_id, list_reduce(list_concat(['-'], list(x ORDER BY i)), lambda acc, x: acc || CASE
        WHEN lower(right(acc, 1)) = 'c' THEN CASE WHEN x[2] = '1' THEN 'f' ELSE 'c' END WHEN lower(right(acc, 1)) = 't' AND x[3] = '1' THEN 't' WHEN x[4] = '1' THEN 'B'
        WHEN lower(right(acc, 1)) = 'l' AND x[5] = '1' THEN 'l' WHEN lower(right(acc, 1)) = 'p' AND x[6] = '1' THEN 'p' ELSE upper(x[1]) END) AS s FROM f GROUP BY 1),
    l AS (SELECT doc_id, i, line, bare, item, ordered, substr(s, i + 2, 1) AS k FROM b JOIN w USING (doc_id)),
    n AS (SELECT *, CAST(sum(CASE WHEN k = upper(k) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS block FROM l),
    g AS (SELECT doc_id, block, lower(first(k ORDER BY i)) AS k, first(line ORDER BY i) AS head, first(bare ORDER BY i) AS bare, min(i) AS i0, string_agg(bare, chr(10) ORDER BY i) AS paragraph,
      coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k = 'c'), '') AS code FROM n GROUP BY ALL),
    e AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS INT) AS ix FROM g WHERE k IN ('h', 'l', 'q', 'p') OR (k = 'c' AND {_trim_sql("code")} <> ''))
    SELECT doc_id, ix AS element_index, CAST(NULL AS INT) AS parent_index, CAST(NULL AS INT) AS child_index,
      CASE k WHEN 'h' THEN 'heading' WHEN 'c' THEN 'code_block' WHEN 'l' THEN 'list' ELSE 'paragraph' END AS element_type,
      CAST(CASE WHEN k = 'h' THEN length(regexp_extract(head, '^(#{{1,6}})\\s+.+$', 1)) ELSE 0 END AS INT) AS level,
      CASE k WHEN 'h' THEN CASE WHEN regexp_matches(head, '^#{{1,6}}\\s+.+$') THEN {_clean_sql("regexp_replace(head, '^#{1,6}\\s+', '')")} ELSE bare END
        WHEN 'c' THEN code WHEN 'l' THEN '' WHEN 'q' THEN {_trim_sql("regexp_replace(head, '^>\\s*', '')")} ELSE {_clean_sql("paragraph")} END AS content,
      CASE WHEN k = 'l' THEN CASE WHEN regexp_matches(head, '^\\s*[0-9]+\\.\\s') THEN 'decimal' ELSE 'bullet' END END AS numbering_type,
      CASE WHEN k = 'c' THEN {_trim_sql("substr(bare, 4)")} END AS language, k = 'q' AS blockquote FROM e
    UNION ALL SELECT n.doc_id, NULL, ix, CAST(i - i0 AS INT), 'list_item', 0, {_clean_sql("regexp_replace(line, '^\\s*([0-9]+\\.\\s|[-*+]\\s)', '')")}, NULL, NULL, false
    FROM n JOIN e USING (doc_id, block) WHERE e.k = 'l'"""
query("A5_segment_markdown", A5_SQL)(lambda spark, d: G.markdown_elements(_md_docs(spark, d)))
query("A6_segment_md_table", f"""WITH {LATIN_SQL}, k AS (SELECT doc_id, element_index AS i, trim(content) AS t,
      max(element_index) OVER (PARTITION BY doc_id) AS last FROM la),
    h AS (SELECT doc_id, i FROM k WHERE i % 13 = 8 AND last > i)
    SELECT doc_id, CAST(i AS INT) AS line_no, 0 AS col, true AS is_header, 'a' AS content FROM h
    UNION ALL SELECT doc_id, CAST(i AS INT), 1, true, 'b' FROM h
    UNION ALL SELECT k.doc_id, CAST(k.i AS INT), 0, false, CAST(length(t) AS VARCHAR) FROM k WHERE i % 13 = 10
    UNION ALL SELECT k.doc_id, CAST(k.i AS INT), 1, false, CAST(i AS VARCHAR) FROM k WHERE i % 13 = 10""")(
    lambda spark, d: G.markdown_cells(_md_docs(spark, d)).select("doc_id", "line_no", "col", "is_header", "content"))
_WRAP = ("CASE element_index % 5 WHEN 0 THEN '**' || content || '**' WHEN 1 THEN '`' || content || '` and *it*' WHEN 2 THEN '[' || content || '](u)' "
         "WHEN 3 THEN '__' || content || '__ ***b***' ELSE content END")
_CLEAN = "t"
for _p in (r"\*\*\*(.+?)\*\*\*", r"\*\*(.+?)\*\*", r"\*(.+?)\*", r"__(.+?)__", r"_(.+?)_", r"`(.+?)`", r"\[([^\]]+)\]\([^)]+\)", r"!\[([^\]]*)\]\([^)]+\)"):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '\\1', 'g')"
query("A7_clean_markdown", f"""WITH {LATIN_SQL}, w AS (SELECT doc_id, element_index, {_WRAP} AS t FROM la)
    SELECT doc_id, element_index, regexp_replace({_CLEAN}, '^\\s+|\\s+$', '', 'g') AS content FROM w""")(
    lambda spark, d: latin_elements(spark, d).select("doc_id", "element_index", G.clean_markdown(F.expr(_WRAP)).alias("content")))

# --- HTML ------------------------------------------------------------------------------------

_H, _P = r"<h([1-6])[^>]*>(.*?)</h[1-6]>", r"<(?:p|li)[^>]*>(.*?)</(?:p|li)>"
_UN = "replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_TAGS = "regexp_replace({x}, '<[^>]+>', '', 'g')"
_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _html_sql(bare):
    pat = f"(?is){_H}|{_P}" + (r"|[^\n<]+" if bare else "")
    cap = "WHEN regexp_matches(t, '^(图|表)\\s*[0-9]+') THEN 'caption'" if bare else ""
    inner = lambda rx, g: _STRIP.format(x=_UN.format(x=_TAGS.format(x=f"regexp_extract(h, '(?is)^{rx}$', {g})")))
    return f"""WITH a AS (SELECT page_id AS doc_id, regexp_extract_all(html, '{pat}') AS m FROM pages),
      b AS (SELECT doc_id, unnest(range(len(m))) AS i, unnest(m) AS h FROM a),
      c AS (SELECT *, regexp_matches(h, '(?is)^{_H}$') AS hd FROM b),
      e AS (SELECT *, CASE WHEN hd THEN {inner(_H, 2)} WHEN starts_with(h, '<') THEN {inner(_P, 1)} ELSE {_STRIP.format(x="h")} END AS t FROM c)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS element_index,
        CASE WHEN hd THEN 'heading' {cap} WHEN regexp_matches(t, '^\\[[0-9]+\\]') THEN 'reference' ELSE 'paragraph' END AS element_type,
        CASE WHEN hd THEN CAST(regexp_extract(h, '(?is)^{_H}$', 1) AS INT) ELSE 0 END AS level, t AS content
      FROM e WHERE t <> ''"""


def _pages(spark, d):
    return table(spark, d, "pages").withColumnRenamed("page_id", "doc_id")


query("A8_segment_html_qa", _html_sql(True))(lambda spark, d: G.segment_html(_pages(spark, d)))
query("A9_segment_html_xref", _html_sql(False))(lambda spark, d: G.segment_html(_pages(spark, d), bare_text=False))
query("A10_segment_html_export", f"""WITH a AS (SELECT page_id AS doc_id, regexp_replace(html, '<br\\s*/?>', chr(10), 'g') AS html FROM pages),
    b AS (SELECT doc_id, regexp_extract_all(html, '(?is)<h1[^>]*>.*?</h1>|<h2[^>]*>.*?</h2>|<h3[^>]*>.*?</h3>|<h4[^>]*>.*?</h4>|<h5[^>]*>.*?</h5>|<h6[^>]*>.*?</h6>|<p[^>]*>.*?</p>|<div[^>]*>.*?</div>|<caption[^>]*>.*?</caption>|<li[^>]*>.*?</li>|<table>.*?</table>') AS m FROM a),
    c AS (SELECT doc_id, unnest(range(len(m))) AS i, unnest(m) AS h FROM b),
    e AS (SELECT *, regexp_extract(h, '(?is)^<(h[1-6]|p|div|caption|li)', 1) AS tag, regexp_matches(h, '(?is)^<table>.*</table>$') AS tb FROM c),
    f AS (SELECT *, CASE WHEN tb THEN h ELSE {_STRIP.format(x=_TAGS.format(x="regexp_extract(h, '(?is)^<[^>]*>(.*)</[a-z0-9]+>$', 1)"))} END AS text FROM e)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS element_index,
      CASE WHEN tb THEN 'table' WHEN tag IN ('h1', 'h2', 'h3', 'caption', 'li') THEN tag WHEN tag IN ('h4', 'h5', 'h6') THEN 'h3' ELSE 'p' END AS type, text
    FROM f WHERE text <> ''""")(lambda spark, d: G.segment_html_export(_pages(spark, d)))

_CSS = "html"
for _t, _n, _z in (("h1", "16", ""), ("h2", "14", ""), ("h3", "12", ""), ("p", "10.5", "")):
    _CSS = f"regexp_replace({_CSS}, '(?i)<{_t}([^>]*)>', '<{_t}\\1 style=\"font-family: 宋体; font-size: {_n}pt; line-height: 1.5\">', 'g')"
query("H13_inject_css", f"SELECT page_id, md5({_CSS}) AS styled_md5, length({_CSS}) AS styled_length FROM pages")(
    lambda spark, d: table(spark, d, "pages").select("page_id", G.inject_css(F.col("html")).alias("h")).select(
        "page_id", F.md5(F.col("h").cast("binary")).alias("styled_md5"), F.length("h").alias("styled_length")))

# --- extracted pages and cells ---------------------------------------------------------------

_LIKELY = """(length(t) <= 50 AND (regexp_matches(t, '^[一二三四五六七八九十]+、') OR regexp_matches(t, '^第[一二三四五六七八九十0-9]+[章节篇部]')
   OR (regexp_matches(t, '^[0-9]+(\\.[0-9]+)*\\s') AND length(t) < 40) OR (length(t) < 25 AND NOT regexp_matches(t, '[，。！？；：]'))))"""
_PTYPE = """CASE WHEN regexp_matches(content, '^第[一二三四五六七八九十0-9]+[章节篇部]') THEN 'heading1' WHEN regexp_matches(content, '^[0-9]+\\.\\s') AND length(content) < 50 THEN 'heading3'
   WHEN regexp_matches(content, '^\\[[0-9,\\-–]+\\]') THEN 'reference0' WHEN regexp_matches(content, '^(图|表|Figure|Table)\\s*[0-9\\-–]') THEN 'caption0' ELSE 'paragraph0' END"""


def _page_sql(with_sql, source):
    return f"""WITH {with_sql}, l AS (SELECT doc_id, CAST(floor(element_index / 40) AS BIGINT) AS page, element_index AS line, {_TRIM} AS t FROM {source}),
      c AS (SELECT *, t <> '' AND {_LIKELY} AS alone FROM l),
      g AS (SELECT *, sum(CASE WHEN alone OR t = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY line) AS cuts FROM c),
      p AS (SELECT doc_id, page, min(line) AS first_line, string_agg(t, ' ' ORDER BY line) AS content FROM g WHERE t <> '' GROUP BY doc_id, page, cuts, alone)
      SELECT doc_id, page, first_line, regexp_replace({_PTYPE}, '[0-9]$', '') AS element_type, CAST(right({_PTYPE}, 1) AS INT) AS level, content FROM p"""


def _page_lines(elements):
    return elements.select("doc_id", F.floor(F.col("element_index") / F.lit(40)).alias("page"),
                           F.col("element_index").alias("line"), F.col("content").alias("text"))


query("A11_merge_page_lines", _page_sql(LATIN_SQL, "la"))(lambda spark, d: G.merge_page_lines(_page_lines(latin_elements(spark, d))))
query("A11_merge_page_lines_zh", _page_sql(ZH_SQL, "zh"))(lambda spark, d: G.merge_page_lines(_page_lines(zh_elements(spark, d))))

_CELLS = ("CAST(floor(p_partkey / 10) AS BIGINT) AS doc_id, 1 AS table_index, CAST(p_partkey % 10 AS INT) AS row",
          ["CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_name END", "CASE WHEN p_size % 4 = 0 THEN ' ' ELSE p_brand END", "CASE WHEN p_size % 8 = 0 THEN '' ELSE CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_type END END"])
query("A12_tabular_to_table", f"""WITH c AS ({" UNION ALL ".join(f"SELECT {_CELLS[0]}, {i} AS col, {c} AS content FROM part" for i, c in enumerate(_CELLS[1]))}),
    r AS (SELECT doc_id, table_index, row, count(*) AS n FROM c GROUP BY ALL HAVING bool_or(trim(coalesce(content, '')) <> ''))
    SELECT doc_id, table_index, count(*) AS num_rows, max(n) AS num_cols, min(row) AS header_row, '表' || doc_id || '-' || table_index AS caption FROM r GROUP BY ALL""")(
    lambda spark, d: G.tables_from_cells(table(spark, d, "part").selectExpr(
        "CAST(floor(p_partkey / 10) AS BIGINT) AS doc_id", "1 AS table_index", "CAST(p_partkey % 10 AS INT) AS row",
        f"stack(3, {', '.join(f'{i}, {c}' for i, c in enumerate(_CELLS[1]))}) AS (col, content)")))

def _cells(spark, d):
    return table(spark, d, "part").selectExpr(
        "CAST(floor(p_partkey / 10) AS BIGINT) AS doc_id", "1 AS table_index", "CAST(p_partkey % 10 AS INT) AS row",
        f"stack(3, {', '.join(f'{i}, {c}' for i, c in enumerate(_CELLS[1]))}) AS (col, content)")


query("A12_table_rows", f"""WITH c AS ({" UNION ALL ".join(f"SELECT {_CELLS[0]}, {i} AS col, {c} AS content FROM part" for i, c in enumerate(_CELLS[1]))}),
    r AS (SELECT doc_id, table_index, row FROM c GROUP BY ALL HAVING bool_or(trim(coalesce(content, '')) <> ''))
    SELECT doc_id, table_index, row, col, trim(coalesce(content, '')) AS content, row = 1 AS is_header FROM c JOIN r USING (doc_id, table_index, row)""")(
    lambda spark, d: G.rows_from_cells(_cells(spark, d)))
query("A13_decode_bytes", f"WITH {ZH_SQL} SELECT doc_id, element_index, content AS text FROM zh")(
    lambda spark, d: zh_elements(spark, d).select("doc_id", "element_index", G.decode_bytes(F.when(
        (F.col("element_index") % 3 == 0) & (F.length("content") >= 8), F.encode("content", "GBK")).when((F.col("element_index") % 3 == 1) & (F.length("content") >= 8), F.encode("content", "GB18030")).otherwise(
        F.encode("content", "UTF-8"))).alias("text")))

_FILE = {"path": "'in/' || source || '/' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.docx' WHEN 1 THEN '.MD' WHEN 2 THEN '.txt' WHEN 3 THEN '.exe' WHEN 4 THEN '.tar.pdf' ELSE '' END",
         "length": "CAST(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE n_chars * 20000 END AS BIGINT)"}
_FILE_SQL = f"f AS (SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in _FILE.items())} FROM documents)"


def _files(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", *[f"{e} AS {n}" for n, e in _FILE.items()])


query("A14_route_by_format", f"""WITH {_FILE_SQL}, x AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS extension FROM f)
    SELECT doc_id, extension, CASE extension WHEN '.docx' THEN 'docx' WHEN '.md' THEN 'md' WHEN '.txt' THEN 'txt' WHEN '.pdf' THEN 'pdf' END AS format,
      CASE WHEN extension NOT IN ('.docx', '.md', '.txt', '.pdf') THEN 'UNSUPPORTED_FORMAT' WHEN length > 104857600 THEN 'FILE_TOO_LARGE' WHEN length = 0 THEN 'EMPTY_RESULT' END AS reject_code FROM x""")(
    lambda spark, d: G.route_files(_files(spark, d)).select("doc_id", "extension", "format", "reject_code"))
_OWNER = "1 + doc_id % 150"
query("A14_route_by_plan", f"""WITH {_FILE_SQL}, {usage_sql("profiles")}, x AS (SELECT *, {_OWNER} AS user_id, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS extension FROM f),
    p AS (SELECT id AS user_id, CASE lower(trim(plan_tier)) WHEN 'pro' THEN 30 WHEN 'team' THEN 100 WHEN 'enterprise' THEN NULL ELSE 5 END AS mb FROM profiles)
    SELECT doc_id, user_id, CASE WHEN extension NOT IN ('.docx', '.md', '.txt', '.pdf') THEN 'UNSUPPORTED_FORMAT' WHEN length > 104857600 THEN 'FILE_TOO_LARGE'
      WHEN length > mb * 1048576 THEN 'FILE_TOO_LARGE_FOR_PLAN' WHEN length = 0 THEN 'EMPTY_RESULT' END AS reject_code FROM x LEFT JOIN p USING (user_id)""")(
    lambda spark, d: G.route_for_plan(_files(spark, d).withColumn("user_id", F.expr(_OWNER)), usage_view(spark, d, "profiles").select(
        F.col("id").alias("user_id"), P.normalize_tier(F.col("plan_tier")).alias("tier")).withColumn("file_size_mb", P.file_size_limit(F.col("tier")))).select("doc_id", "user_id", "reject_code"))
query("D25_storage_size", f"WITH {_FILE_SQL} SELECT regexp_extract(path, '^([^/]+/[^/]+/)', 1) AS area, CAST(sum(length) AS BIGINT) AS bytes, count(*) AS files FROM f GROUP BY 1")(
    lambda spark, d: G.area_sizes(_files(spark, d), depth=2))

# --- selections ------------------------------------------------------------------------------

query("B1_elements_by_type", f"""WITH {ZH_SQL} SELECT doc_id, element_index, element_type, level FROM zh
    WHERE (element_type = 'heading' AND level <= 1) OR element_type IN ('reference', 'caption')""")(
    lambda spark, d: (lambda z: E.headings(z, 1).unionByName(E.of_type(z, "reference", "caption")).select(
        "doc_id", "element_index", "element_type", "level"))(zh_elements(spark, d)))
_PARENT = "CASE WHEN element_index % 4 = 0 THEN NULL WHEN element_index % 4 = 3 THEN element_index - 1 ELSE element_index - element_index % 4 END"
query("B2_flatten_children", f"""WITH RECURSIVE {ZH_SQL}, t AS (SELECT doc_id, element_index, content, {_PARENT} AS parent_index FROM zh),
    w AS (SELECT doc_id, element_index AS root_index, element_index FROM t
          UNION ALL SELECT t.doc_id, w.root_index, t.element_index FROM w JOIN t ON t.doc_id = w.doc_id AND t.parent_index = w.element_index)
    SELECT doc_id, root_index, string_agg(content, chr(10) ORDER BY element_index) AS text FROM w JOIN t USING (doc_id, element_index) GROUP BY ALL""")(
    lambda spark, d: E.flat_text(zh_elements(spark, d).withColumn("parent_index", F.expr(_PARENT))))
query("B3_document_text", f"WITH {ZH_SQL} SELECT doc_id, string_agg(content, chr(10) ORDER BY element_index) AS text FROM zh WHERE content <> '' GROUP BY 1")(
    lambda spark, d: E.document_text(zh_elements(spark, d)))
query("D11_element_counts", f"WITH {ZH_SQL} SELECT doc_id, element_type, count(*) AS n FROM zh GROUP BY ALL")(
    lambda spark, d: E.element_counts(zh_elements(spark, d)))

# --- stores ----------------------------------------------------------------------------------


def _documents(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("author"),
        F.concat("source", F.lit(".txt")).alias("source_file"), F.lit("txt").alias("source_format"),
        F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(
            F.lit("paragraph").alias("element_type"), x.alias("content"), i.cast("int").alias("level"))).alias("elements"))


query("A19_document_json_roundtrip", """SELECT doc_id, 't' || doc_id AS title, source AS author, len(string_split(text, chr(10))) AS n_elements,
    md5(text) AS text_md5, len(string_split(text, chr(10))) - 1 AS last_level FROM documents""")(
    lambda spark, d: E.from_json(E.to_json(_documents(spark, d))).select(
        "doc_id", "title", "author", F.size("elements").alias("n_elements"),
        F.md5(F.array_join(F.transform("elements", lambda e: e["content"]), "\n").cast("binary")).alias("text_md5"),
        F.element_at("elements", -1)["level"].alias("last_level")))
query("A21_document_store", """WITH v AS (SELECT doc_id // 4 AS doc_id, source AS user_id, n_chars, doc_id AS updated_at FROM documents)
    SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY updated_at DESC) = 1""")(
    lambda spark, d: E.current_documents(table(spark, d, "documents").selectExpr(
        "doc_id div 4 AS doc_id", "source AS user_id", "n_chars", "doc_id AS updated_at")))
_TPL = "'tpl ' || p_name || p_partkey AS name, 'f' || p_partkey || '.yaml' AS file, p_type AS type"
query("A18_template_catalog", f"""SELECT {_TPL}, p_size < 25 AS is_custom FROM part""")(
    lambda spark, d: (lambda p: E.merge_catalog(p.filter("p_size >= 25").selectExpr(*_TPL.split(", ")), p.filter("p_size < 25").selectExpr(*_TPL.split(", "))))(
        table(spark, d, "part")))
query("F4_templates_ordered", f"""SELECT {_TPL}, p_size AS created FROM part""")(
    lambda spark, d: table(spark, d, "part").selectExpr(*_TPL.split(", "), "p_size AS created", "p_brand").orderBy(
        F.when(F.col("p_brand") == "Brand#1", -F.col("created")).otherwise(F.col("created")), "name").drop("p_brand"))
