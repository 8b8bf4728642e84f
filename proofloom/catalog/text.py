"""Queries for the element rules (I1-I12), their lexicon and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofloom.catalog import sqlgen as S
from proofloom.catalog.registry import query
from proofloom.catalog.views import LATIN_SQL, ZH_SQL, latin_elements, table, zh_elements
from proofloom.operators import detectors as D
from proofloom.operators import issues as I
from proofloom.rules import fixed as R
from proofloom.sources import lexicon as L

SHORT = ["doc_id", "element_index", "start_pos", "end_pos", "location_text", "suggestion", "title", "severity"]
CJK = f"[{R.CJK}]"


def _zh(detector):
    return lambda spark, d: D.detect(zh_elements(spark, d), detector).select(*SHORT)


def _sql(regex, loc, sug, title, severity, where="true", pre="true", start="s", end="e", source="zh", with_sql=ZH_SQL):
    return f"""WITH {with_sql}, h AS ({S.hits(source, regex, where=pre)})
      SELECT doc_id, element_index, {start} AS start_pos, {end} AS end_pos, {loc} AS location_text,
             {sug} AS suggestion, {title} AS title, '{severity}' AS severity FROM h WHERE {where}"""


_MARK_TO = S.mapping("right(hit, 1)", R.MIXED_MARKS)
query("I3_mixed_punctuation", _sql(
    rf"{CJK}\s*[,\.;:\?!]", "substr(hit, 1, 1) || right(hit, 1)", f"substr(hit, 1, 1) || {_MARK_TO}",
    "'中英文标点混用：\"' || substr(hit, 1, 1) || right(hit, 1) || '\"'", "warning",
    where=f"element_type <> 'reference' AND NOT regexp_matches({S.ch('content', 'e')}, '[0-9０-９]')"))(_zh(D.mixed_punctuation))

_MARKS = "|".join(("\\?\\?" if m == "??" else m) for m in R.REPEATED_MARKS)
_REPEAT = dict(regex=_MARKS, loc="hit", sug="substr(hit, 1, 1)", title="'连续重复标点：\"' || hit || '\"'", severity="warning")
query("I4_repeat_punctuation", _sql(**_REPEAT))(_zh(D.repeat_punctuation))
query("I4_repeat_punctuation_latin", _sql(**_REPEAT, source="la", with_sql=LATIN_SQL))(
    lambda spark, d: D.detect(latin_elements(spark, d), D.repeat_punctuation).select(*SHORT))

query("I5_cjk_ascii_spacing", _sql(
    rf"{CJK}[A-Za-z]|[A-Za-z]{CJK}", "hit", "substr(hit, 1, 1) || ' ' || substr(hit, 2, 1)",
    "'中英文间缺少空格：\"' || hit || '\"'", "info", where="hit_no <= 3"))(_zh(D.cjk_ascii_spacing))

query("I6_fullwidth_digit", _sql(
    "[０-９]+", "hit", "translate(hit, '０１２３４５６７８９', '0123456789')", "'全角数字：\"' || hit || '\"'",
    "warning"))(_zh(D.fullwidth_digit))


def _brackets(source, with_sql):
    one = " UNION ALL ".join(f"""
      SELECT doc_id, element_index, -1 AS start_pos, -1 AS end_pos,
        substr(content, 1, 60) || CASE WHEN length(content) > 60 THEN '...' ELSE '' END AS location_text,
        '检查并补全对应括号' AS suggestion, '括号不配对："{p}"' AS title, 'warning' AS severity,
        '该段落中"{p[0]}"出现 ' || l || ' 次，"{p[1]}"出现 ' || r || ' 次，可能存在未闭合的括号' AS description
      FROM (SELECT *, length(content) - length(replace(content, '{p[0]}', '')) AS l,
                      length(content) - length(replace(content, '{p[1]}', '')) AS r FROM {source}) WHERE l <> r"""
                            for p in R.BRACKET_PAIRS)
    return f"WITH {with_sql} {one}"


query("I7_bracket_pair", _brackets("zh", ZH_SQL))(
    lambda spark, d: D.detect(zh_elements(spark, d), D.bracket_pair).select(*SHORT, "description"))
query("I7_bracket_pair_latin", _brackets("la", LATIN_SQL))(
    lambda spark, d: D.detect(latin_elements(spark, d), D.bracket_pair).select(*SHORT, "description"))


def _runs(cond, sug, title, severity, extra=""):
    """Runs of one repeated CJK character by gaps and islands over characters."""
    return f"""WITH {ZH_SQL}, c AS (
        SELECT doc_id, element_index, content, CAST(i - 1 AS INT) AS pos, substr(content, i, 1) AS ch
        FROM (SELECT *, unnest(range(1, length(content) + 1)) AS i FROM zh)),
      f AS (SELECT *, CASE WHEN ch = lag(ch) OVER w THEN 0 ELSE 1 END AS fresh FROM c
            WINDOW w AS (PARTITION BY doc_id, element_index ORDER BY pos)),
      g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, element_index ORDER BY pos) AS grp FROM f),
      h AS (SELECT doc_id, element_index, any_value(content) AS content, any_value(ch) AS ch, min(pos) AS s,
                   CAST(count(*) AS INT) AS n FROM g GROUP BY doc_id, element_index, grp)
      SELECT doc_id, element_index, s AS start_pos, s + n AS end_pos, repeat(ch, n) AS location_text,
        {sug} AS suggestion, {title} AS title, '{severity}' AS severity
      FROM h WHERE regexp_matches(ch, '{CJK}') AND {cond}{extra}"""


query("I8_repeat_char_3plus", _runs(
    "n >= 3", "ch", "'重复字符：连续' || n || '个\"' || ch || '\"'", "error"))(_zh(D.repeat_char_3plus))
query("I9_repeat_char_2", _runs(
    "n = 2", "ch", "'疑似重复字：\"' || repeat(ch, 2) || '\"'", "info",
    extra=f""" AND NOT contains('{R.VALID_DOUBLES}', ch) AND NOT (contains('{R.WORD_EDGE_CHARS}', ch)
        AND regexp_matches({S.ch('content', '(s - 1)')}, '{CJK}') AND regexp_matches({S.ch('content', '(s + n)')}, '{CJK}'))"""))(
    _zh(D.repeat_char_2))

query("I10_sentence_gap", _sql(
    rf"{CJK}\s+{CJK}", "hit", "substr(hit, 1, 1) || '。' || right(hit, 1)",
    "'句间异常空格：\"' || substr(hit, 1, 1) || '…' || right(hit, 1) || '\"'", "warning",
    pre=f"element_type <> 'heading' AND len(regexp_extract_all(content, '{CJK}')) > 20",
    where=f"length(hit) <= 3 AND NOT (s > 0 AND contains('{R.SENTENCE_ENDS}', {S.ch('content', '(s - 1)')}))"))(_zh(D.sentence_gap))

query("I11_unit_ug_per_l", _sql(
    "(?i)ug/L", "hit", "'μg/L'", "'单位写法不规范：\"ug/L\"'", "warning",
    where=f"NOT regexp_matches({S.ch('content', '(s - 1)')}, '[A-Za-z0-9]') AND NOT regexp_matches({S.ch('content', 'e')}, '[A-Za-z0-9]')"))(
    _zh(D.unit_ug_per_l))
query("I12_unit_celsius_spacing", _sql(
    r"(?i)[0-9]\s+(?:°C|℃)", "hit", r"regexp_replace(hit, '\s+', '')",
    r"""'温度单位前多余空格："' || regexp_replace(hit, '\s+', ' ') || '"'""", "info"))(_zh(D.unit_celsius_spacing))

query("I2_de_di_de", _sql(
    rf"{CJK}{{1,4}}的{CJK}{{1,2}}", "hit", "b || '地' || a", "'的地得用法：\"' || b || '的' || a || '\"'", "warning",
    start="-1", end="-1",
    where=f"b IN {S.inlist(R.ADVERBS)} AND a IN {S.inlist(R.PREDICATE_VERBS)}").replace(
    "FROM h WHERE", rf"""FROM (SELECT *, regexp_extract(hit, '({CJK}{{1,4}})的({CJK}{{1,2}})', 1) AS b,
        regexp_extract(hit, '({CJK}{{1,4}})的({CJK}{{1,2}})', 2) AS a FROM h) WHERE"""))(_zh(D.de_di_de))

# --- lexicon ----------------------------------------------------------------

_BUILTIN = ", ".join(
    "(" + ", ".join([S.lit(w), S.lit(r), S.lit(n), S.lit(layer), str(prio)]) + ")"
    for layer, prio, fixes in (("curated", 1, R.COMMON_WORD_FIXES), ("idiom", 2, R.IDIOM_FIXES)) for w, r, n in fixes)
BUILTIN_SQL = f'lex(wrong, "right", note, layer, priority) AS (VALUES {_BUILTIN})'

query("I1_typo_dict", f"""WITH {ZH_SQL}, {BUILTIN_SQL},
    p AS (SELECT zh.*, lex.*, string_split(content, wrong) AS g FROM zh JOIN lex ON contains(content, wrong)),
    x AS (SELECT *, unnest(range(1, len(g))) AS i FROM p)
    SELECT doc_id, element_index, wrong AS location_text, "right" AS suggestion, '疑似错别字："' || wrong || '"' AS title,
      '建议将"' || wrong || '"修改为"' || "right" || '"' || CASE WHEN note <> '' THEN '。' || note ELSE '' END AS description,
      CAST(list_sum(list_transform(g[1:i], lambda v: length(v))) + (i - 1) * length(wrong) AS INT) AS start_pos,
      CAST(list_sum(list_transform(g[1:i], lambda v: length(v))) + i * length(wrong) AS INT) AS end_pos
    FROM x""")(
    lambda spark, d: L.typo_issues(zh_elements(spark, d), L.builtin_lexicon(spark)).select(
        "doc_id", "element_index", "location_text", "suggestion", "title", "description", "start_pos", "end_pos"))

# Latin lexicon: the first word of each benchmark text against the real documents.
_LATIN_WORDS = "regexp_extract(text, '^([A-Za-z]{4,})', 1)"
query("C1_typo_dict_latin", f"""WITH {LATIN_SQL},
    lex AS (SELECT DISTINCT w AS wrong, upper(w) AS "right" FROM (SELECT {_LATIN_WORDS} AS w FROM benchmark) WHERE w <> ''),
    p AS (SELECT la.doc_id, la.element_index, wrong, "right", string_split(content, wrong) AS g
          FROM la JOIN lex ON contains(content, wrong)),
    x AS (SELECT *, unnest(range(1, len(g))) AS i FROM p)
    SELECT doc_id, element_index, wrong AS location_text, "right" AS suggestion,
      CAST(list_sum(list_transform(g[1:i], lambda v: length(v))) + (i - 1) * length(wrong) AS INT) AS start_pos FROM x""")(
    lambda spark, d: L.typo_issues(
        latin_elements(spark, d),
        table(spark, d, "benchmark").select(F.regexp_extract("text", "^([A-Za-z]{4,})", 1).alias("wrong"))
        .filter("wrong <> ''").distinct().select("wrong", F.upper("wrong").alias("right"), F.lit("").alias("note")),
        gram=4).select("doc_id", "element_index", "location_text", "suggestion", "start_pos"))

# Lexicon lines taken from part names and order counts.
_LEX_LINE = ("CASE WHEN p_partkey % 10 = 0 THEN '# ' || p_name WHEN p_partkey % 10 = 1 THEN '' "
             "WHEN p_partkey % 10 = 2 THEN p_name ELSE p_name || p_size || chr(9) || upper(p_name) || chr(9) "
             "|| CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END END")
query("A15_scan_typo_lexicon", f"""
    WITH l AS (SELECT p_partkey AS line_no, {_LEX_LINE} AS line FROM part),
    p AS (SELECT line_no, string_split(trim(line), chr(9)) AS p FROM l WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')),
    r AS (SELECT line_no, trim(p[1]) AS wrong, trim(p[2]) AS "right", CASE WHEN len(p) >= 3 THEN trim(p[3]) ELSE '' END AS note
          FROM p WHERE len(p) >= 2),
    v AS (SELECT * FROM r WHERE length(wrong) >= 2 AND "right" <> '' AND wrong <> "right" AND NOT contains("right", '/'))
    SELECT wrong, "right", CASE WHEN note <> '' THEN note ELSE '''' || wrong || '''应为''' || "right" || '''' END AS note
    FROM v QUALIFY row_number() OVER (PARTITION BY wrong ORDER BY line_no DESC) = 1""")(
    lambda spark, d: L.lexicon_lines(
        table(spark, d, "part").selectExpr("p_partkey AS line_no", f"{_LEX_LINE} AS line"), "common", 3
    ).select("wrong", "right", "note"))

_PAIR_LINE = "p_name || chr(9) || p_type || chr(9) || CASE WHEN p_size % 9 = 0 THEN 'x' ELSE CAST(p_size % 9 AS STRING) END"
query("A16_scan_ngram_pairs", f"""
    WITH p AS (SELECT p_partkey AS line_no, string_split({_PAIR_LINE}, chr(9)) AS p FROM part),
    r AS (SELECT line_no, p[1] AS wrong, p[2] AS "right", TRY_CAST(p[3] AS INT) AS cnt FROM p)
    SELECT wrong, "right", 'SIGHAN 衍生（出现 ' || cnt || ' 次，仅供参考）' AS note FROM r WHERE cnt >= 2
    QUALIFY row_number() OVER (PARTITION BY wrong ORDER BY line_no DESC) = 1""")(
    lambda spark, d: L.pair_lines(
        table(spark, d, "part").selectExpr("p_partkey AS line_no", f"{_PAIR_LINE} AS line")).select("wrong", "right", "note"))

query("A17_merge_lexicon_layers", f"""
    WITH {BUILTIN_SQL}, u AS (
      SELECT wrong, "right", layer, priority FROM lex
      UNION ALL SELECT DISTINCT p_name, upper(p_name), 'common', 3 FROM part
      UNION ALL SELECT DISTINCT p_name, p_type, 'user', 4 FROM part WHERE p_size < 5
      UNION ALL SELECT DISTINCT p_type, p_name, 'pairs', 0 FROM part)
    SELECT wrong, "right", layer FROM u
    QUALIFY row_number() OVER (PARTITION BY wrong ORDER BY priority DESC, "right") = 1""")(
    lambda spark, d: (lambda p: L.merge_layers(
        L.builtin_lexicon(spark),
        p.selectExpr("p_name AS wrong", "upper(p_name) AS right", "'' AS note", "'common' AS layer", "3 AS priority").distinct(),
        p.filter("p_size < 5").selectExpr("p_name AS wrong", "p_type AS right", "'' AS note", "'user' AS layer", "4 AS priority").distinct(),
        p.selectExpr("p_type AS wrong", "p_name AS right", "'' AS note", "'pairs' AS layer", "0 AS priority").distinct(),
    ))(table(spark, d, "part")).select("wrong", "right", "layer"))
