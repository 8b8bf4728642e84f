"""Queries for the merged report (B4-B7, D1-D3, D21, E10-E11, F1-F2, G1-G2, M*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofloom.catalog import sqlgen as S
from proofloom.catalog import consistency as _consistency  # noqa: F401  (the twins of these are composed below)
from proofloom.catalog import text as _text  # noqa: F401
from proofloom.catalog import xref as _xref  # noqa: F401
from proofloom.catalog.registry import ORACLE, query
from proofloom.catalog.views import LATIN_SQL, ZH_SQL, _split, latin_elements, table, zh_elements
from proofloom.functions.scalars import fingerprint
from proofloom.operators import detectors as D
from proofloom.operators import elements as E
from proofloom.operators import fixes as X
from proofloom.operators import issues as I
from proofloom.operators import models as M
from proofloom.plans import qa
from proofloom.rules import fixed as R
from proofloom.session import stored
from proofloom.sources.lexicon import builtin_lexicon
from proofloom.streaming.jobs import work_folder

_LATIN_RULES = (D.repeat_punctuation, D.bracket_pair)


def _latin_issues(spark, d):
    return qa.merge([D.detect(latin_elements(spark, d), *_LATIN_RULES)])


_LA_BRACKETS = " UNION ALL ".join(f"""SELECT doc_id, element_index, -1 AS s, 'format.bracket_pair' AS rule_id,
      substr(content, 1, 60) || CASE WHEN length(content) > 60 THEN '...' ELSE '' END AS loc, '检查并补全对应括号' AS sug, '括号不配对："{p}"' AS title FROM {{src}}
    WHERE length(content) - length(replace(content, '{p[0]}', '')) <> length(content) - length(replace(content, '{p[1]}', ''))""" for p in R.BRACKET_PAIRS)
_MARKS = "|".join(("\\?\\?" if m == "??" else m) for m in R.REPEATED_MARKS)


def _issues_sql(with_sql, src):
    """Doubled marks and brackets, first per fingerprint."""
    return f"""WITH {with_sql}, a AS (SELECT doc_id, element_index, s, 'format.repeat_punctuation' AS rule_id, hit AS loc, substr(hit, 1, 1) AS sug,
        '连续重复标点："' || hit || '"' AS title FROM ({S.hits(src, _MARKS)}) UNION ALL {_LA_BRACKETS.replace("{src}", src)}),
      i AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, rule_id, regexp_replace(loc, '^\\s+|\\s+$', '', 'g'), sug ORDER BY element_index, s, encode(title)) = 1)"""


_LA_ISSUES = _issues_sql(LATIN_SQL, "la")
_ZH_ISSUES = _issues_sql(ZH_SQL, "zh")


def _zh_issues(spark, d):
    return qa.merge([D.detect(zh_elements(spark, d), *_LATIN_RULES)])


# All typo and format rules over the Chinese lines; the twin is composed of the rules' own twins.
_RULE_TWINS = {
    "typo.common_dict": "I1_typo_dict", "typo.de_di_de": "I2_de_di_de", "typo.repeat_char_3plus": "I8_repeat_char_3plus", "typo.repeat_char_2": "I9_repeat_char_2",
    "format.mixed_punctuation": "I3_mixed_punctuation", "format.repeat_punctuation": "I4_repeat_punctuation", "format.fullwidth_digit": "I6_fullwidth_digit",
    "format.bracket_pair": "I7_bracket_pair", "format.sentence_gap": "I10_sentence_gap", "format.unit.ug_per_l": "I11_unit_ug_per_l", "format.unit.celsius_spacing": "I12_unit_celsius_spacing",
}
_TEXT_ISSUES = "WITH a AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{rule}' AS rule_id, location_text AS loc, suggestion AS sug, {"'warning'" if rule == 'typo.common_dict' else 'severity'} AS severity FROM ({ORACLE[name]})"
    for rule, name in _RULE_TWINS.items()) + """),
    i AS (SELECT DISTINCT doc_id, rule_id, regexp_replace(loc, '^\\s+|\\s+$', '', 'g') AS loc, sug, severity, split_part(rule_id, '.', 1) AS category FROM a)"""


def _text_issues(spark, d):
    return qa.check(zh_elements(spark, d), ("typo", "format"), builtin_lexicon(spark))


query("D1_qa_report", f"""{_TEXT_ISSUES} SELECT doc_id, count(*) AS total, count_if(severity = 'error') AS error_count, count_if(severity = 'warning') AS warning_count,
    count_if(severity = 'info') AS info_count, count_if(category = 'typo') AS typo_count, count_if(category = 'inconsistency') AS inconsistency_count, count_if(category = 'logic') AS logic_count
    FROM i GROUP BY 1""")(lambda spark, d: I.report(_text_issues(spark, d)))
query("D2_qa_stats", f"{_TEXT_ISSUES} SELECT count(*) AS total, count_if(severity = 'error') AS errors, count_if(severity = 'warning') AS warnings, count_if(severity = 'info') AS infos FROM i")(
    lambda spark, d: I.stats(_text_issues(spark, d)))
query("D3_dedup_issues", f"{_ZH_ISSUES} SELECT doc_id, rule_id, element_index, s AS start_pos, loc AS location_text, title FROM i")(
    lambda spark, d: _zh_issues(spark, d).select("doc_id", "rule_id", "element_index", "start_pos", "location_text", "title"))
query("B4_ignore_rules", f"""{_ZH_ISSUES} SELECT doc_id, rule_id, element_index, loc AS location_text FROM i
    WHERE rule_id <> 'format.repeat_punctuation' AND NOT contains(loc || ' ' || title, '[]')""")(
    lambda spark, d: I.ignore(_zh_issues(spark, d), ["format.repeat_punctuation"], ["[]"]).select("doc_id", "rule_id", "element_index", "location_text"))
query("B5_select_categories", f"{_TEXT_ISSUES} SELECT category, rule_id, count(*) AS n, count(DISTINCT doc_id) AS docs FROM i GROUP BY ALL")(
    lambda spark, d: _text_issues(spark, d).groupBy("category", "rule_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")))
query("B6_issue_selectors", f"{_ZH_ISSUES} SELECT doc_id, rule_id, element_index, loc AS location_text FROM i")(
    lambda spark, d: I.pending(I.of_severity(I.of_category(_zh_issues(spark, d), "format"), "warning")).select("doc_id", "rule_id", "element_index", "location_text"))
query("B7_min_confidence", f"{_ZH_ISSUES} SELECT doc_id, rule_id, element_index, loc AS location_text FROM i WHERE rule_id = 'format.repeat_punctuation'")(
    lambda spark, d: I.confident(_zh_issues(spark, d), 0.9).select("doc_id", "rule_id", "element_index", "location_text"))
# The whole check, logic included: the twins of all rules, equal issues of a document counted once.
_MORE_TWINS = {
    "consistency.number_format": ("I13_number_format", "suggestion"), "consistency.date_format": ("I14_date_format", "suggestion"), "consistency.proper_noun": ("I15_proper_noun", "suggestion"),
    "consistency.term_alias": ("I16_term_alias", "suggestion"), "consistency.unit_alias": ("I17_unit_alias", "suggestion"), "logic.contradiction.marker_opposite": ("I18_contradiction", "''"),
    "logic.timeline.backward": ("I19_timeline", "''"), "logic.structure.empty_section": ("I20_empty_section", "''"), "logic.causality.incomplete": ("I21_causality", "''"),
    "logic.conclusion.no_evidence": ("I22_conclusion", "''"), "logic.argument.no_evidence": ("I23_argument", "''"), "logic.conditional.incomplete": ("I24_conditional", "''"),
    "xref.plain_text_citation": ("I27_plain_text_citation", "title"),
}
_ALL_CATEGORIES = ("typo", "consistency", "crossref", "format", "logic_rules")
_ALL_ISSUES = " UNION ALL ".join(
    [f"SELECT doc_id, '{rule}' AS rule_id, location_text AS loc, suggestion AS sug, '{R.ISSUE_TEXTS[rule][0]}' AS category, {"'warning'" if rule == "typo.common_dict" else "severity"} AS severity FROM ({ORACLE[name]})"
     for rule, name in _RULE_TWINS.items()]
    + [f"SELECT doc_id, '{rule}', location_text, {sug}, '{R.ISSUE_TEXTS[rule][0]}', '{R.ISSUE_TEXTS[rule][1]}' FROM ({ORACLE[name]})" for rule, (name, sug) in _MORE_TWINS.items()]
    + [f"SELECT doc_id, rule_id, location_text, '', 'reference', severity FROM ({ORACLE['I26_xref_issues']})",
       f"SELECT c.doc_id, rule_id, substr(content, 1, 60), '', 'logic', 'info' FROM ({ORACLE['I25_comparison']}) c JOIN (WITH {ZH_SQL} SELECT * FROM zh) z ON z.doc_id = c.doc_id AND z.element_index = c.element_index"])
query("G1_merge_reports", f"""WITH a AS ({_ALL_ISSUES}), i AS (SELECT DISTINCT doc_id, rule_id, category, severity, regexp_replace(loc, '^\\s+|\\s+$', '', 'g') AS loc, sug FROM a)
    SELECT category, rule_id, severity, count(*) AS n, count(DISTINCT doc_id) AS docs FROM i GROUP BY ALL""")(lambda spark, d: qa.check(
    zh_elements(spark, d), _ALL_CATEGORIES, lexicon=builtin_lexicon(spark)).groupBy(
    "category", "rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")))
query("M1_user_checker", f"{_LA_ISSUES} SELECT rule_id, count(*) AS n FROM i GROUP BY 1")(
    lambda spark, d: qa.check(latin_elements(spark, d), (), extra={"mine": lambda e: D.detect(e, *_LATIN_RULES)}).groupBy("rule_id").agg(F.count("*").alias("n")))
query("F1_top_issues_per_category", f"""{_ZH_ISSUES}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY element_index, s, rule_id, loc, sug, title) AS rank,
      count(*) OVER (PARTITION BY doc_id) AS category_total FROM i)
    SELECT doc_id, rank, category_total, element_index, rule_id FROM t WHERE rank <= 5""")(
    lambda spark, d: I.top_per_category(_zh_issues(spark, d), 5).select("doc_id", "rank", "category_total", "element_index", "rule_id"))
query("C23_issue_comments", f"""{_ZH_ISSUES} SELECT doc_id, element_index, s AS start_pos, '[FORMAT] ' || title AS first_line, '建议：' || sug AS last_line FROM i""")(
    lambda spark, d: I.comments(_zh_issues(spark, d)).select("doc_id", "element_index", "start_pos", F.split("comment", "\n")[0].alias("first_line"),
                                                             F.element_at(F.split("comment", "\n"), -1).alias("last_line")))
_JOB = "CAST(floor(doc_id / 10) AS BIGINT)"
_DOCN = f"""n AS (SELECT doc_id, count(*) AS k FROM i GROUP BY 1), p AS (SELECT {_JOB} AS job_id, doc_id, coalesce(k, 0) AS issues FROM documents LEFT JOIN n USING (doc_id))"""


def _batch(spark, d):
    return qa.batch_summary(_latin_issues(spark, d), table(spark, d, "documents").selectExpr("doc_id", f"{_JOB} AS job_id"))


query("D21_batch_summary", f"{_LA_ISSUES}, {_DOCN} SELECT job_id, count(*) AS documents, CAST(sum(issues) AS BIGINT) AS issues FROM p GROUP BY 1")(
    lambda spark, d: _batch(spark, d)[1])
query("D21_batch_documents", f"{_LA_ISSUES}, {_DOCN} SELECT job_id, doc_id, issues FROM p")(lambda spark, d: _batch(spark, d)[0])
query("M9_batch_job_log", f"""{_LA_ISSUES}, {_DOCN}, j AS (SELECT job_id, count(*) AS n, CAST(sum(issues) AS BIGINT) AS k FROM p GROUP BY 1)
    SELECT job_id, 0 AS step, 'queued' AS status, '' AS summary FROM j UNION ALL SELECT job_id, 1, 'running', '正在批量检查 ' || n || ' 份文档' FROM j
    UNION ALL SELECT job_id, 2, 'completed', '批量检查完成，共 ' || n || ' 份文档，发现 ' || k || ' 条问题' FROM j""")(
    lambda spark, d: qa.job_log(_batch(spark, d)[1], F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-02").cast("timestamp")).select(
        "job_id", "step", "status", "summary"))

_FAILED = "SELECT job_id, 'broken file ' || job_id AS error FROM j WHERE job_id % 5 = 0"
_JOBS = f"""{_LA_ISSUES}, {_DOCN}, j AS (SELECT job_id, count(*) AS n, CAST(sum(issues) AS BIGINT) AS k FROM p GROUP BY 1), x AS ({_FAILED}),
    e AS (SELECT job_id, error IS NOT NULL AS failed, '正在批量检查 ' || n || ' 份文档' AS runs, '开始批量检查 ' || n || ' 份文档' AS begins,
      CASE WHEN error IS NOT NULL THEN '批量检查失败：' || error ELSE '批量检查完成，共 ' || n || ' 份文档，发现 ' || k || ' 条问题' END AS ends FROM j LEFT JOIN x USING (job_id))"""


def _job_log(spark, d):
    jobs = _batch(spark, d)[1]
    failures = jobs.filter("job_id % 5 = 0").select("job_id", F.concat(F.lit("broken file "), F.col("job_id").cast("string")).alias("error"))
    return qa.job_log(jobs, F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-02").cast("timestamp"), failures), jobs


query("M9_failed_jobs", f"""{_JOBS} SELECT job_id, 0 AS step, 'queued' AS status, '' AS summary FROM e UNION ALL SELECT job_id, 1, 'running', runs FROM e
    UNION ALL SELECT job_id, 2, CASE WHEN failed THEN 'failed' ELSE 'completed' END, ends FROM e""")(lambda spark, d: _job_log(spark, d)[0].select("job_id", "step", "status", "summary"))
query("M9_job_activities", f"""{_JOBS} SELECT job_id AS batch_job_id, 'batch_qa_started' AS event_type, 'running' AS status, begins AS summary FROM e
    UNION ALL SELECT job_id, CASE WHEN failed THEN 'batch_qa_failed' ELSE 'batch_qa_completed' END, CASE WHEN failed THEN 'failed' ELSE 'completed' END, ends FROM e""")(
    lambda spark, d: qa.job_activities(*_job_log(spark, d)).drop("created_at"))


def _sunk(spark, d):
    """The issues of three batches of documents, one of them written twice, read back."""
    path, issues = work_folder(spark), _latin_issues(spark, d)
    for batch in (0, 1, 2, 1):
        E.write_batch(issues.filter(F.pmod("doc_id", F.lit(3)) == batch), path, batch)
    return spark.read.parquet(path)


query("A20_issue_sink", f"""{_LA_ISSUES} SELECT doc_id, CAST(doc_id % 3 AS INT) AS batch, element_index, s AS start_pos, rule_id, regexp_replace(loc, '^\\s+|\\s+$', '', 'g') AS location_text,
    sug AS suggestion, title, 'format' AS category FROM i""")(
    lambda spark, d: _sunk(spark, d).select("doc_id", "batch", "element_index", "start_pos", "rule_id", "location_text", "suggestion", "title", "category"))
query("A20_issue_stats", f"{_LA_ISSUES} SELECT doc_id, count(*) AS total, 0 AS errors, count(*) AS warnings, 0 AS infos FROM i GROUP BY 1")(
    lambda spark, d: E.issue_stats(_sunk(spark, d)))

# --- fixes -----------------------------------------------------------------------------------

query("C13_accept_suggestions", f"""WITH {ZH_SQL} SELECT doc_id, element_index,
      CASE WHEN position('做为' in content) > 0 THEN regexp_replace(regexp_replace(content, '帐号', '账号'), '做为', '作为') ELSE content END AS corrected FROM zh""")(
    lambda spark, d: (lambda z: X.accept_suggestions(z, z.filter(F.contains("content", F.lit("做为"))).select(
        "doc_id", "element_index", F.inline(F.expr("array(struct('帐号' AS original, '账号' AS suggestion), struct('做为' AS original, '作为' AS suggestion), struct('没有' AS original, '无' AS suggestion))")))).select(
        "doc_id", "element_index", "corrected"))(zh_elements(spark, d)))
query("H19_fingerprint40", f"WITH {LATIN_SQL} SELECT doc_id, element_index, regexp_replace(substr(content, 1, 40), '^\\s+|\\s+$', '', 'g') AS fingerprint FROM la")(
    lambda spark, d: latin_elements(spark, d).select("doc_id", "element_index", fingerprint(F.col("content")).alias("fingerprint")))
_FIX = "doc_id * 100000 + element_index AS fix_id, doc_id, CASE WHEN q % 3 = 0 THEN element_index + 1 ELSE element_index END AS para_idx, CASE WHEN q % 5 = 0 THEN '无' ELSE substr(content, 1, 40) END AS para_fingerprint"
query("C14_resolve_fix_targets", f"""WITH {ZH_SQL}, f AS (SELECT {_FIX} FROM zh), m AS (SELECT doc_id, element_index, substr(content, 1, 40) AS fp FROM zh),
    g AS (SELECT doc_id, fp, min(element_index) AS fi FROM m GROUP BY ALL)
    SELECT fix_id, coalesce(m.element_index, g.fi) AS element_index, CASE WHEN coalesce(m.element_index, g.fi) IS NULL THEN 'TARGET_NOT_FOUND' END AS error
    FROM f LEFT JOIN m ON m.doc_id = f.doc_id AND m.element_index = f.para_idx AND m.fp = f.para_fingerprint
    LEFT JOIN g ON g.doc_id = f.doc_id AND g.fp = f.para_fingerprint""")(
    lambda spark, d: (lambda z: X.resolve_targets(z.selectExpr(*[c.strip() for c in _split(_FIX)]), z).select(
        "fix_id", "element_index", "error"))(zh_elements(spark, d, "q")))
query("C15_apply_format_fixes", f"""WITH {ZH_SQL} SELECT doc_id, element_index, CASE WHEN q % 3 = 0 THEN '楷体' ELSE font_name_cn END AS cn,
    CASE WHEN q % 3 = 1 THEN 15.5 ELSE font_size_pt END AS size, CASE WHEN q % 3 = 2 THEN 'exact' ELSE line_spacing_type END AS spacing FROM zh""")(
    lambda spark, d: (lambda z: X.apply_format_fixes(z, z.selectExpr(
        "doc_id", "element_index", "element_at(array('font_name', 'font_size', 'line_spacing'), q % 3 + 1) AS attr", "'exact' AS mode",
        "element_at(array('楷体', '15.5', '22'), q % 3 + 1) AS value")).select(
        "doc_id", "element_index", F.col("font.font_name_cn").alias("cn"), F.col("font.font_size_pt").alias("size"), F.col("para.line_spacing_type").alias("spacing")))(
        zh_elements(spark, d, "q")))

# --- model jobs ------------------------------------------------------------------------------

query("B8_core_segments", f"WITH {ZH_SQL} SELECT doc_id, element_index, substr(content, 1, 600) AS segment FROM zh WHERE {S.any_word('content', R.CORE_SEGMENT_WORDS)}")(
    lambda spark, d: M.core_segments(zh_elements(spark, d)))


def _pack_sql(with_sql, src, size):
    return f"""WITH RECURSIVE {with_sql}, e AS (SELECT doc_id, element_index, content, length(content) AS n,
        row_number() OVER (PARTITION BY doc_id ORDER BY element_index) AS r FROM {src} WHERE content <> ''),
      w AS (SELECT doc_id, r, element_index, element_index AS chunk_start, n + 1 AS cur FROM e WHERE r = 1
        UNION ALL SELECT e.doc_id, e.r, e.element_index, CASE WHEN w.cur + e.n > {size} THEN e.element_index ELSE w.chunk_start END,
          CASE WHEN w.cur + e.n > {size} THEN e.n ELSE w.cur + e.n + 1 END FROM w JOIN e ON e.doc_id = w.doc_id AND e.r = w.r + 1),
      c AS (SELECT doc_id, chunk_start, string_agg(content || CASE WHEN w.element_index = chunk_start AND r > 1 THEN '' ELSE chr(10) END, '' ORDER BY w.element_index) AS chunk
        FROM w JOIN e USING (doc_id, r) GROUP BY ALL)
      SELECT doc_id, chunk_start, regexp_replace(chunk, '^\\s+|\\s+$', '', 'g') AS chunk FROM c"""


query("E16_pack_chunks", _pack_sql(ZH_SQL, "zh", 200).replace("w.element_index = chunk_start AND r > 1", "w.element_index = chunk_start AND w.r > 1"))(
    lambda spark, d: M.pack_chunks(zh_elements(spark, d), 200, block=16))
query("E16_pack_chunks_latin", _pack_sql(LATIN_SQL, "la", 800).replace("w.element_index = chunk_start AND r > 1", "w.element_index = chunk_start AND w.r > 1"))(
    lambda spark, d: M.pack_chunks(latin_elements(spark, d), 800))
_SQL_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
#: One piece of every document per step: back to the last paragraph end within reach, else the first sentence end, else the size.
query("E17_split_long_text", f"""WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n FROM documents),
    w AS (SELECT doc_id, CAST(0 AS BIGINT) AS start, -1 AS chunk_id, '' AS chunk FROM t
      UNION ALL SELECT doc_id, stop, chunk_id + 1, CASE WHEN start = 0 AND n <= {R.CHUNK_CHARS} THEN text WHEN stop = n AND rest THEN substr(text, start + 1) ELSE {_SQL_STRIP.format("substr(text, start + 1, stop - start)")} END FROM (
        SELECT *, start + {R.CHUNK_CHARS} >= n AS rest, CASE WHEN start + {R.CHUNK_CHARS} >= n THEN n WHEN p > 0 THEN low + length(seg) - p + 1 WHEN e IS NOT NULL THEN low + e ELSE start + {R.CHUNK_CHARS} END AS stop FROM (
          SELECT *, strpos(reverse(seg), chr(10) || chr(10)) AS p, least({", ".join(f"nullif(strpos(near, {c}), 0)" for c in ("'。'", "'！'", "'？'", "chr(10)"))}) AS e FROM (
            SELECT t.doc_id, w.start, w.chunk_id, text, n, w.start + {R.CHUNK_CHARS - 199} AS low, substr(text, w.start + {R.CHUNK_CHARS - 198}, least(w.start + {R.CHUNK_CHARS + 2}, n) - (w.start + {R.CHUNK_CHARS - 199})) AS seg,
              substr(text, w.start + {R.CHUNK_CHARS - 198}, 200) AS near FROM w JOIN t USING (doc_id) WHERE w.start < n OR w.chunk_id < 0))))
    SELECT doc_id, chunk_id, chunk FROM w WHERE chunk_id >= 0""")(lambda spark, d: M.split_long_text(table(spark, d, "documents")))
_PROMPTS = {"typo": "请检查错别字：\n{text}\n只返回 JSON", "logic": "请检查逻辑：{text}"}
query("M4_build_prompts", """WITH c AS (SELECT conv_id AS doc_id, CAST(turn AS INT) AS chunk_start, text AS chunk FROM conversations)
    SELECT doc_id, chunk_start, 'typo' AS task, '请检查错别字：' || chr(10) || chunk || chr(10) || '只返回 JSON' AS prompt FROM c
    UNION ALL SELECT doc_id, chunk_start, 'logic', '请检查逻辑：' || chunk FROM c""")(
    lambda spark, d: M.build_prompts(table(spark, d, "conversations").selectExpr("conv_id AS doc_id", "CAST(turn AS INT) AS chunk_start", "text AS chunk"), _PROMPTS))

# Responses: one per conversation turn, wording from the turn's own text.
_BODY = ("'{\"issues\": [{\"text\": \"' || substr(regexp_replace(text, '[^A-Za-z]', ''), 1, 6) || '\", \"reason\": \"r' || turn || '\", \"suggestion\": \"s\", \"confidence\": 0.' || (turn % 4 + 5) || "
         "', \"category\": \"' || CASE turn % 3 WHEN 0 THEN 'style' WHEN 1 THEN 'punctuation' ELSE 'odd' END || '\", \"severity\": \"' || CASE turn % 2 WHEN 0 THEN 'error' ELSE 'info' END || "
         "'\", \"needs_review\": ' || CASE conv_id % 2 WHEN 0 THEN 'true' ELSE 'false' END || '}]}'")
_RESP = f"CASE conv_id % 4 WHEN 0 THEN '```json' || chr(10) || {_BODY} || chr(10) || '```' WHEN 1 THEN 'Sure: ' || {_BODY} || ' done' WHEN 2 THEN {_BODY} ELSE 'no json {{here' END"
_TASK = "CASE turn % 4 WHEN 0 THEN 'comprehensive' WHEN 1 THEN 'typo' WHEN 2 THEN 'grammar' ELSE 'logic' END"


def _responses(spark, d):
    return table(spark, d, "conversations").selectExpr(
        "conv_id AS doc_id", "CAST(turn AS INT) AS chunk_id", "CAST(turn AS INT) AS start_index", f"{_TASK} AS task", f"{_RESP} AS response")


_ANS = """a AS (SELECT conv_id AS doc_id, CAST(turn AS INT) AS start_index, turn, conv_id, substr(regexp_replace(text, '[^A-Za-z]', '', 'g'), 1, 6) AS t, 'r' || turn AS reason,
    0.5 + (turn % 4) * 0.1 AS confidence, CASE turn % 3 WHEN 0 THEN 'style' WHEN 1 THEN 'punctuation' ELSE 'odd' END AS cat,
    CASE turn % 2 WHEN 0 THEN 'error' ELSE 'info' END AS sev FROM conversations WHERE conv_id % 4 < 3)"""
_MCAT = "CASE cat WHEN 'style' THEN 'style' WHEN 'punctuation' THEN 'format' ELSE 'typo' END"
query("H16_parse_model_json", f"WITH {_ANS} SELECT doc_id, start_index, t AS text, reason FROM a")(
    lambda spark, d: M.parse_answers(_responses(spark, d)).select("doc_id", "start_index", "text", "reason"))
query("M5_score_responses", f"""WITH {_ANS}, k AS (SELECT *, {_TASK} AS task FROM a WHERE turn % 4 > 0)
    SELECT doc_id, start_index AS element_index, t AS location_text, CASE WHEN task = 'comprehensive' THEN {_MCAT} ELSE task END AS category,
      'warning' AS severity, CASE task WHEN 'typo' THEN '疑似错别字："' || t || '"' WHEN 'grammar' THEN '语法问题：' || reason ELSE cat || '：' || reason END AS title FROM k""")(
    lambda spark, d: M.score_responses(_responses(spark, d)).select("doc_id", "element_index", "location_text", "category", "severity", "title"))
query("M6_review_stage", f"""WITH {_ANS} SELECT doc_id, 'flash' AS stage, t AS location_text, {_MCAT} AS category, 'warning' AS severity, '语义问题：' || reason AS title FROM a WHERE turn % 4 > 0
    UNION ALL SELECT doc_id, 'review', t, {_MCAT}, 'warning', '复核结论：' || reason FROM a WHERE turn % 4 > 0""")(
    lambda spark, d: (lambda r: M.flash_issues(r)[0].select("doc_id", F.lit("flash").alias("stage"), "location_text", "category", "severity", "title").unionByName(
        M.review_issues(r).select("doc_id", F.lit("review").alias("stage"), "location_text", "category", "severity", "title")))(_responses(spark, d)))
query("F2_review_payload", f"""WITH {ZH_SQL}, {_ANS}, c AS (SELECT doc_id, least(count(*), 30) AS n FROM a WHERE turn % 4 > 0 AND conv_id % 2 = 0 GROUP BY 1),
    g AS (SELECT doc_id, least(count(*), 20) AS n FROM zh WHERE {S.any_word('content', R.CORE_SEGMENT_WORDS)} GROUP BY 1)
    SELECT doc_id, CAST(coalesce(c.n, 0) AS INT) AS n_candidates, CAST(coalesce(g.n, 0) AS INT) AS n_segments FROM c FULL JOIN g USING (doc_id)""")(
    lambda spark, d: M.review_payload(M.flash_issues(_responses(spark, d))[1], M.core_segments(zh_elements(spark, d))).select("doc_id", "n_candidates", "n_segments"))
query("M7_analysis_prompt", f"""{_LA_ISSUES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY element_index, s, rule_id, encode(loc), encode(sug), encode(title)) AS n FROM i),
    t AS (SELECT doc_id, count(*) AS total, string_agg(n || '. [warning] ' || title || chr(10) || '   位置: ' || loc, chr(10) ORDER BY n) AS l FROM o GROUP BY 1)
    SELECT doc_id, '质量检查报告：' || chr(10) || '共 ' || total || ' 个问题（错误: 0, 警告: ' || total || ', 提示: 0）' AS head, length(substr(text, 1, 3000)) AS tail FROM t JOIN documents USING (doc_id)""")(
    lambda spark, d: M.analysis_prompt(_latin_issues(spark, d), table(spark, d, "documents").select("doc_id", "text")).select(
        "doc_id", F.regexp_extract("prompt", r"(?s)^(.*?）)", 1).alias("head"),
        F.length(F.substring_index("prompt", "文档内容（节选）:\n", -1)).alias("tail")))

_NEW = "doc_id, element_index, substr(content, q % 5 + 1, 2 + q % 6) AS location_text"


def _model_issues(spark, d):
    """A piece of every element as an issue, made and stored once: those of even parts are new, those of odd parts are there already."""
    pieces = stored(zh_elements(spark, d, "q", "pk").selectExpr(*[c.strip() for c in _split(_NEW)], "pk % 2 AS side"), "pieces")
    return tuple(pieces.filter(f"side = {side}").drop("side") for side in (0, 1))


_STRIPPED = "regexp_replace(location_text, '^\\s+|\\s+$', '', 'g')"
_OLD_NEW = f"{ZH_SQL}, i AS (SELECT {_NEW} FROM zh WHERE pk % 2 = 1), nw AS (SELECT {_NEW} FROM zh WHERE pk % 2 = 0)"
_SIM = """len(list_intersect(list_distinct(string_split(a.t, '')), list_distinct(string_split(b.t, '')))) * 1.0
      / len(list_distinct(list_concat(string_split(a.t, ''), string_split(b.t, '')))) > 0.8"""
for _name, _cont in (("C18_near_dup_issues", True), ("C18_near_dup_jaccard_only", False)):
    _min = 2 if _cont else 1
    _txt = _STRIPPED if _cont else "location_text"
    query(_name, f"""WITH {_OLD_NEW}, n AS (SELECT *, {_txt} AS t FROM nw),
      b AS (SELECT DISTINCT doc_id, {_txt} AS t FROM i WHERE length({_txt}) >= {_min}),
      na AS (SELECT DISTINCT doc_id, t FROM n WHERE length(t) >= {_min}),
      dup AS (SELECT DISTINCT a.doc_id, a.t FROM na a JOIN b ON a.doc_id = b.doc_id AND ({"contains(a.t, b.t) OR contains(b.t, a.t) OR " if _cont else ""}{_SIM}))
      SELECT doc_id, element_index, location_text FROM n ANTI JOIN dup USING (doc_id, t)""")(
        lambda spark, d, c=_cont: M.drop_near_duplicates(*_model_issues(spark, d), containment=c))
#: One new issue of every document per step, with the list of texts kept so far.
query("G2_merge_model_issues", f"""WITH RECURSIVE {_OLD_NEW},
    n AS (SELECT *, {_STRIPPED} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY element_index, location_text) AS r FROM nw),
    b AS (SELECT doc_id, list({_STRIPPED}) FILTER (length({_STRIPPED}) >= 2) AS texts FROM i GROUP BY 1),
    w AS (SELECT doc_id, CAST(0 AS BIGINT) AS r, coalesce(texts, []) AS texts, false AS kept FROM (SELECT DISTINCT doc_id FROM n) LEFT JOIN b USING (doc_id)
      UNION ALL SELECT doc_id, r, CASE WHEN keep AND length(t) >= 2 THEN list_append(texts, t) ELSE texts END, keep FROM (
        SELECT n.doc_id, n.r, n.t, w.texts, length(n.t) < 2 OR len(list_filter(w.texts, lambda x: contains(x, n.t) OR contains(n.t, x)
          OR len(list_intersect(list_distinct(string_split(x, '')), list_distinct(string_split(n.t, '')))) * 1.0
             / len(list_distinct(list_concat(string_split(x, ''), string_split(n.t, '')))) > 0.8)) = 0 AS keep
        FROM w JOIN n ON n.doc_id = w.doc_id AND n.r = w.r + 1))
    SELECT doc_id, element_index, location_text FROM i UNION ALL SELECT doc_id, element_index, location_text FROM n JOIN w USING (doc_id, r) WHERE w.kept""")(
    lambda spark, d: (lambda new, old: M.merge_model_issues(old, new, ["element_index", "location_text"]))(*_model_issues(spark, d)))
