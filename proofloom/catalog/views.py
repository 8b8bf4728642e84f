"""Inputs derived from the given tables.

The given texts hold no Chinese, so the Chinese rules would match nothing on
them.  ``zh_elements`` therefore writes one Chinese element per line item: the
document is a run of 16 orders and the wording comes from the line's own
values.  ``latin_elements`` is the real text of ``documents``, one element per
line.  The usage, plan and team tables map ``events``, ``customer``, ``orders``,
``nation``, ``part`` and ``lineitem``.

Each view has a SQL twin that DuckDB runs, kept next to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofloom.functions.ordered import dealt, hot_key, numbered, parts_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# k -> (element type, level, content); q, ln, pk, sk, y, m, d are columns.
_CN = "substr('一二三四五六七八九十', ln, 1)"
_LINES = [
    ("heading", 1, f"'第' || {_CN} || '章 总体情况'"),
    ("heading", 2, "q || '. 研究方法'"),
    ("heading", 1, "CASE WHEN sk % 2 = 0 THEN '参考文献' ELSE '结论' END"),
    ("caption", 0, "'图' || ln || '-' || (q % 4) || ' 温度分布图'"),
    ("caption", 0, "'表' || ln || ' 数据统计表'"),
    ("paragraph", 0, "'如图' || ln || '-' || (q % 4) || '所示，增长率为' || q || '%。见表' || (q % 8)"
                     " || '与公式（' || ln || '-' || (q % 3) || '）。'"),
    ("paragraph", 0, "'相关研究[' || ln || ',' || (q % 9) || ']表明结论可靠[' || (pk % 7) || ']，参见第' || "
                     f"{_CN} || '章与[' || ln || '-' || (ln + 2) || ']。'"),
    ("reference", 0, "'[' || (pk % 9) || '] 张三. 研究报告. ' || y || '.'"),
    ("paragraph", 0, "'由此推导得到平衡方程（' || ln || '-' || (q % 3) || '）'"),
    ("paragraph", 0, "'截止日期为' || y || '年' || m || '月' || (d % 3 + 1) || '日，登记日为' || y || '-' || "
                     "lpad(CAST(m AS STRING), 2, '0') || '-' || lpad(CAST(d % 3 + 1 AS STRING), 2, '0') || '。'"),
    ("paragraph", 0, "'项目总投资为' || CASE WHEN ln % 2 = 0 THEN '1,00' ELSE '100' END || (q % 3) || '万元'"),
    ("paragraph", 0, "'请登录帐号并认真的学习，做为基础。。快速的分析!!座标' || q"),
    ("paragraph", 0, "'这是的的问题，了了了结果，南海海表温度升高'"),
    ("paragraph", 0, "'共计２０２５项，其中' || q || '项完成'"),
    ("paragraph", 0, "'未闭合的（括号【示例】，数据(测试'"),
    ("paragraph", 0, "'随着海洋观测技术的持续进步和数据积累 研究表明该区域温度持续上升并且影响范围扩大'"),
    ("paragraph", 0, "'浓度为' || q || ' ug/L时，温度为' || q || ' ℃，流速加快,需注意.'"),
    ("paragraph", 0, "CASE WHEN ln % 2 = 0 THEN '本文采用AI与ML模型进行分析' ELSE '本文采用人工智能与机器学习模型' END"),
    ("paragraph", 0, "'全长 ' || q || ' km ，相距 ' || q || ' 千米 ，重 ' || q || 'g'"),
    ("paragraph", 0, "CASE ln % 3 WHEN 0 THEN '牵头：清华大学。' WHEN 1 THEN '支持：清化大学，北京研究院承担'"
                     " ELSE '测试：北京研究所' END"),
    ("paragraph", 0, "'第' || q || '季度产量增加，但是利润减少'"),
    ("paragraph", 0, "CASE WHEN ln % 2 = 0 THEN '因为天气原因，工期推迟' ELSE '因为设备故障，因此停工' END"),
    ("paragraph", 0, "CASE WHEN ln % 2 = 0 THEN '如果条件满足，请继续执行' ELSE '只有通过验收，才算合格' END"),
    ("paragraph", 0, "'总之，我们认为必须加强管理'"),
    ("paragraph", 0, "CASE WHEN ln % 2 = 0 THEN '该产品比同类更优' ELSE '质量与数量更加重要' END"),
    ("paragraph", 0, "y || '年启动项目，' || (y - (q % 4)) || '年完成验收'"),
    ("paragraph", 0, f"'第' || {_CN} || '章 绪论......' || q"),
    ("list_item", 0, "'关键词：海洋；遥感'"),
    ("paragraph", 0, "repeat('这是测试内容用于性能评估。', q)"),
    ("paragraph", 0, "'依据合同付款条例，按照协议支付' || q || '万元'"),
]
_TYPE = "CASE k " + " ".join(f"WHEN {i} THEN '{t}'" for i, (t, _, _) in enumerate(_LINES)) + " END"
_LEVEL = "CASE k " + " ".join(f"WHEN {i} THEN {lv}" for i, (_, lv, _) in enumerate(_LINES) if lv) + " ELSE 0 END"
_TEXT = "CASE k " + " ".join(f"WHEN {i} THEN {c}" for i, (_, _, c) in enumerate(_LINES)) + " END"

_BASE = """
  CAST(floor(l_orderkey / 16) AS BIGINT) AS doc_id, l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk,
  l_linenumber AS ln, l_extendedprice AS px, CAST(l_quantity AS INT) AS q, year(l_shipdate) AS y, month(l_shipdate) AS m,
  day(l_shipdate) AS d, CAST((l_partkey + l_suppkey + l_linenumber) % 30 AS INT) AS k
"""
# What follows from other columns is not moved: the same values as in _BASE, from the columns there.
_LATER = {"y": "year(ship)", "m": "month(ship)", "d": "day(ship)", "k": "CAST((pk + sk + ln) % 30 AS INT)"}
# The first elements of even documents form a cover page and a table of contents.
_COVER = "doc_id % 2 = 0 AND element_index < 5"
_FINAL = {
    "element_type": f"CASE WHEN {_COVER} THEN (CASE WHEN element_index = 3 THEN 'heading' ELSE 'paragraph' END) ELSE t END",
    "level": f"CASE WHEN {_COVER} THEN (CASE WHEN element_index = 3 THEN 1 ELSE 0 END) ELSE lv END",
    "content": f"CASE WHEN {_COVER} THEN (CASE element_index WHEN 0 THEN '海洋环境监测总体报告' WHEN 1 THEN '作者：李四'"
               " WHEN 2 THEN '海洋研究所' WHEN 3 THEN '目录' ELSE '摘要' END) ELSE c END",
    "style_name": "CASE WHEN t = 'heading' THEN 'Heading ' || lv WHEN k = 4 THEN 'Caption' ELSE 'Normal' END",
    "font_name_cn": "CASE WHEN pk % 4 = 0 THEN '黑体' WHEN pk % 4 = 1 THEN '' ELSE '宋体' END",
    "font_name_en": "CASE WHEN sk % 3 = 0 THEN 'Arial' ELSE 'Times New Roman' END",
    "font_size_pt": f"CASE WHEN {_COVER} AND element_index < 3 THEN 22.0 ELSE 10.5 + (q % 4) * 0.75 END",
    "bold": "q % 5 = 0",
    "alignment": f"CASE WHEN {_COVER} THEN 'center' WHEN q % 7 = 0 THEN 'center' ELSE 'justify' END",
    "first_indent_twips": "CASE WHEN q % 2 = 0 THEN 0.0 ELSE 420.0 END",
    "line_spacing_type": "CASE q % 4 WHEN 0 THEN 'single' WHEN 1 THEN 'multiple' WHEN 2 THEN 'exact' ELSE 'multiple' END",
    "line_spacing_value": "CASE q % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 WHEN 2 THEN 20.0 ELSE 1.25 END",
}


def zh_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chinese elements with style attributes as plain columns."""
    lines = table(spark, sf_dir, "lineitem")
    columns = {c.rsplit(" AS ", 1)[1]: c.strip() for c in _split(_BASE.strip())}
    base = lines.selectExpr(*[c for n, c in columns.items() if n not in _LATER], "CAST(l_shipdate AS DATE) AS ship")
    order = ["ok", "pk", "sk", "ln", "px"]
    # Numbering moves only small columns, dealt to as many tasks as the rows need; the wording is built above it, behind a
    # generator so that rules on the text are not copied into the CASE below. A document too large for a task is cut into blocks,
    # which must follow the whole order: parts of different orders never share a block of part keys.
    parts = parts_for(lines)
    if hot_key(base, F.col("doc_id")):
        df = numbered(base, ["doc_id"], order, [F.col("ok"), F.floor(F.col("pk") / F.lit(65536))], "element_index", parts=parts)
    else:
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
        df = dealt(base, parts, "doc_id").withColumn("element_index", place.cast("int"))
    df = df.selectExpr("*", *[f"{e} AS {n}" for n, e in _LATER.items()])
    line = F.struct(F.expr(_TYPE).alias("t"), F.expr(_LEVEL).alias("lv"), F.expr(_TEXT).alias("c"))
    df = df.select("*", F.inline(F.array(line)))
    return df.selectExpr(
        "doc_id", "element_index", "q", "pk", "sk", "ln", "k",
        *[f"{'CAST(' + e + ' AS DOUBLE)' if n in _DOUBLES else e} AS {n}" for n, e in _FINAL.items()])


_DOUBLES = {"font_size_pt", "first_indent_twips", "line_spacing_value"}


def _split(text: str) -> list[str]:
    """Split a select list on its top-level commas."""
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


ZH_SQL = f"""
zh AS (
  SELECT doc_id, element_index, q, pk, sk, ln, k,
    {", ".join(f"{'CAST(' + e + ' AS DOUBLE)' if n in _DOUBLES else e} AS {n}" for n, e in _FINAL.items())}
  FROM (
    SELECT *, {_TYPE} AS t, {_LEVEL} AS lv, {_TEXT} AS c FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ok, pk, sk, ln, px) - 1 AS INT) AS element_index
      FROM (SELECT {_BASE} FROM lineitem))))
"""


def zh_elements(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Chinese elements in the library's layout (plus ``keep`` raw columns)."""
    z = zh_flat(spark, sf_dir)
    return z.select(
        "doc_id", "element_index", "element_type", F.col("level").cast("int").alias("level"), "content", "style_name",
        F.struct("font_name_cn", "font_name_en", "font_size_pt", "bold").alias("font"),
        F.struct("alignment", "line_spacing_type", "line_spacing_value").alias("para"),
        "first_indent_twips", F.create_map().cast("map<string,string>").alias("metadata"), *keep)


def latin_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document, in place (no shuffle)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("element_index", "content"),
    ).select(
        "doc_id", "element_index", F.lit("paragraph").alias("element_type"), F.lit(0).alias("level"), "content",
        F.create_map().cast("map<string,string>").alias("metadata"))


LATIN_SQL = """
la AS (
  SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS element_index, 'paragraph' AS element_type, 0 AS level,
         unnest(l) AS content
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
"""

# --- usage, plan and team tables --------------------------------------------

_TOKEN = {
    "id": "event_id", "user_id": "user_id", "amount": "CAST(floor(value) AS BIGINT)",
    "purpose": "CASE event_type WHEN 'click' THEN 'ai_qa' WHEN 'view' THEN 'ai_parse' "
               "WHEN 'error' THEN 'rule_check' WHEN 'purchase' THEN 'ai_qa' ELSE NULL END",
    "created_at": "ts",
}
_PROFILE = {
    "id": "c_custkey", "email": "'User' || c_custkey || '@Example.com'",
    "plan_tier": "CASE c_mktsegment WHEN 'BUILDING' THEN 'free' WHEN 'FURNITURE' THEN ' Pro ' "
                 "WHEN 'MACHINERY' THEN 'TEAM' WHEN 'AUTOMOBILE' THEN 'enterprise' ELSE 'gold' END",
    "plan_status": "CASE c_nationkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'Trialing' WHEN 2 THEN 'canceled' "
                   "WHEN 3 THEN '' ELSE NULL END",
    "period_end": "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '2024-02-01T00:00:00Z' "
                  "WHEN 2 THEN '2000-01-01T00:00:00Z' ELSE 'not a date' END",
    "team_id": "CAST(c_nationkey AS BIGINT)",
    "deep_xref_flag": "CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END",
    "token_quota": "CAST(CASE WHEN c_acctbal < 0 THEN 0 ELSE floor(c_acctbal) END AS BIGINT)",
    "created_at": "CAST('2024-01-01' AS TIMESTAMP) + CAST(c_custkey % 60 AS INT) * INTERVAL '1' DAY",
}
_CODE = {
    "code": "'CODE-' || p_partkey",
    "plan_tier": "CASE WHEN p_type = 'PROMO' THEN 'team' ELSE 'pro' END",
    "duration_days": "p_size", "max_redemptions": "p_size % 7 + 1", "redeemed_count": "CAST(p_partkey % 3 AS INT)",
    "expires_at": "CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE CAST('1999-06-01' AS TIMESTAMP) END",
}
_ATTEMPT = {
    "attempt_id": "l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey", "user_id": "l_suppkey",
    "code": "'CODE-' || (l_partkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END)",
    "ok": "l_orderkey", "ln": "l_linenumber", "sk": "l_suppkey", "ts": "l_shipdate",
}
_TEAM = {
    "id": "CAST(n_nationkey AS BIGINT)", "name": "n_name", "owner_user_id": "CAST(n_nationkey * 3 AS BIGINT)",
    "seat_limit": "30 + n_nationkey * 2", "created_at": "CAST('2024-01-01' AS TIMESTAMP)",
}
_MEMBER = {
    "team_id": "CAST(c_nationkey AS BIGINT)", "user_id": "c_custkey",
    "role": "CASE WHEN c_custkey = c_nationkey * 3 THEN 'owner' ELSE 'member' END",
    "status": "CASE c_custkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'pending' ELSE '' END",
    "invite_email": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'user' || c_custkey || '@example.com' END",
    "joined_at": "CAST('2024-01-01' AS TIMESTAMP) + CAST(c_custkey % 90 AS INT) * INTERVAL '1' DAY",
}
_ACTIVITY = {
    "id": "event_id", "team_id": "user_id % 25", "actor_user_id": "user_id", "event_type": "event_type",
    "status": "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END", "created_at": "ts",
}
_JOB = {
    "id": "o_orderkey", "team_id": "o_custkey % 25", "created_by": "o_custkey",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'queued' END",
    "file_count": "CAST(o_orderkey % 16 AS INT)", "created_at": "o_orderdate",
}
_SOURCES = {
    "token_logs": ("events", _TOKEN), "profiles": ("customer", _PROFILE), "codes": ("part", _CODE),
    "attempts": ("lineitem", _ATTEMPT), "teams": ("nation", _TEAM), "members": ("customer", _MEMBER),
    "activities": ("events", _ACTIVITY), "jobs": ("orders", _JOB),
}


def usage_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = _SOURCES[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def usage_sql(*names: str) -> str:
    return ", ".join(
        f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _SOURCES[n][1].items())} FROM {_SOURCES[n][0]})"
        for n in names)
