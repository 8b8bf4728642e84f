"""Streaming queries (L1-L6): the given tables read as file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.catalog import sqlgen as S
from proofloom.catalog.formatting import _EDIT, _HASH
from proofloom.catalog.registry import ORACLE, query
from proofloom.catalog.reports import _MARKS
from proofloom.catalog.usage import LOGS
from proofloom.catalog.views import _ACTIVITY, _TOKEN, LATIN_SQL, latin_elements, table, usage_sql, usage_view
from proofloom.operators import detectors as D
from proofloom.operators import incremental as C
from proofloom.streaming import jobs as J


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a file stream. The path is a pattern, so a table that is one file and a folder of files are read alike."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _log_stream(spark, d):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    return _stream(spark, d, "events").selectExpr(*[f"{e} AS {n}" for n, e in _TOKEN.items()]).withColumn(
        "created_at", F.col("created_at").cast("timestamp"))


def _doc_stream(spark, d):
    docs = _stream(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("element_index", "content")).select(
        "doc_id", "element_index", F.lit("paragraph").alias("element_type"), F.lit(0).alias("level"), "content", F.create_map().cast("map<string,string>").alias("metadata"))


query("L1_stream_daily_counters", f"""{LOGS} SELECT CAST(created_at AS DATE) AS day, user_id, coalesce(purpose, 'unknown') AS purpose, count(*) AS n FROM token_logs GROUP BY ALL""")(
    lambda spark, d: J.latest_rows(J.daily_counters(_log_stream(spark, d)), J.work_folder(spark), ["day", "user_id", "purpose"]))
query("L1_stream_monthly_counters", f"""{LOGS} SELECT user_id, strftime(created_at, '%Y-%m') AS period_key, count(*) AS n FROM token_logs GROUP BY ALL""")(
    lambda spark, d: J.latest_rows(J.monthly_counters(_log_stream(spark, d)), J.work_folder(spark), ["user_id", "period_key"]))


query("L2_stream_quota_admission", ORACLE["E18_quota_admission"])(
    lambda spark, d: J.keep_admitted(_log_stream(spark, d), usage_view(spark, d, "profiles"), J.work_folder(spark)))
query("L3_stream_token_daily", f"""{LOGS} SELECT CAST(created_at AS DATE) AS date, coalesce(purpose, 'unknown') AS purpose, CAST(sum(amount) AS BIGINT) AS total_tokens, count(*) AS total_requests FROM token_logs GROUP BY ALL""")(
    lambda spark, d: J.latest_rows(J.token_daily(_log_stream(spark, d)), J.work_folder(spark), ["date", "purpose"]).drop("active_users", "users"))


def _users(spark, d):
    """Stored days of the stream, and how many users each group of keys has beside the exact number."""
    days = J.latest_rows(J.token_daily(_log_stream(spark, d)), J.work_folder(spark), ["date", "purpose"])
    logs = usage_view(spark, d, "token_logs").select(F.col("created_at").cast("date").alias("date"), F.coalesce("purpose", F.lit("unknown")).alias("purpose"), "user_id")
    out = None
    for keys in (["date", "purpose"], ["purpose"], ["date"]):
        exact = logs.groupBy(*keys).agg(F.countDistinct("user_id").alias("exact"))
        near = J.users_over(days, *keys).join(exact, keys, "full").select(*[F.col(k) if k in keys else F.lit(None).cast("date" if k == "date" else "string").alias(k) for k in ("date", "purpose")],
                                                                          "exact", (F.abs(F.col("active_users") - F.col("exact")) <= F.greatest(F.lit(1), 0.05 * F.col("exact"))).alias("within"))
        out = near if out is None else out.unionByName(near)
    return out


query("L3_stream_active_users", f"""{LOGS}, t AS (SELECT CAST(created_at AS DATE) AS date, coalesce(purpose, 'unknown') AS purpose, user_id FROM token_logs)
    SELECT date, purpose, count(DISTINCT user_id) AS exact, true AS within FROM t GROUP BY GROUPING SETS ((date, purpose), (purpose), (date))""")(_users)
query("L4_stream_activity_feed", f"""WITH {usage_sql('activities')} SELECT * FROM activities QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY created_at DESC, id DESC) <= 100""")(
    lambda spark, d: J.keep_feed(_stream(spark, d, "events").selectExpr(*[f"{e} AS {n}" for n, e in _ACTIVITY.items()]), J.work_folder(spark)))
_HITS = f"SELECT doc_id, element_index, s AS start_pos, hit AS location_text FROM ({S.hits('{src}', _MARKS).replace('{{src}}', '{src}')})"
query("L5_stream_doc_qa", f"WITH {LATIN_SQL} " + _HITS.replace("{src}", "la"))(
    lambda spark, d: J.check_documents(_doc_stream(spark, d), lambda e: D.detect(e, D.repeat_punctuation).select(
        "doc_id", "element_index", "start_pos", "location_text"), J.work_folder(spark)))
query("L6_stream_incremental_recheck", f"""WITH {LATIN_SQL}, ed AS (SELECT doc_id, element_index, element_type, {_EDIT} AS content FROM la), {_HASH.format(name='o', text='content', src='la')}, {_HASH.format(name='n', text='content', src='ed')},
    ch AS (SELECT ed.* FROM ed JOIN n ON n.doc_id = ed.doc_id AND n.chunk_no = floor(element_index / 20) JOIN o ON o.doc_id = n.doc_id AND o.chunk_no = n.chunk_no WHERE n.content_hash <> o.content_hash) """ + _HITS.replace("{src}", "ch"))(
    lambda spark, d: J.recheck(_doc_stream(spark, d).withColumn("content", F.expr(_EDIT)), C.chunk_hashes(latin_elements(spark, d), 20),
                               lambda e: D.detect(e, D.repeat_punctuation).select("doc_id", "element_index", "start_pos", "location_text"), J.work_folder(spark), 20))
_EVENTS = {"job_id": "CAST(floor(o_orderkey / 32) AS BIGINT)", "id": "o_orderkey", "at": "o_orderdate", "kind": "CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'P' THEN 'failed' ELSE 'document' END",
           "issues": "CAST(floor(o_totalprice) % 7 AS BIGINT)", "error": "'order ' || o_orderkey"}


def _job_states(spark, d):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    folder = J.work_folder(spark)
    events = _stream(spark, d, "orders").selectExpr(*[f"{e} AS {n}" for n, e in _EVENTS.items()]).withColumn("at", F.col("at").cast("timestamp"))
    J.run_available(J.track_jobs(events, "90 days 1 hour"), folder, "append")
    return spark.read.parquet(f"{folder}/table")


query("M9_stream_jobs", f"""WITH e AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _EVENTS.items()).replace(' AS at,', ' AS happened,')} FROM orders),
    r AS (SELECT *, row_number() OVER w AS r, count(CASE WHEN kind <> 'document' THEN 1 END) OVER w AS ends, count(CASE WHEN kind = 'document' THEN 1 END) OVER w AS docs,
      CAST(coalesce(sum(CASE WHEN kind = 'document' THEN issues END) OVER w, 0) AS BIGINT) AS found FROM e WINDOW w AS (PARTITION BY job_id ORDER BY happened, id ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT job_id, max(docs) AS docs, max(found) AS found, max(happened) AS last FROM r GROUP BY 1 HAVING max(ends) = 0)
    SELECT job_id, 'running' AS status, 'batch_qa_started' AS event_type, 0 AS documents, 0 AS issues, '开始批量检查' AS summary FROM r WHERE r = 1
    UNION ALL SELECT job_id, CASE kind WHEN 'finished' THEN 'completed' ELSE 'failed' END, CASE kind WHEN 'finished' THEN 'batch_qa_completed' ELSE 'batch_qa_failed' END, docs, found,
      CASE kind WHEN 'finished' THEN '批量检查完成，共 ' || docs || ' 份文档，发现 ' || found || ' 条问题' ELSE '批量检查失败：' || error END FROM r WHERE ends = 1 AND kind <> 'document'
    UNION ALL SELECT job_id, 'timed_out', 'batch_qa_failed', docs, found, '批量检查失败：timeout' FROM t WHERE last + INTERVAL 90 DAY + INTERVAL 1 HOUR <= (SELECT max(happened) FROM e) - INTERVAL 7 DAY""")(
    lambda spark, d: _job_states(spark, d).drop("updated_at"))
