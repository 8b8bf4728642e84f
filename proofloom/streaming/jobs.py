"""The usage log, activity feed and document checks as streams.

Aggregates carry a watermark, so state of closed days and months is dropped.
Quota admission, feeds and incremental checks run the batch operators on each
micro-batch and keep what the next one needs in versioned tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from proofloom.functions.ordered import latest_per
from proofloom.functions.scalars import next_reset, period_key
from proofloom.operators import incremental
from proofloom.operators.usage import activity_feed, admit
from proofloom.session import shared_folder, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = "7 days"
#: Sketches of users: 4096 buckets, a standard error of 1.6 %.
LG_K = 12


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def run_available(stream: DataFrame, folder: str, mode: str, sink: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process what is there and stop; ``sink`` gets each micro-batch, default is a Parquet table."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if sink is None:
        query = writer.format("parquet").option("path", f"{folder}/table").start()
    else:
        query = writer.foreachBatch(sink).start()
    query.awaitTermination()


def latest_rows(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Run an update-mode aggregate and return its current rows."""
    spark = stream.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/updates/batch={batch_id}")

    run_available(stream, folder, "update", save)
    updates = spark.read.parquet(f"{folder}/updates").drop("batch")
    return latest_per(updates, keys, ["batch_id"]).drop("batch_id")


# --- counters ------------------------------------------------------------------

def daily_counters(logs: DataFrame, late: str = LATE) -> DataFrame:
    """Requests per user, purpose and day."""
    return logs.withWatermark("created_at", late).groupBy(
        F.window("created_at", "1 day").alias("w"), "user_id", F.coalesce("purpose", F.lit("unknown")).alias("purpose")
    ).agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), "user_id", "purpose", "n")


def token_daily(logs: DataFrame, late: str = LATE) -> DataFrame:
    """Tokens, requests and users per day and purpose; ``users`` is a mergeable sketch, ``active_users`` its estimate.

    The sketch (2^LG_K buckets, standard error about 1.04 / 2^(LG_K / 2)) is the state, so a day costs a few kilobytes however many
    users it has, and days can be put together: :func:`users_over`.
    """
    daily = logs.withWatermark("created_at", late).groupBy(
        F.window("created_at", "1 day").alias("w"), F.coalesce("purpose", F.lit("unknown")).alias("purpose")
    ).agg(F.sum("amount").alias("total_tokens"), F.count("*").alias("total_requests"), F.hll_sketch_agg("user_id", F.lit(LG_K)).alias("users"))
    return daily.select(F.col("w.start").cast("date").alias("date"), "purpose", "total_tokens", "total_requests", "users", F.hll_sketch_estimate("users").alias("active_users"))


def users_over(days: DataFrame, *keys: str) -> DataFrame:
    """About how many different users the stored rows of :func:`token_daily` have per ``keys``, counted once over days and purposes."""
    return days.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("active_users"))


class MonthlyCounter(StatefulProcessor):
    """Requests per user and month; the state ends with the month."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, reset = (self.count.get()[0] if self.count.exists() else 0), 0
        for pdf in rows:
            n += len(pdf)
            reset = max(reset, int(pdf["reset_ms"].iloc[0]))
        self.count.update((n,))
        self.handle.registerTimer(reset)
        yield pd.DataFrame({"user_id": [key[0]], "period_key": [key[1]], "n": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.count.clear()
        return iter(())

    def close(self) -> None:
        pass


def monthly_counters(logs: DataFrame, late: str = LATE) -> DataFrame:
    rows = logs.withWatermark("created_at", late).withColumn("period_key", period_key(F.col("created_at"))).withColumn(
        "reset_ms", F.unix_millis(next_reset(F.col("created_at")).cast("timestamp")))
    return rows.groupBy("user_id", "period_key").transformWithStateInPandas(
        MonthlyCounter(), "user_id long, period_key string, n long", "Update", "EventTime")


# --- quota ---------------------------------------------------------------------

#: Batches between full versions of the used amounts; those in between hold the changed keys only.
FULL_EVERY = 32


def keep_admitted(logs: DataFrame, profiles: DataFrame, folder: str, late: str = LATE) -> DataFrame:
    """Admit each micro-batch against what its users have used before; ``profiles`` is a static table. Returns the decisions so far.

    A batch is decided by the batch operator, so a hot user and month spans many tasks. Used amounts per user and month stand in
    versions named by the batch: one with all open months every ``FULL_EVERY`` batches, the changed ones in between. A restarted
    stream goes on from them, and a batch that runs again gives the same versions and decisions. Rows more than ``late`` older
    than the newest row of the batches before are left out, and months that ended before that are not carried on.
    """
    spark, path = logs.sparkSession, f"{folder}/used"
    empty = spark.createDataFrame([], "user_id long, period_key string, used long, seen timestamp, v int")
    empty.drop("v").write.mode("ignore").parquet(f"{path}/v=-1")

    def used_before(batch_id: int) -> DataFrame:
        base = (batch_id - 1) // FULL_EVERY * FULL_EVERY
        rows = spark.read.schema(empty.schema).parquet(path).where(F.col("v").between(min(base, -1) if base == 0 else base, batch_id - 1))
        return latest_per(rows, ["user_id", "period_key"], ["v"])

    def save(batch: DataFrame, batch_id: int) -> None:
        known = stored(used_before(batch_id), "used")
        seen = known.agg(F.max("seen")).first()[0]
        rows = batch if seen is None else batch.where(F.col("created_at") >= F.lit(seen) - F.expr(f"INTERVAL {late}"))
        admitted = stored(admit(rows, profiles, spent=known.select("user_id", "period_key", "used")), "admitted")
        admitted.select("id", "user_id", "period_key", "accepted").write.mode("overwrite").parquet(f"{folder}/table/batch={batch_id}")
        newest = admitted.agg(F.max("created_at")).first()[0]
        newest = max((t for t in (seen, newest) if t is not None), default=None)
        taken = admitted.groupBy("user_id", "period_key").agg(F.sum(F.when(F.col("accepted"), F.col("amount")).otherwise(0)).alias("taken"))
        now = known.join(taken, ["user_id", "period_key"], "full" if batch_id % FULL_EVERY == 0 else "right").select(
            "user_id", "period_key", (F.coalesce("used", F.lit(0)) + F.coalesce("taken", F.lit(0))).alias("used"), F.lit(newest).cast("timestamp").alias("seen"))
        if seen is not None:
            now = now.where(F.col("period_key") >= period_key(F.lit(seen) - F.expr(f"INTERVAL {late}")))
        now.write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    run_available(logs, folder, "append", save)
    return spark.read.parquet(f"{folder}/table").drop("batch")


# --- batch jobs ------------------------------------------------------------------

class JobTracker(StatefulProcessor):
    """State of a batch job from the events of its documents: running, then completed, failed or, without an event for
    ``timeout``, timed out. The first end counts; a closed job is forgotten ``keep`` later."""

    def __init__(self, timeout_ms: int, keep_ms: int) -> None:
        self.timeout_ms, self.keep_ms = timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", T.StructType([T.StructField(n, T.LongType()) for n in ("closed", "documents", "issues", "timer")]))

    def _row(self, key, status: str, documents: int, issues: int, at: int, error=None) -> dict:
        return {"job_id": key[0], "status": status, "documents": documents, "issues": issues, "error": error, "at_ms": at}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed, documents, issues, timer = self.job.get() if self.job.exists() else (0, 0, 0, 0)
        out = []
        if not closed:
            events = pd.concat(list(rows)).sort_values(["at_ms", "id"])  # the events of one job in one batch
            for event in events.itertuples():
                if not timer:
                    out.append(self._row(key, "running", 0, 0, event.at_ms))
                    timer = 1
                if event.kind == "document":
                    documents, issues = documents + 1, issues + int(event.issues)
                else:
                    closed = 1
                    out.append(self._row(key, "completed" if event.kind == "finished" else "failed", documents, issues, event.at_ms, event.error if event.kind == "failed" else None))
                    break
            if timer > 1:
                self.handle.deleteTimer(timer)
            timer = int(event.at_ms) + (self.keep_ms if closed else self.timeout_ms)
            self.handle.registerTimer(timer)
            self.job.update((closed, documents, issues, timer))
        yield pd.DataFrame(out, columns=["job_id", "status", "documents", "issues", "error", "at_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed, documents, issues, timer = self.job.get()
        if closed:
            self.job.clear()
            return
        later = timer + self.keep_ms
        self.handle.registerTimer(later)
        self.job.update((1, documents, issues, later))
        yield pd.DataFrame([self._row(key, "timed_out", documents, issues, timer)])

    def close(self) -> None:
        pass


def track_jobs(events: DataFrame, timeout: str, late: str = LATE) -> DataFrame:
    """State rows with their activity from a stream of events (job_id, id, at, kind: document, finished or failed, issues, error)."""
    timeout_ms, keep_ms = (int(pd.Timedelta(t).total_seconds() * 1000) for t in (timeout, late))
    rows = events.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    states = rows.groupBy("job_id").transformWithStateInPandas(
        JobTracker(timeout_ms, keep_ms), "job_id long, status string, documents long, issues long, error string, at_ms long", "Append", "EventTime")
    status = F.col("status")
    text = (F.when(status == "running", "开始批量检查").when(status == "completed", F.concat(F.lit("批量检查完成，共 "), F.col("documents").cast("string"), F.lit(" 份文档，发现 "), F.col("issues").cast("string"), F.lit(" 条问题")))
            .otherwise(F.concat(F.lit("批量检查失败："), F.coalesce("error", F.lit("timeout")))))
    kind = F.when(status == "running", "batch_qa_started").when(status == "completed", "batch_qa_completed").otherwise("batch_qa_failed")
    return states.select("job_id", "status", "documents", "issues", text.alias("summary"), kind.alias("event_type"), F.timestamp_millis("at_ms").alias("updated_at"))


# --- feeds and documents ---------------------------------------------------------

def keep_feed(activities: DataFrame, folder: str, n: int = 100) -> DataFrame:
    """Newest ``n`` activities per team, refreshed by each micro-batch.

    Each batch writes a version of the feed from the newest version before it, which it finds in the folder: a restarted
    stream goes on where it stopped, and a batch that runs again gives the same version.
    """
    spark, path = activities.sparkSession, f"{folder}/feed"
    empty = spark.createDataFrame([], activities.schema)
    empty.write.mode("ignore").parquet(f"{path}/v=-1")

    def version(below: Column) -> DataFrame:
        newest = spark.read.parquet(path).where(below).agg(F.max("v")).first()[0]
        return empty if newest is None else spark.read.parquet(f"{path}/v={newest}")

    def merge(batch: DataFrame, batch_id: int) -> None:
        now = batch.unionByName(version(F.col("v") < batch_id))
        activity_feed(now, n).drop("rank").write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    run_available(activities, folder, "append", merge)
    return version(F.lit(True))


def check_documents(elements: DataFrame, detect: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Element rules straight on a stream of documents, issues appended to a table."""
    run_available(detect(elements), folder, "append")
    return elements.sparkSession.read.parquet(f"{folder}/table")


def check_documents_by_batch(elements: DataFrame, check: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Any checker, also those that group or order: a document arrives whole in one micro-batch."""
    def save(batch: DataFrame, batch_id: int) -> None:
        check(batch).write.mode("overwrite").parquet(f"{folder}/issues/batch={batch_id}")

    run_available(elements, folder, "append", save)
    return elements.sparkSession.read.parquet(f"{folder}/issues").drop("batch")


def recheck(elements: DataFrame, hashes: DataFrame, check: Callable[[DataFrame], DataFrame], folder: str, size: int = incremental.CHUNK_ELEMENTS) -> DataFrame:
    """Issues of the changed chunks of re-uploaded documents (stored hashes: doc_id, chunk_no, content_hash).

    Hashes of every batch are kept beside the stored ones, and a document is compared with its newest version before the batch,
    also after a restart.
    """
    spark, path = elements.sparkSession, f"{folder}/hashes"
    hashes.write.mode("ignore").parquet(f"{path}/batch=-1")

    def save(batch: DataFrame, batch_id: int) -> None:
        new = incremental.chunk_hashes(batch, size)
        kept = spark.read.parquet(path).where(F.col("batch") < batch_id).join(new.select("doc_id").distinct(), "doc_id", "left_semi")
        newest = kept.groupBy("doc_id").agg(F.max("batch").alias("batch"))
        known = kept.join(newest, ["doc_id", "batch"]).drop("batch")
        changed = incremental.changed_elements(batch, incremental.chunk_diff(new, known), size)
        check(changed).write.mode("overwrite").parquet(f"{folder}/rechecked/batch={batch_id}")
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_available(elements, folder, "append", save)
    return spark.read.parquet(f"{folder}/rechecked").drop("batch")
