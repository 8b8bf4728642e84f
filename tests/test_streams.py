"""Streams over several batches, with a restart between them."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from proofloom.operators import incremental
from proofloom.streaming import jobs as J


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_feed_goes_on_after_a_restart(spark, tmp_path):
    schema = "team_id long, id long, created_at timestamp, title string"
    source, work, day = str(tmp_path / "in"), str(tmp_path / "work"), datetime(2026, 1, 1)
    rows = [(k % 2, k, day + timedelta(hours=k), f"t{k}") for k in range(12)]
    for k in range(3):
        add(spark, source, rows[4 * k:4 * k + 4], schema)
        got = J.keep_feed(spark.readStream.schema(schema).parquet(source), work, 3)
    assert sorted(r.id for r in got.collect()) == [6, 7, 8, 9, 10, 11]
    # nothing new: the last version stays
    assert J.keep_feed(spark.readStream.schema(schema).parquet(source), work, 3).count() == 6


def test_recheck_compares_with_the_last_upload(spark, tmp_path):
    schema = "doc_id long, element_index int, content string, element_type string"
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    doc = lambda text: [(1, k, text if k == 1 else f"line {k}", "paragraph") for k in range(4)]
    hashes = incremental.chunk_hashes(spark.createDataFrame(doc("a"), schema), 2)
    counts = []
    for text in ("b", "b", "a"):  # changed, the same again, back to the first
        add(spark, source, doc(text), schema)
        got = J.recheck(spark.readStream.schema(schema).parquet(source), hashes, lambda e: e.select("doc_id", "element_index"), work, 2)
        counts.append(got.count())
    assert counts == [2, 2, 4]


def test_late_events_are_left_out(spark, tmp_path):
    schema = "user_id long, purpose string, created_at timestamp, amount long"
    source, work, day = str(tmp_path / "in"), str(tmp_path / "work"), datetime(2026, 1, 1)
    for rows in ([(1, "x", day, 1)], [(1, "x", day + timedelta(days=30), 1)], [(2, "x", day + timedelta(days=30), 1)], [(1, "x", day, 1), (1, "x", day + timedelta(days=30), 1)]):
        add(spark, source, rows, schema)
        got = J.latest_rows(J.daily_counters(spark.readStream.schema(schema).parquet(source)), work, ["day", "user_id", "purpose"])
    assert sorted((str(r.day), r.user_id, r.n) for r in got.select(F.col("day").cast("string").alias("day"), "user_id", "n").collect()) == [("2026-01-01", 1, 1), ("2026-01-31", 1, 2), ("2026-01-31", 2, 1)]


def test_jobs_end_once_or_time_out(spark, tmp_path):
    schema = "job_id long, id long, at timestamp, kind string, issues long, error string"
    source, work, day = str(tmp_path / "in"), str(tmp_path / "work"), datetime(2026, 1, 1)
    at = lambda n: day + timedelta(days=n)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    batches = [
        [(1, 1, at(0), "document", 2, None), (2, 2, at(0), "document", 5, None), (3, 3, at(0), "finished", 0, None)],
        [(1, 5, at(1), "finished", 0, None), (1, 4, at(1), "document", 3, None), (3, 6, at(1), "failed", 0, "too late")],
        [(4, 7, at(9), "failed", 0, "broken"), (5, 8, at(30), "document", 1, None)],  # past the timeout of job 2
        [(5, 9, at(31), "document", 1, None)],
    ]
    for rows in batches:  # a restart between them
        add(spark, source, rows, schema)
        J.run_available(J.track_jobs(spark.readStream.schema(schema).parquet(source), "10 days"), work, "append")
    got = sorted((r.job_id, r.status, r.documents, r.issues, r.event_type) for r in spark.read.parquet(f"{work}/table").collect())
    assert got == [(1, "completed", 2, 5, "batch_qa_completed"), (1, "running", 0, 0, "batch_qa_started"), (2, "running", 0, 0, "batch_qa_started"), (2, "timed_out", 1, 5, "batch_qa_failed"),
                   (3, "completed", 0, 0, "batch_qa_completed"), (3, "running", 0, 0, "batch_qa_started"), (4, "failed", 0, 0, "batch_qa_failed"), (4, "running", 0, 0, "batch_qa_started"),
                   (5, "running", 0, 0, "batch_qa_started")]


def test_daily_users_over_batches_with_a_late_event(spark, tmp_path):
    schema = "user_id long, purpose string, created_at timestamp, amount long"
    source, work, day = str(tmp_path / "in"), str(tmp_path / "work"), datetime(2026, 1, 1)
    for rows in ([(k, "x", day, 1) for k in range(3000)], [(k, "x", day, 1) for k in range(1500, 4000)], [(k, "y", day + timedelta(days=30), 1) for k in range(3000, 5000)],
                 [(9999, "x", day, 1), (1, "y", day + timedelta(days=31), 1)]):
        add(spark, source, rows, schema)
        days = J.latest_rows(J.token_daily(spark.readStream.schema(schema).parquet(source)), work, ["date", "purpose"])
    near = lambda got, want: abs(got - want) <= 0.05 * want
    each = {(str(r.date), r.purpose): (r.total_requests, r.active_users) for r in days.collect()}
    assert each["2026-01-01", "x"][0] == 5500 and near(each["2026-01-01", "x"][1], 4000)  # the late event is left out
    assert near(J.users_over(days.withColumn("all", F.lit(1)), "all").first().active_users, 5000)


def test_monthly_counts_end_with_the_month(spark, tmp_path):
    schema = "user_id long, purpose string, created_at timestamp, amount long"
    source, work, day = str(tmp_path / "in"), str(tmp_path / "work"), datetime(2026, 1, 30)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    for rows in ([(1, "x", day, 1)] * 3, [(1, "x", day + timedelta(days=40), 1)], [(1, "x", day + timedelta(days=41), 1)]):  # the timer of January goes off
        add(spark, source, rows, schema)
        got = J.latest_rows(J.monthly_counters(spark.readStream.schema(schema).parquet(source)), work, ["user_id", "period_key"])
    assert sorted((r.period_key, r.n) for r in got.collect()) == [("2026-01", 3), ("2026-03", 2)]
