"""The whole check: choose rules, run them, merge, drop ignored, deduplicate."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.operators import consistency, detectors, xref
from proofloom.operators.issues import deduplicate, ignore
from proofloom.session import stored
from proofloom.sources.lexicon import typo_issues

Checker = Callable[[DataFrame], DataFrame]

DEFAULT_CATEGORIES = ("typo", "consistency", "crossref", "format")
# Checker order decides which of two equal issues is the first.
CHECKER_RANK = {
    "typo_checker": 0, "consistency_checker": 1, "punctuation_checker": 2, "autocorrect_checker": 3,
    "crossref_checker": 4, "xref_citation_checker": 5, "FormatChecker": 6, "logic_checker": 7,
}


def checkers(categories=DEFAULT_CATEGORIES, lexicon: DataFrame | None = None, extra: dict[str, Checker] | None = None) -> dict[str, Checker]:
    """Checkers by name for the chosen categories.

    Element rules of all categories share one pass over the text; each
    document-level rule adds its own small aggregate.  ``extra`` adds user
    checkers: any function from elements to issues.
    """
    out: dict[str, Checker] = {}
    narrow = []
    if "typo" in categories:
        narrow.append(detectors.de_di_de)
        if lexicon is not None:
            out["lexicon"] = lambda e: typo_issues(e, lexicon)
    if "format" in categories:
        narrow += [d for d in detectors.TEXT_RULES.values() if d is not detectors.de_di_de]
    if "logic_rules" in categories:
        narrow += list(detectors.LOGIC_RULES.values())
        out.update(consistency.ORDER_RULES)
    if narrow:
        out["text"] = lambda e: detectors.detect(e, *narrow)
    if "consistency" in categories:
        out.update(consistency.CONSISTENCY_RULES)
    if "crossref" in categories:
        out["crossref"] = xref.crossref_issues
        out["citation"] = xref.citation_issues
    out.update(extra or {})
    return out


def merge(reports: list[DataFrame]) -> DataFrame:
    """Union of issue tables, equal issues of a document kept once."""
    merged = reduce(DataFrame.unionByName, reports)
    rank = F.lit(99)
    for name, place in CHECKER_RANK.items():
        rank = F.when(F.col("checker") == name, place).otherwise(rank)
    return deduplicate(merged, rank)


def check(elements: DataFrame, categories=DEFAULT_CATEGORIES, lexicon: DataFrame | None = None,
          extra: dict[str, Checker] | None = None, ignore_rules=(), ignore_text=()) -> DataFrame:
    """All issues of a corpus of elements; where several checkers read them, they read one stored table.

    The issues of each checker are then stored as well, one checker after the other, so the driver holds the plan of one of them at
    a time and the merge reads stored tables only.
    """
    chosen = checkers(categories, lexicon, extra)
    many = len(chosen) > 2
    elements = stored(elements, "elements") if many else elements
    reports = (ignore(run(elements), ignore_rules, ignore_text) for run in chosen.values())
    return merge([stored(report, "issues") if many else report for report in reports])


def batch_summary(issues: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-document and per-job counts; ``documents`` holds (job_id, doc_id)."""
    counts = issues.groupBy("doc_id").agg(F.count("*").alias("issues"))
    per_doc = documents.join(counts, "doc_id", "left").select("job_id", "doc_id", F.coalesce("issues", F.lit(0)).alias("issues"))
    per_job = per_doc.groupBy("job_id").agg(F.count("*").alias("documents"), F.sum("issues").alias("issues"))
    return per_doc, per_job


def job_log(per_job: DataFrame, started, finished, failures: DataFrame | None = None) -> DataFrame:
    """State rows of a batch run: queued, running, then completed or, for jobs in ``failures`` (job_id, error), failed."""
    jobs = per_job.withColumn("error", F.lit(None).cast("string")) if failures is None else per_job.join(failures.select("job_id", "error"), "job_id", "left")
    count, failed = F.col("documents").cast("string"), F.col("error").isNotNull()
    done = F.concat(F.lit("批量检查完成，共 "), count, F.lit(" 份文档，发现 "), F.col("issues").cast("string"), F.lit(" 条问题"))
    states = F.array(*[F.struct(s.alias("status"), t.alias("updated_at"), text.alias("summary")) for s, t, text in (
        (F.lit("queued"), started, F.lit("")),
        (F.lit("running"), started, F.concat(F.lit("正在批量检查 "), count, F.lit(" 份文档"))),
        (F.when(failed, "failed").otherwise("completed"), finished, F.when(failed, F.concat(F.lit("批量检查失败："), "error")).otherwise(done)))])
    return jobs.select("job_id", F.posexplode(states).alias("step", "s")).select("job_id", "step", "s.*")


def job_activities(log: DataFrame, per_job: DataFrame) -> DataFrame:
    """Team activities that go with the rows of :func:`job_log`: a run starts, and ends or fails."""
    kind = F.when(F.col("status") == "running", "batch_qa_started").when(F.col("status") == "completed", "batch_qa_completed").when(F.col("status") == "failed", "batch_qa_failed")
    rows = log.withColumn("event_type", kind).filter("event_type IS NOT NULL").join(per_job.select("job_id", "documents"), "job_id")
    text = F.when(F.col("status") == "running", F.concat(F.lit("开始批量检查 "), F.col("documents").cast("string"), F.lit(" 份文档"))).otherwise(F.col("summary"))
    return rows.select(F.col("job_id").alias("batch_job_id"), "event_type", "status", text.alias("summary"), F.col("updated_at").alias("created_at"))
