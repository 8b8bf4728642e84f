"""The issue row every checker yields, and operations on issue tables."""

from __future__ import annotations

import re
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions.ordered import first_per, top_per
from proofloom.functions.spans import strip
from proofloom.rules.fixed import ISSUE_TEXTS
from proofloom.schemas import ISSUE, ISSUE_COLUMNS

_FIELD = re.compile(r"\{(\w+)\}")


def fill(template: str, args: dict[str, Column]) -> Column:
    """A message template with ``{name}`` fields as a concat expression."""
    parts, last = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > last:
            parts.append(F.lit(template[last:m.start()]))
        parts.append(args[m.group(1)].cast("string"))
        last = m.end()
    if last < len(template) or not parts:
        parts.append(F.lit(template[last:]))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def issue(rule: str, args: dict[str, Column] | None = None, **fields) -> Column:
    """An issue struct for ``rule``; ``fields`` override any column."""
    category, severity, checker, confidence, title, description, suggestion = ISSUE_TEXTS[rule]
    args = args or {}
    values = {
        "category": F.lit(category), "severity": F.lit(severity), "status": F.lit("pending"),
        "title": fill(title, args), "description": fill(description, args),
        "suggestion": fill(suggestion, args), "rule_id": F.lit(rule), "checker": F.lit(checker),
        "element_index": F.lit(-1), "element_type": F.lit("paragraph"), "location_text": F.lit(""),
        "start_pos": F.lit(-1), "end_pos": F.lit(-1), "related_index": F.lit(-1),
        "related_text": F.lit(""), "confidence": F.lit(confidence), "fixable": F.lit(False),
        "fix_type": F.lit(None), "fix_payload": F.lit(None),
    }
    values.update(fields)
    return F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in ISSUE.fields])


def issue_rows(df: DataFrame, rule: str, args: dict[str, Column] | None = None, **fields) -> DataFrame:
    """One issue per input row (``doc_id`` kept)."""
    return df.select("doc_id", issue(rule, args, **fields).alias("i")).select("doc_id", "i.*")


def element(df_columns=None) -> SimpleNamespace:
    """Handles on the columns of an elements table."""
    return SimpleNamespace(
        doc=F.col("doc_id"), index=F.col("element_index"), type=F.col("element_type"), text=F.col("content"),
        level=F.col("level"), metadata=F.col("metadata"),
    )


def flag(e: SimpleNamespace, key: str) -> Column:
    """A true/false metadata entry."""
    return F.coalesce(F.lower(e.metadata[key]) == "true", F.lit(False))


def with_issue_id(issues: DataFrame) -> DataFrame:
    """Stable id: equal issues get equal ids in every run."""
    key = F.concat_ws("\u0001", F.col("doc_id").cast("string"), "category", "rule_id",
                      F.col("element_index").cast("string"), F.col("start_pos").cast("string"),
                      "location_text", "suggestion")
    return issues.withColumn("issue_id", F.substring(F.sha2(key, 256), 1, 16))


def ignore(issues: DataFrame, rule_ids=(), patterns=()) -> DataFrame:
    """Drop issues by rule id, or when location text + title holds a pattern."""
    out = issues
    if rule_ids:
        out = out.filter(~F.coalesce(F.col("rule_id").isin(list(rule_ids)), F.lit(False)))
    if patterns:
        hay = F.trim(F.concat(F.coalesce("location_text", F.lit("")), F.lit(" "), F.coalesce("title", F.lit(""))))
        hit = F.lit(False)
        for p in patterns:
            hit = hit | F.contains(hay, F.lit(p))
        out = out.filter(~hit)
    return out


def of_category(issues: DataFrame, *names: str) -> DataFrame:
    return issues.filter(F.col("category").isin(list(names)))


def of_severity(issues: DataFrame, *names: str) -> DataFrame:
    return issues.filter(F.col("severity").isin(list(names)))


def pending(issues: DataFrame) -> DataFrame:
    return issues.filter(F.col("status") == "pending")


def confident(issues: DataFrame, threshold: float) -> DataFrame:
    return issues.filter(F.col("confidence") >= threshold)


def deduplicate(issues: DataFrame, rank: Column | None = None) -> DataFrame:
    """First issue per document and (category, rule, location, suggestion).

    ``rank`` orders the checkers; an aggregate keeps the first row, so equal
    issues combine before the shuffle however many copies one document has.
    """
    keyed = (
        issues.withColumn("__rank", F.lit(0) if rank is None else rank)
        .withColumn("__rule", F.trim(F.coalesce("rule_id", F.lit(""))))
        .withColumn("__loc", strip(F.coalesce("location_text", F.lit(""))))
        .withColumn("__sug", strip(F.coalesce("suggestion", F.lit(""))))
    )
    keys = ["doc_id", "category", "__rule", "__loc", "__sug"]
    order = ["__rank", "element_index", "start_pos", "end_pos", "title", "description"]
    return first_per(keyed, keys, order).select("doc_id", *ISSUE_COLUMNS)


def report(issues: DataFrame) -> DataFrame:
    """Counters per document."""
    return issues.groupBy("doc_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
        F.count_if(F.col("severity") == "info").alias("info_count"),
        F.count_if(F.col("category") == "typo").alias("typo_count"),
        F.count_if(F.col("category") == "inconsistency").alias("inconsistency_count"),
        F.count_if(F.col("category") == "logic").alias("logic_count"),
    )


def stats(issues: DataFrame) -> DataFrame:
    """Totals over the whole issue table."""
    return issues.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("infos"),
    )


def top_per_category(issues: DataFrame, n: int = 50) -> DataFrame:
    """First ``n`` issues per document and category, each with the full count."""
    order = ["element_index", "start_pos", "rule_id", "location_text", "suggestion", "title"]
    totals = issues.groupBy("doc_id", "category").agg(F.count("*").alias("category_total"))
    return top_per(issues, ["doc_id", "category"], order, n).join(totals, ["doc_id", "category"])


def first_fixable(issues: DataFrame, n: int = 20) -> DataFrame:
    """First ``n`` issues per document that carry a fix payload."""
    order = ["element_index", "start_pos", "rule_id", "location_text", "suggestion", "title"]
    return top_per(issues.filter(F.col("fixable") & F.col("fix_payload").isNotNull()), ["doc_id"], order, n)


def comments(issues: DataFrame) -> DataFrame:
    """Comment text for each issue: ``[CATEGORY] title``, description, advice."""
    body = F.concat(F.lit("["), F.upper("category"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("description"))
    advice = F.when(F.length(F.coalesce("suggestion", F.lit(""))) > 0,
                    F.concat(F.lit("\n建议："), F.col("suggestion"))).otherwise(F.lit(""))
    return issues.filter(F.col("element_index") >= 0).select(
        "doc_id", "element_index", "start_pos", "rule_id", F.concat(body, advice).alias("comment"))
