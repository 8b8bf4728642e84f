"""Lint diagnostics (line, col, old, new, severity) turned into issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions.spans import let, strip
from proofloom.operators.issues import issue_rows
from proofloom.rules import fixed as R

# Advice to add a space between two kinds of character: (with space, without).
_SPACING = [
    (r"(?U)[\d.]+\s+[一-鿿]", r"(?U)[\d.]+[一-鿿]"), (r"(?U)[一-鿿]\s+[\d.]", r"(?U)[一-鿿][\d.]"),
    (r"(?U)[一-鿿]\s+[a-zA-Z]", r"[一-鿿][a-zA-Z]"), (r"(?U)[a-zA-Z]\s+[一-鿿]", r"[a-zA-Z][一-鿿]"),
]


def problem_kind(old: Column, new: Column) -> Column:
    marks = "[" + "".join("\\" + c if not c.isalnum() else c for c in R.LINT_MARKS) + "]"
    return (
        F.when(new.rlike(r"(?U)[a-zA-Z\d]\s+[一-鿿]|[一-鿿]\s+[a-zA-Z\d]"), "中英文空格规范").when(new.rlike(marks), "标点规范")
        .when(F.contains(new, F.lit("  ")) | F.contains(old, F.lit("   ")), "空格规范").when(F.lower(old) != F.lower(new), "大小写规范").otherwise("文案规范"))


def lint_issues(diagnostics: DataFrame, elements: DataFrame, min_confidence: float = R.MIN_LINT_CONFIDENCE) -> DataFrame:
    """Diagnostics per document line; spacing advice drops out, and punctuation advice inside the bibliography."""
    if R.LINT_CONFIDENCE < min_confidence:
        return issue_rows(elements.limit(0), "autocorrect.lint", {"kind": F.lit(""), "old16": F.lit(""), "old": F.lit(""), "new": F.lit("")})
    old, new = F.coalesce("old", F.lit("")), F.coalesce("new", F.lit(""))
    d = diagnostics.select("doc_id", F.coalesce("line", F.lit(1)).alias("line"), F.coalesce("col", F.lit(1)).alias("col"), old.alias("old"), new.alias("new"),
                           F.lower(F.coalesce("severity", F.lit("warning"))).alias("sev"))
    advice = F.lit(False)
    for spaced, tight in _SPACING:
        advice = advice | (F.col("new").rlike(spaced) & F.col("old").rlike(tight))
    d = d.filter(~(advice & (F.length("old") > 0) & (F.length("new") > 0)))
    last = elements.groupBy("doc_id").agg(F.max("element_index").alias("last"), F.min(F.when(
        (F.col("element_type") == "heading") & F.col("content").rlike(R.LINT_BIBLIOGRAPHY), F.col("element_index"))).alias("bib"))
    d = d.join(last, "doc_id").withColumn("element_index", F.greatest(F.lit(0), F.least(F.col("last"), F.col("line") - 1)))
    d = d.join(elements.select("doc_id", "element_index", "content"), ["doc_id", "element_index"])
    d = d.withColumn("kind", problem_kind(F.col("old"), F.col("new")))
    d = d.filter(~(F.coalesce(F.col("element_index") > F.col("bib"), F.lit(False)) & (F.col("kind") == "标点规范")))
    mark = F.coalesce(*[F.when(F.contains("old", F.lit(m)) & F.contains("content", F.lit(m)), F.lit(m)) for m in R.LINT_FALLBACK_MARKS])
    whole = (F.length("old") > 0) & F.contains("content", F.col("old"))
    snippet = F.when(whole, F.col("old")).when(mark.isNotNull(), mark)
    start = F.when(snippet.isNotNull(), F.instr(F.col("content"), snippet) - 1).otherwise(F.greatest(F.lit(0), F.col("col") - 1))
    end = F.when(snippet.isNotNull(), start + F.length(snippet)).otherwise(F.greatest(F.lit(0), F.col("col")))
    return issue_rows(
        d, "autocorrect.lint", {"kind": F.col("kind"), "old16": F.substring("old", 1, 16), "old": F.col("old"), "new": F.col("new")},
        severity=F.when(F.col("sev").isin("error", "warning"), "warning").otherwise("info"), element_index=F.col("element_index"),
        location_text=F.coalesce(snippet, strip(F.col("old"))), start_pos=start, end_pos=end)


def fielded_references(fields: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Display texts of standalone REF fields whose bookmark exists (doc_id, instruction, display)."""
    name = F.regexp_extract("instruction", r"(?iU)REF\s+(\S+)", 1)
    refs = fields.filter(F.col("instruction").rlike(r"(?iU)^\s*REF\s") & (F.length(strip(F.col("display"))) > 0)).withColumn("bookmark", name)
    named = refs.filter(F.length("bookmark") > 0).join(bookmarks.select("doc_id", "bookmark").distinct(), ["doc_id", "bookmark"], "left_semi")
    return named.unionByName(refs.filter(F.length("bookmark") == 0).select(named.columns)).select("doc_id", strip(F.col("display")).alias("ref_text"))
