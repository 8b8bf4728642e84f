"""Applying accepted suggestions and fixes to the elements table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions.ordered import first_per
from proofloom.functions.scalars import fingerprint


def accept_suggestions(elements: DataFrame, accepted: DataFrame) -> DataFrame:
    """Replace the first occurrence of each accepted original in its element.

    ``accepted`` holds (doc_id, element_index, original, suggestion).  Fixes of
    one element apply from the right, so positions stay valid; of overlapping
    ones the leftmost is kept.
    """
    fixes = accepted.groupBy("doc_id", "element_index").agg(F.collect_set(F.struct("original", "suggestion")).alias("fixes"))
    rows = elements.join(fixes, ["doc_id", "element_index"], "left")
    # instr is 1-based, 0 means the original is not there.
    placed = F.filter(
        F.transform("fixes", lambda f: F.struct(
            F.instr(F.col("content"), f["original"]).alias("at"), F.length(f["original"]).alias("n"), f["suggestion"].alias("to"))),
        lambda f: (f["at"] > 0) & (f["n"] > 0))

    def keep(acc: Column, f: Column) -> Column:
        row = F.struct((f["at"] + f["n"]).alias("next"), F.concat(acc["kept"], F.array(f)).alias("kept"))
        return F.when(f["at"] >= acc["next"], row).otherwise(acc)

    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<at:int,n:int,to:string>>").alias("kept"))
    chosen = F.aggregate(F.array_sort(placed), start, keep, lambda a: a["kept"])
    fixed = F.aggregate(F.reverse(chosen), F.col("content"), lambda text, f: F.overlay(text, f["to"], f["at"], f["n"]))
    return rows.withColumn("corrected", F.coalesce(fixed, F.col("content"))).drop("fixes")


def resolve_targets(fixes: DataFrame, elements: DataFrame) -> DataFrame:
    """Element each fix applies to: same index and fingerprint, else the first
    element with the fingerprint, else an error row.

    ``fixes`` holds (fix_id, doc_id, para_idx, para_fingerprint).
    """
    marked = elements.select("doc_id", "element_index", fingerprint(F.col("content")).alias("para_fingerprint"))
    wanted = marked.join(fixes.select("doc_id", "para_fingerprint").distinct(), ["doc_id", "para_fingerprint"], "left_semi")
    exact = wanted.select("doc_id", "para_fingerprint", F.col("element_index").alias("para_idx"), F.lit(True).alias("exact"))
    first = wanted.groupBy("doc_id", "para_fingerprint").agg(F.min("element_index").alias("first_index"))
    out = fixes.join(exact, ["doc_id", "para_fingerprint", "para_idx"], "left").join(first, ["doc_id", "para_fingerprint"], "left")
    target = F.when(F.col("exact"), F.col("para_idx")).otherwise(F.col("first_index"))
    return out.withColumn("element_index", target).withColumn(
        "error", F.when(target.isNull(), "TARGET_NOT_FOUND")).drop("exact", "first_index")


def apply_format_fixes(elements: DataFrame, fixes: DataFrame) -> DataFrame:
    """Set font name, size or line spacing from (doc_id, element_index, attr, mode, value)."""
    per = fixes.groupBy("doc_id", "element_index").agg(
        F.max(F.when(F.col("attr") == "font_name", F.col("value"))).alias("__name"),
        F.max(F.when(F.col("attr") == "font_size", F.col("value").try_cast("double"))).alias("__size"),
        F.max(F.when(F.col("attr") == "line_spacing", F.struct("mode", F.col("value").try_cast("double").alias("value")))).alias("__sp"))
    rows = elements.join(per, ["doc_id", "element_index"], "left")
    font = F.col("font").withField("font_name_cn", F.coalesce("__name", "font.font_name_cn")).withField(
        "font_name_en", F.coalesce("__name", "font.font_name_en")).withField("font_size_pt", F.coalesce("__size", "font.font_size_pt"))
    para = F.col("para").withField("line_spacing_type", F.coalesce("__sp.mode", "para.line_spacing_type")).withField(
        "line_spacing_value", F.coalesce("__sp.value", "para.line_spacing_value"))
    return rows.withColumn("font", font).withColumn("para", para).drop("__name", "__size", "__sp")
