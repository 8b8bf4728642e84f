"""Checking only what changed: chunk hashes, differences, reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.operators.elements import ordered_text

CHUNK_ELEMENTS = 1000


def chunk_hashes(elements: DataFrame, size: int = CHUNK_ELEMENTS) -> DataFrame:
    """md5 of the text of each run of ``size`` elements."""
    rows = elements.select("doc_id", "element_index", F.coalesce("content", F.lit("")).alias("content"),
                           F.floor(F.col("element_index") / F.lit(size)).cast("int").alias("chunk_no"))
    return rows.groupBy("doc_id", "chunk_no").agg(
        F.min("element_index").alias("start_index"), (F.max("element_index") + 1).alias("end_index"),
        F.md5(ordered_text("content", "element_index", "").cast("binary")).alias("content_hash"))


def chunk_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """Chunks of the new version with a modified flag; vanished chunks are marked removed."""
    o = old.select("doc_id", "chunk_no", F.col("content_hash").alias("old_hash"))
    out = new.join(o, ["doc_id", "chunk_no"], "full")
    return out.select("doc_id", "chunk_no", "content_hash", "old_hash", F.col("content_hash").isNull().alias("removed"),
                      (~F.coalesce(F.col("content_hash") == F.col("old_hash"), F.lit(False))).alias("modified"))


def changed_elements(elements: DataFrame, diff: DataFrame, size: int = CHUNK_ELEMENTS) -> DataFrame:
    """Elements of modified chunks."""
    hit = diff.filter("modified AND NOT removed").select("doc_id", "chunk_no")
    keyed = elements.withColumn("chunk_no", F.floor(F.col("element_index") / F.lit(size)).cast("int"))
    return keyed.join(hit, ["doc_id", "chunk_no"], "left_semi").drop("chunk_no")


def reuse_issues(stored: DataFrame, fresh: DataFrame, diff: DataFrame, size: int = CHUNK_ELEMENTS) -> DataFrame:
    """Stored issues of unchanged chunks plus fresh issues of changed ones."""
    same = diff.filter("NOT modified").select("doc_id", "chunk_no")
    chunk = F.floor(F.col("element_index") / F.lit(size)).cast("int")
    kept = stored.withColumn("chunk_no", chunk).join(same, ["doc_id", "chunk_no"], "left_semi").drop("chunk_no")
    return kept.unionByName(fresh.select(kept.columns))
