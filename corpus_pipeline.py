"""The corpus pipeline over ``documents``: toxic documents go, boilerplate lines go, one of each group of near-duplicates stays,
documents with benchmark text go, and the rest is mixed by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import leaks, lines, mixing, simhash, toxicity
from proofloom.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours vote toxic are dropped. The model is fitted as in op6, on labels it may learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, labels, "toxic", toxicity.learnable(labels["doc_id"], 0, 5)).select(*COLUMNS)


def boilerplate_lines_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on ten or more sources stay only where they come first; no document is dropped."""
    return lines.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 on five-word shingles, found by SimHash and minima, the document with the smallest id stays."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8).select(*COLUMNS)


def benchmark_text_goes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item are dropped."""
    return leaks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it, repeats counted (0: not in the mix), and its first slot."""
    return mixing.taken(mixing.plan(docs)).select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


STAGES = [("toxicity", toxic_go), ("line_dedup", boilerplate_lines_go), ("simhash_near_dedup", one_of_near_duplicates),
          ("benchmark_decontamination", benchmark_text_goes), ("mix_sources", mixed)]
#: A SQL twin cannot fit the neighbours' vote of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
