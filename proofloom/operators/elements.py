"""Selections and text of an elements table, and the document store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions.spans import strip

from proofloom.functions.ordered import dealt, latest_per, parts_for
from proofloom.schemas import DOCUMENT
from proofloom.session import stored


def headings(elements: DataFrame, max_level: int = 9) -> DataFrame:
    return elements.filter((F.col("element_type") == "heading") & (F.col("level") <= max_level))


def of_type(elements: DataFrame, *types: str) -> DataFrame:
    return elements.filter(F.col("element_type").isin(list(types)))


def element_counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy("doc_id", "element_type").agg(F.count("*").alias("n"))


def ordered_text(column: str, order: str, sep: str) -> Column:
    """Aggregate: texts joined in order.  The result is one value, so it is as
    large as the document it rebuilds and no larger."""
    parts = F.sort_array(F.collect_list(F.struct(order, column)))
    return F.array_join(F.transform(parts, lambda x: x[column]), sep)


def document_text(elements: DataFrame) -> DataFrame:
    """Whole text per document, elements joined by newline."""
    kept = elements.filter(F.length("content") > 0)
    return kept.groupBy("doc_id").agg(ordered_text("content", "element_index", "\n").alias("text"))


def ancestors(nodes: DataFrame, keys: list[str], node: str, up: str, parts: int = 0) -> DataFrame:
    """``(*keys, node, at, depth)``: every node with itself (depth 0) and each node above it along ``up``.

    Pointer doubling: what a node reaches within ``step`` hops, joined to the node ``step`` hops below, gives twice as much,
    so a chain of any length takes a logarithmic number of joins. In a cycle each node counts once, at its least depth.
    Each round stores what it finds; a node with itself is never moved. ``parts``: tasks of a join, 0 for the session's.
    """
    deal = lambda df, *by: dealt(df, parts, *keys, *by)
    own = nodes.select(*keys, F.col(node).alias("node"), F.col(node).alias("at"), F.lit(0).alias("depth"))
    known = deal(nodes.select(*keys, F.col(node).alias("up")), "up")
    hop = stored(deal(nodes.where(F.col(up).isNotNull()).select(*keys, F.col(node).alias("node"), F.col(up).alias("up")), "up").join(known, [*keys, "up"], "left_semi").distinct(), "hops")
    pairs, step = stored(hop.where("node <> up").select(*keys, "node", F.col("up").alias("at"), F.lit(1).alias("depth")), "reached"), 1
    while True:
        above = deal(hop.select(*keys, F.col("node").alias("up"), F.col("up").alias("next")), "up")
        hop = stored(deal(hop, "up").join(above, [*keys, "up"]).select(*keys, "node", F.col("next").alias("up")).distinct(), "hops")
        step *= 2
        if hop.isEmpty():
            return own.unionByName(pairs)
        beyond = deal(hop, "up").join(deal(pairs.withColumnRenamed("node", "up"), "up"), [*keys, "up"]).select(*keys, "node", "at", (F.col("depth") + step).alias("depth"))
        reached = hop.select(*keys, "node", F.col("up").alias("at"), F.lit(step).alias("depth")).unionByName(beyond).where("node <> at")
        fresh = deal(reached, "node", "at").join(deal(pairs, "node", "at"), [*keys, "node", "at"], "left_anti")
        fresh = stored(fresh.groupBy(*keys, "node", "at").agg(F.min("depth").alias("depth")), "reached")
        if fresh.isEmpty():
            return own.unionByName(pairs)
        pairs = pairs.unionByName(fresh)


def descendants(elements: DataFrame, parts: int = 0) -> DataFrame:
    """``(doc_id, root_index, element_index, depth)`` along ``parent_index``, at any depth."""
    return ancestors(elements, ["doc_id"], "element_index", "parent_index", parts).select(
        "doc_id", F.col("at").alias("root_index"), F.col("node").alias("element_index"), "depth")


#: Elements of a document up to which its flat texts are built in one task; those of larger documents are spread.
FLAT_ROWS = 4096


def flat_text(elements: DataFrame) -> DataFrame:
    """Text of each element with the text of its descendants, in order.

    An element goes with the list of elements it belongs to, so its text moves once, not once for each of them.
    """
    slim = stored(elements.select("doc_id", "element_index", "parent_index", "content"), "elements")
    parts = parts_for(slim)
    above = descendants(slim, parts).where("depth > 0").select("doc_id", "element_index", "root_index")
    roots = dealt(above, parts, "doc_id", "element_index").groupBy("doc_id", "element_index").agg(F.collect_list("root_index").alias("roots"))
    text = dealt(slim.filter(F.length("content") > 0).select("doc_id", "element_index", "content"), parts, "doc_id", "element_index")
    rows = text.join(roots, ["doc_id", "element_index"], "left").withColumn(
        "roots", F.concat(F.array("element_index"), F.coalesce("roots", F.array().cast("array<int>"))))

    def joined(rows: DataFrame) -> DataFrame:
        each = rows.select("doc_id", F.explode("roots").alias("root_index"), "element_index", "content")
        return each.groupBy("doc_id", "root_index").agg(ordered_text("content", "element_index", "\n").alias("text"))

    def together(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "doc_id") if parts else rows.repartition("doc_id")

    many = stored(slim.groupBy("doc_id").count().filter(F.col("count") > FLAT_ROWS).select("doc_id"), "many")
    if many.isEmpty():
        return joined(together(rows))
    rows = stored(rows, "rows")
    return joined(together(rows.join(many, "doc_id", "left_anti"))).unionByName(joined(rows.join(many, "doc_id", "left_semi")))


def to_json(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.to_json(F.struct(*[f.name for f in DOCUMENT.fields])).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """Unknown keys are dropped, missing ones are null."""
    return rows.select("doc_id", F.from_json("json", DOCUMENT).alias("d")).select("doc_id", "d.*")


def current_documents(versions: DataFrame) -> DataFrame:
    """Latest version of each stored document."""
    return latest_per(versions, ["doc_id"], ["updated_at"])


def merge_catalog(preset: DataFrame, custom: DataFrame) -> DataFrame:
    """Preset and custom templates with a flag."""
    return preset.withColumn("is_custom", F.lit(False)).unionByName(custom.withColumn("is_custom", F.lit(True)))


def find_template(catalog: DataFrame, name: str) -> DataFrame:
    return catalog.filter((F.col("name") == name) | (F.col("file") == name))


def write_issues(issues: DataFrame, path: str, mode: str = "append") -> None:
    """Issue table partitioned by category; JSON columns stay nested."""
    issues.write.mode(mode).partitionBy("category").parquet(path)


#: What a reader of the issue table sees of each issue.
FLAT = ["doc_id", "issue_id", "category", "severity", "title", "description", "suggestion", "confidence", "location_text", "element_index",
        "start_pos", "end_pos", "rule_id", "checker"]


def write_batch(issues: DataFrame, path: str, batch: int) -> None:
    """The flat issues of one batch of documents, in the partition of that batch: a batch written again replaces itself, never doubles,
    and batches side by side do not touch each other."""
    flat = issues.select(*[c for c in FLAT if c in issues.columns]).withColumn("location_text", strip(F.coalesce("location_text", F.lit(""))))
    flat.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def issue_stats(issues: DataFrame) -> DataFrame:
    """Issues, errors, warnings and infos per document."""
    return issues.groupBy("doc_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s + "s") for s in ("error", "warning", "info")])
