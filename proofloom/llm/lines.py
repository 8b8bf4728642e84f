"""Line dedup by site spread: HyperLogLog sketches of the sites per line, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.llm.common import column, small, stored, unused

#: A line on so many distinct sites is boilerplate.
SITES = 10
#: Sketch size (2**12 registers, relative error 1.6 %), and how far from the threshold a sketch decides: five errors and one site.
LG_K, MARGIN, LEAST_MARGIN = 12, 0.08, 1
#: Up to so many documents, and removed lines in all, the removals are broadcast; beyond, documents and removals are shuffled.
BROADCAST_DOCS, BROADCAST_LINES = 500_000, 4_000_000
HASH = ["h1", "h2"]


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Every line that is not blank: doc_id, key (hash of the text), site (hash; null is a site), at, h1, h2 (128 bits of the trimmed line)."""
    text = column(docs, text_col)
    each = docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.xxhash64(column(docs, site_col)).alias("site"),
                       F.posexplode(F.split(text, "\n")).alias("at", "line"))
    line = each.withColumn("line", F.btrim("line", F.lit(" \t\r"))).where("line != ''")
    return line.select("doc_id", "key", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(repeated: DataFrame, sites: int = SITES) -> DataFrame:
    """``h1``, ``h2`` of the lines among ``repeated`` occurrences that stand on at least ``sites`` distinct sites.

    Sketches are merged before and after the shuffle, so a line that a third of all documents share is one row per task.
    """
    margin = max(LEAST_MARGIN, MARGIN * sites)
    spread = stored(repeated.groupBy(*HASH).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("about")), "spread")
    sure = spread.where(F.col("about") > sites + margin).select(*HASH)
    near = spread.where(F.abs(F.col("about") - sites) <= margin).select(*HASH)
    exact = repeated.join(small(near), HASH, "left_semi").groupBy(*HASH, "site").count().groupBy(*HASH).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites)
    return sure.unionAll(exact.select(*HASH))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, keep_first: bool = True) -> DataFrame:
    """``doc_id``, ``key``, ``gone``: the numbers of the lines to remove from each document that has any."""
    seen = occurrences(docs, id_col, text_col, site_col)
    often = stored(seen.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites).select(*HASH), "often")
    repeated = stored(seen.join(small(often), HASH, "left_semi"), "repeated")
    spread = stored(boilerplate(repeated, sites), "boilerplate")
    hits = repeated.join(small(spread), HASH, "left_semi")
    if keep_first:
        place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "at")
        home = stored(hits.groupBy(*HASH).agg(F.min(place).alias("home")), "home")
        hits = hits.join(small(home), HASH).where(place != F.col("home"))
    return hits.groupBy("doc_id", "key").agg(F.collect_set("at").alias("gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, keep_first: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and ``n_lines`` and ``n_removed`` beside (existing columns of these names are replaced).

    A line (spaces, tabs and returns at its ends aside) on at least ``sites`` distinct sites is boilerplate. Its first
    occurrence, in the document with the smallest id, stays unless ``keep_first`` is false; all others go. Blank lines are
    never boilerplate. No row is dropped: a text may become empty.

    A null text stays null with 0 lines; an empty text has one, blank line; a null site is a site of its own; null ids come
    last; rows equal in id and text get equal results, so both keep a first occurrence. An empty table gives an empty result.
    """
    id_, key, out, parts = (unused(docs, name) for name in ("id", "key", "gone", "parts"))
    gone = stored(removals(docs, id_col, text_col, site_col, sites, keep_first).withColumnsRenamed({"doc_id": id_, "key": key, "gone": out}), "gone")
    n, lines = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(out)), F.lit(0))).first()
    gone = F.broadcast(gone) if n <= BROADCAST_DOCS and lines <= BROADCAST_LINES else gone
    text = column(docs, text_col)
    joined = docs.join(gone, column(docs, id_col).cast("long").eqNullSafe(gone[id_]) & (F.xxhash64(text) == gone[key]), "left")
    counted = joined.withColumn(parts, F.split(text, "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), out)
    kept = F.when(F.col(out).isNull(), F.col("`" + text_col + "`")).otherwise(F.array_join(F.transform(left, lambda k: F.get(parts, k)), "\n"))
    return counted.withColumns({text_col: kept, "n_lines": F.coalesce(F.array_size(parts), F.lit(0)).cast("long"),
                                "n_removed": F.coalesce(F.array_size(out), F.lit(0)).cast("long")}).drop(parts, out, id_, key)
