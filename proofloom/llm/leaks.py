"""Benchmark decontamination: a distributed positional inverted index of the training words, intersected from the rarest test terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.llm.common import BROADCAST_ROWS, LOWER, UPPER, column, small, stored

#: What separates words: ASCII other than 0-9, A-Z and a-z.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Consecutive words of an item that make a window.
WINDOW = 10


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null: none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), "")


@dataclass(frozen=True)
class Index:
    """Stored tables of one run.

    ``tokens``: doc_id, key (hash of the text), words. ``items``: cls (one per distinct item text), words, ids.
    ``pairs``: cls, first, second: for each window the places in the item of its two rarest terms.
    ``postings``: cls, doc_id, key, at (place in the document), place (in the item) of those terms.
    """

    tokens: DataFrame
    items: DataFrame
    pairs: DataFrame
    postings: DataFrame
    window: int


def build(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          window: int = WINDOW) -> Index:
    """Index ``docs`` for the terms that the windows of ``benchmark`` are searched by.

    Documents are split once and the words stored. Each window is searched by its two terms that the whole corpus holds least;
    a window with a term that no document holds cannot occur. Only these terms get postings, so common words never do.
    Items of equal words are one class. Null ids stay null in documents; in items they count as the empty string.
    """
    text = column(docs, text_col)
    tokens = stored(docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), words(text).alias("words")), "tokens")
    item = F.coalesce(column(benchmark, item_col).cast("string"), F.lit(""))
    items = stored(benchmark.select(item.alias("id"), words(column(benchmark, text_col)).alias("words")).where(F.size("words") > 0)
                   .groupBy("words").agg(F.collect_set("id").alias("ids")).withColumn("cls", F.xxhash64("words")), "items")
    places = items.select("cls", F.size("words").alias("n"), F.posexplode("words").alias("place", "term"))
    terms = stored(places.select("term").distinct(), "terms")
    held = tokens.select(F.explode("words").alias("term"))
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    counted = held.join(F.broadcast(terms), "term").groupBy("term") if few else held.groupBy("term")  # either way common words meet before the shuffle
    held_by = stored(counted.agg(F.count(F.lit(1)).alias("held")).join(terms, "term", "left_semi"), "held")
    length = F.least(F.col("n"), F.lit(window))
    rarest = (places.join(held_by, "term", "left")
              .withColumn("start", F.explode(F.sequence(F.greatest(F.col("place") - length + 1, F.lit(0)), F.least(F.col("place"), F.col("n") - length))))
              .groupBy("cls", "start").agg(F.array_sort(F.collect_list(F.struct("held", "place"))).alias("by"), F.every(F.col("held").isNotNull()).alias("all"))
              .where("all").select("cls", F.col("by")[0]["place"].alias("first"), F.coalesce(F.get("by", F.lit(1))["place"], F.col("by")[0]["place"]).alias("second")))
    pairs = stored(rarest.distinct(), "pairs")
    wanted = pairs.select("cls", F.explode(F.array("first", "second")).alias("place")).distinct()
    anchors = stored(places.select("cls", "place", "term").join(wanted, ["cls", "place"], "left_semi"), "anchors")
    listed = tokens.select("doc_id", "key", F.posexplode("words").alias("at", "term")).join(small(anchors), "term")
    return Index(tokens, items, pairs, stored(listed.select("cls", "doc_id", "key", "at", "place"), "postings"), window)


def _by_class(index: Index) -> DataFrame:
    return small(stored(index.pairs.groupBy("cls").agg(F.collect_list(F.struct("first", "second")).alias("pairs")), "by_class"), 100_000)


def alignments(index: Index) -> DataFrame:
    """``doc_id``, ``key``, ``cls``, ``shift``: where both rarest terms of a window stand at its distances in a document.

    The offset-adjusted lists (place in the document minus place in the item) are intersected by grouping on the shift.
    """
    lists = index.postings.groupBy("doc_id", "key", "cls", (F.col("at") - F.col("place")).alias("shift")).agg(F.collect_set("place").alias("places"))
    met = F.exists("pairs", lambda p: F.array_contains("places", p["first"]) & F.array_contains("places", p["second"]))
    return lists.join(_by_class(index), "cls").where(met).select("doc_id", "key", "cls", "shift")


def phrases(index: Index) -> DataFrame:
    """Exact occurrences: ``doc_id``, ``key``, ``cls``, ``hits`` (places of the document's words inside windows of one alignment)."""
    found = stored(alignments(index), "alignments")
    holders = stored(found.select("doc_id", "key").distinct(), "holders")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])
    tokens = index.tokens.join(small(holders), same(index.tokens, holders), "left_semi").dropDuplicates(["doc_id", "key"])
    aligned = (found.join(tokens, same(found, tokens)).select(found["doc_id"], found["key"], "cls", "shift", "words")
               .join(small(index.items.select("cls", F.col("words").alias("item")), 100_000), "cls"))
    low, high = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("item"), F.size("words") - F.col("shift"))
    equal = F.zip_with(F.slice("words", F.col("shift") + low + 1, high - low), F.slice("item", low + 1, high - low), lambda a, b: F.when(a == b, "1").otherwise("0"))
    length = F.least(F.size("item"), F.lit(index.window))
    starts = F.filter(F.sequence(F.lit(1), F.col("high") - F.col("low") - F.col("length") + 1),
                      lambda k: F.substring(F.col("equal"), k, F.col("length")) == F.repeat(F.lit("1"), F.col("length")))
    hits = F.array_distinct(F.flatten(F.transform("starts", lambda k: F.sequence(F.col("shift") + F.col("low") + k - 1, F.col("shift") + F.col("low") + k + F.col("length") - 2))))
    return (aligned.select("doc_id", "key", "cls", "shift", low.alias("low"), high.alias("high"), length.alias("length"), F.array_join(equal, "").alias("equal"))
            .where("high - low >= length").withColumn("starts", starts).where(F.size("starts") > 0).select("doc_id", "key", "cls", hits.alias("hits")))


def proximity(index: Index, slop: int = 5) -> DataFrame:
    """Near occurrences: ``doc_id``, ``key``, ``cls``, ``off``: both rarest terms of a window stand in a document, ``off`` words
    (at most ``slop``) from their distance in the item; the least ``off`` per document and item."""
    by_place = index.postings.join(F.broadcast(index.pairs) if index.pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else index.pairs, "cls").where("place = first")
    # terms meet in cells of slop + 1 words, so only neighbours are compared
    cell = lambda c: F.floor(c / (slop + 1))
    goal = F.col("at") - F.col("first") + F.col("second")
    firsts = by_place.withColumn("goal", goal).withColumn("cell", F.explode(F.array(*[cell(F.col("goal")) + k for k in (-1, 0, 1)])))
    seconds = index.postings.select("cls", "doc_id", "key", F.col("at").alias("other"), F.col("place").alias("second"), cell(F.col("at")).alias("cell"))
    near = firsts.join(seconds.withColumnRenamed("doc_id", "__doc").withColumnRenamed("key", "__key"),
                       ["cls", "second", "cell"]).where(F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("key") == F.col("__key")))
    off = F.abs(F.col("other") - F.col("goal"))
    return near.where(off <= slop).groupBy("doc_id", "key", "cls").agg(F.min(off).alias("off"))


def contamination(docs: DataFrame, benchmark: DataFrame, **kwargs) -> DataFrame:
    """``doc_id``, ``key``, ``n_words``, ``n_hit``, ``items`` (sorted ids) and ``contaminated`` of every row of ``docs``.

    A word is hit if it stands inside an occurrence of ``window`` consecutive words of an item, or of a whole item of fewer.
    Null and empty texts have no words and no hits; items without words never occur; ties between terms go to the earlier place;
    repeated rows get equal results; empty tables give no rows, or no hits. Other columns are ignored.
    """
    index = build(docs, benchmark, **kwargs)
    found = phrases(index).join(small(index.items.select("cls", "ids"), 100_000), "cls")
    hit = stored(found.groupBy("doc_id", "key").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("n_hit"),
                                                    F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items")), "hit")
    hit = hit.withColumnRenamed("doc_id", "__doc").withColumnRenamed("key", "__key")
    rows = index.tokens.select("doc_id", "key", F.size("words").cast("long").alias("n_words"))
    joined = rows.join(small(hit, 100_000), rows["doc_id"].eqNullSafe(hit["__doc"]) & (rows["key"] == hit["__key"]), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return joined.select("doc_id", "key", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, columns unchanged."""
    found = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **kwargs)
    bad = stored(found.where("contaminated").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct(), "bad")
    same = column(docs, id_col).cast("long").eqNullSafe(bad["__id"]) & (F.xxhash64(column(docs, text_col)) == bad["__key"])
    return docs.join(small(bad), same, "left_anti")
