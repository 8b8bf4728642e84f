"""Exact duplicates by deterministic block naming: sorted fixed-size blocks become integers, adjacent pairs of integers are named
again until each document has one, and equal texts are those with equal identities."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.llm.common import LOWER, UPPER, column, small, stored

#: Bytes of a block.
BLOCK = 4096
#: The second of a pair that has none.
NONE = -2**63


def folded(text: Column) -> Column:
    """Bytes of a text after lower-casing A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary")


def blocks(data: Column, size: int) -> Column:
    """The bytes cut into blocks of ``size`` bytes, the last as long as it comes; no bytes are one empty block."""
    last = F.floor((F.octet_length(data) - 1) / F.lit(size)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.substring(data, k * size + 1, F.lit(size)))


def named(df: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct ``keys`` with ``name``, an integer of their own: place in sorted order behind the number of the partition that
    holds them. Whole keys are compared, equal ones meet before the shuffle, and a partition computed again gives the same names."""
    return df.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK, route: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``row`` (a number of its own), ``doc_id``, ``text_sha256``, ``level`` and ``name`` of every row of ``docs``. Rows have equal
    ``level`` and ``name`` exactly if their texts are equal after lower-casing A-Z; no hash decides.

    Blocks are shuffled once, distinct ones only. Their rows then find the name by ``route``, a hash of 8 bytes, since all distinct
    blocks have met and those whose hash is not theirs alone are known: these keep their bytes and are named by them.
    Each further level has half as many rows. Null texts count as empty; repeated rows are rows of their own; an empty table gives none.
    """
    texts = docs.select(column(docs, id_col).alias("doc_id"), folded(column(docs, text_col)).alias("data"))
    leaves = texts.select(F.explode(blocks(F.col("data"), size)).alias("block")).withColumn("h", route(F.col("block")))
    first = stored(named(leaves, ["h", "block"]).select("h", "name"), "blocks")
    shared = stored(first.groupBy("h").count().where("count > 1").select("h", F.lit(True).alias("shared")), "shared")
    cells = (texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("data", 256).alias("sha"), blocks(F.col("data"), size).alias("parts"))
             .select("row", "doc_id", "sha", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "block")).withColumn("h", route(F.col("block")))
             .join(small(shared), "h", "left"))
    head = F.col("pos") == 0
    cells = stored(cells.select("row", "n", "pos", "h", F.when(F.col("shared"), F.col("block")).alias("block"), F.when(head, F.col("doc_id")).alias("doc_id"), F.when(head, F.col("sha")).alias("sha")), "cells")
    hashed = cells.where("block IS NULL").join(first, "h")
    told = cells.where("block IS NOT NULL")
    apart = stored(named(told, ["h", "block"]).withColumn("name", -1 - F.col("name")), "apart")
    now = stored(hashed.select("row", "n", "pos", "name").unionAll(told.join(apart, ["h", "block"]).select("row", "n", "pos", "name")), "level")
    ended, level = [now.where("n = 1").select("row", F.lit(0).alias("level"), "name")], 0
    left = now.agg(F.max("n")).first()[0] or 0
    while left > 1:
        level, left = level + 1, (left + 1) // 2
        side = F.col("pos") % 2
        pairs = stored(now.where("n > 1").groupBy("row", "n", F.expr("pos div 2").alias("pos"))
                       .agg(F.max(F.when(side == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(NONE)).alias("b")), "pairs")
        names = stored(named(pairs, ["a", "b"]), "names")
        now = stored(pairs.join(names, ["a", "b"]).select("row", F.expr("(n + 1) div 2").alias("n"), "pos", "name"), "level")
        ended.append(now.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
    whole = ended[0]
    for more in ended[1:]:
        whole = whole.unionAll(more)
    return cells.where(head).select("row", "doc_id", F.col("sha").alias("text_sha256")).join(whole, "row")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id`` (the largest id among equal texts; null ids come last), ``group_size``,
    ``kept`` and ``text_sha256`` (of the lower-cased text). Of rows with equal texts exactly one is kept, of repeated ids one of them."""
    rows = stored(identities(docs, id_col, text_col, **kwargs), "identities")
    each = stored(rows.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("stays")), "groups")
    return rows.join(each, ["level", "name"]).select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), "text_sha256")


def keep_last(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """``docs``, all columns, without the rows whose text stands under a larger id; of repeated rows (equal id and text) one stays."""
    kept = groups(docs, id_col, text_col, **kwargs).where("kept").select(F.col("doc_id").alias("kept"), F.col("text_sha256").alias("sha"))
    mark = f"sha {uuid.uuid4().hex}"  # a name that no column of docs has
    marked = docs.withColumn(mark, F.sha2(folded(column(docs, text_col)), 256))
    return marked.join(kept, column(marked, id_col).eqNullSafe(kept["kept"]) & (column(marked, mark) == kept["sha"]), "left_semi").dropDuplicates([id_col, mark]).drop(mark)
