"""Helpers shared by the training-data operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from proofloom.session import stored  # noqa: F401  (for the operators)

#: What separates words in the contracts that count by spaces: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Upper-case ASCII and its lower case; other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of fixed-width keys that may be broadcast (16 bytes each, so 16 MB).
BROADCAST_ROWS = 1_000_000


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return df["`" + name.replace("`", "``") + "`"]


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table of short keys for broadcast if its counted size allows; else the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def running(df: DataFrame, keys: list[str], block: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same ``keys`` that come before, by (``block``, ``order``).

    Two levels: sums per block are combined before the shuffle and cumulated over the few blocks of a key; inside, each block
    is a group of its own. So a key that owns a third of all rows is still split into as many tasks as it has blocks.
    """
    sums = df.groupBy(*keys, block).agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, block, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = W.partitionBy(*keys, block).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (df.join(starts, [*keys, block])
            .withColumn(name, F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__start"))


def _fingerprint(edges: DataFrame) -> tuple:
    """Count and order-free checksum of a table of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long, a != b): ``node`` and ``root``, the smallest node reachable.

    Alternating large-star and small-star steps: each edge is rewired to the smallest neighbour of its end until all
    components are stars. Minima are aggregated before the shuffle; each round is a written table. Nodes without links are not
    in the result. An empty input gives an empty result.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    seen = _fingerprint(edges)
    while seen[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every edge now leads down (u > v): hang the smaller neighbours of u, and u itself, on the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(hung.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
