"""Ordered computations that hold when one key owns much of the table.

A plain window gives each key to one task.  Here the rows of a key are cut into
blocks that follow the order, the window runs inside a block, and one small row
per block carries the state across blocks.  ``blocks`` are columns (or
expressions) that never decrease along ``order``.  Keys are not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofloom.session import stored

BLOCK = 8192
#: Rows that one task sorts where the number of tasks follows the input.
TASK_ROWS = 250_000


def index_block(column: str = "element_index", size: int = BLOCK) -> Column:
    return F.floor(F.col(column) / F.lit(size)).cast("long")


def range_blocks(df: DataFrame, keys, order, name: str = "__block", parts: int = 0) -> DataFrame:
    """``df``, stored, with ``name``: the number of the range of (``keys``, ``order``) a row is in.

    Ranges hold about as many rows each, whatever the keys, so a hot key spans many of them, also where its rows bunch in time.
    ``parts``: number of ranges, 0 for as many as a shuffle has.
    """
    by = [*keys, *order]
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return stored(ranged.withColumn(name, F.spark_partition_id()), "ranges")


def _blocked(df: DataFrame, keys, blocks):
    names = [f"__b{i}" for i in range(len(blocks))]
    for name, expr in zip(names, blocks):
        df = df.withColumn(name, expr)
    return df, names


def dealt(df: DataFrame, parts: int, *by) -> DataFrame:
    """``df`` in ``parts`` tasks by ``by``; 0 leaves it to the session."""
    return df.repartition(parts, *by) if parts else df


def parts_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Tasks that take about ``rows`` rows each, or 0 if a shuffle of the session has as many. The rows of a table as read or
    stored are counted by the footers of its files."""
    parts = -(-df.count() // rows)
    return parts if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0


def hot_key(df: DataFrame, key: Column, rows: int = TASK_ROWS, groups: int = 4096) -> bool:
    """Whether one ``key`` may own more than ``rows`` rows of ``df``, told by the counts of hashed groups of keys: a group of many
    small keys has about as many rows as the others, a hot key lifts its own. Without one, a plain window by key is balanced."""
    counts = df.groupBy(F.pmod(F.xxhash64(key), F.lit(groups)).alias("g")).count().agg(F.sum("count"), F.max("count")).first()
    return counts[0] is not None and counts[1] > 2 * (counts[0] // groups) + rows


def _carry(df: DataFrame, inside: DataFrame, keys, names, totals, carries, parts: int = 0) -> DataFrame:
    """``inside`` (the rows of ``df`` with their windows inside the block) with what the blocks before carry in."""
    per_block = df.groupBy(*keys, *names).agg(*totals)
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    per_block = dealt(per_block.select(*keys, *names, *[c(before) for c in carries]), parts, *keys, *names)
    # Same hash keys as the window inside the block, so the big side moves once, and its order serves the join, so it is sorted once. With
    # many short keys the small rows are as many as the keys, so they are never sent through the driver.
    return inside.join(per_block.hint("merge"), [*keys, *names])


def running_sum(df: DataFrame, keys, order, blocks, parts: int = 0, **values: Column) -> DataFrame:
    """Add running totals (current row included), one column per ``values`` item. ``parts``: tasks to deal the rows to, 0 for the session's."""
    keys = list(keys)
    work, names = _blocked(df, keys, blocks)
    for out, expr in values.items():
        work = work.withColumn(f"__v_{out}", F.coalesce(expr, F.lit(0)))
    carries = [
        (lambda w, o=out: F.sum(f"__t_{o}").over(w).alias(f"__c_{o}")) for out in values
    ]
    totals = [F.sum(f"__v_{out}").alias(f"__t_{out}") for out in values]
    window = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt(work, parts, *keys, *names).select("*", *[F.sum(f"__v_{out}").over(window).alias(f"__i_{out}") for out in values])
    work = _carry(work, inside, keys, names, totals, carries, parts)
    return work.select(*df.columns, *[(F.coalesce(F.col(f"__c_{out}"), F.lit(0)) + F.col(f"__i_{out}")).alias(out) for out in values])


def last_seen(df: DataFrame, keys, order, blocks, include_current: bool = True, **values: Column) -> DataFrame:
    """Add the latest non-null value of each expression along the order."""
    keys = list(keys)
    work, names = _blocked(df, keys, blocks)
    for out, expr in values.items():
        work = work.withColumn(f"__v_{out}", expr)
    pos = F.struct(*order)
    totals = [
        F.max_by(F.col(f"__v_{out}"), F.when(F.col(f"__v_{out}").isNotNull(), pos)).alias(f"__t_{out}")
        for out in values
    ]
    carries = [
        (lambda w, o=out: F.last(f"__t_{o}", ignorenulls=True).over(w).alias(f"__c_{o}")) for out in values
    ]
    end = 0 if include_current else -1
    window = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    inside = work.select("*", *[F.last(f"__v_{out}", ignorenulls=True).over(window).alias(f"__i_{out}") for out in values])
    work = _carry(work, inside, keys, names, totals, carries)
    return work.select(*df.columns, *[F.coalesce(f"__i_{out}", f"__c_{out}").alias(out) for out in values])


def previous(df: DataFrame, keys, order, blocks, **values: Column) -> DataFrame:
    """Add the value of each expression on the row just before (like ``lag``)."""
    boxed = {out: F.struct(expr.alias("v")) for out, expr in values.items()}
    seen = last_seen(df, keys, order, blocks, include_current=False, **boxed)
    return seen.select(*df.columns, *[F.col(out)["v"].alias(out) for out in values])


def following(df: DataFrame, keys, order, blocks, **values: Column) -> DataFrame:
    """Add the value of each expression on the row just after (like ``lead``)."""
    keys = list(keys)
    work, names = _blocked(df, keys, blocks)
    for out, expr in values.items():
        work = work.withColumn(f"__v_{out}", F.struct(expr.alias("v")))
    pos = F.struct(*order)
    totals = [F.min_by(F.col(f"__v_{out}"), pos).alias(f"__t_{out}") for out in values]
    per_block = work.groupBy(*keys, *names).agg(*totals)
    across = Window.partitionBy(*keys).orderBy(*names)
    per_block = per_block.select(
        *keys, *names, *[F.lead(f"__t_{out}").over(across).alias(f"__c_{out}") for out in values]
    )
    window = Window.partitionBy(*keys, *names).orderBy(*order)
    inside = work.select("*", *[F.lead(f"__v_{out}").over(window).alias(f"__i_{out}") for out in values])
    work = inside.join(per_block.hint("merge"), [*keys, *names])
    return work.select(*df.columns, *[F.coalesce(f"__i_{out}", f"__c_{out}")["v"].alias(out) for out in values])


def numbered(df: DataFrame, keys, order, blocks, name: str, start: int = 0, parts: int = 0) -> DataFrame:
    """Dense position of each row within its key, counted from ``start``."""
    out = running_sum(df, keys, order, blocks, parts, **{name: F.lit(1)})
    return out.withColumn(name, (F.col(name) - 1 + start).cast("int"))


def first_per(df: DataFrame, keys, order) -> DataFrame:
    """First row per key.  An aggregate, so it combines before the shuffle."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    )
    return best.select(*keys, *[F.col("__first")[c].alias(c) for c in rest]).select(*df.columns)


def latest_per(df: DataFrame, keys, order) -> DataFrame:
    """Last row per key by ``order`` (aggregate twin of :func:`first_per`)."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return best.select(*keys, *[F.col("__last")[c].alias(c) for c in rest]).select(*df.columns)


def top_per(df: DataFrame, keys, order, n: int) -> DataFrame:
    """First ``n`` rows per key; Spark limits each input partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
