"""Mixing sources to target weights: a low-discrepancy schedule of sources joined with shuffled blocks of equal token counts."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.llm.common import WORD, column, running, small, stored

#: Sources, in order, weigh 1, 2, 3, 1, 2, 3, ...; a target is at most CAP times the source's size.
WEIGHTS = 3
CAP = 3
#: Usual words of a block, least number of blocks of a mix (then blocks get shorter), and most (then longer).
BLOCK, LEAST_BLOCKS, MOST_BLOCKS = 2048, 4096, 1 << 22
#: 2**32 divided by the golden ratio, odd: its multiples modulo 2**32 are the golden-ratio points.
GOLDEN = 2654435769
#: Cells of the unit interval in which points meet the sources' intervals.
CELLS = 1024


@dataclass(frozen=True)
class Mix:
    """A planned mix. All tables are stored.

    ``placed``: doc_id, source, skey, size, at (the document's place in its source's shuffled stream).
    ``sources``: source, skey, source_size, weight, target, quota (whole words to take).
    ``slots``: skey, block, slot (when a block of a source is due).
    """

    placed: DataFrame
    sources: DataFrame
    slots: DataFrame
    block: int


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``skey`` (the source, never null) and ``size`` (words) of every row."""
    source = column(docs, source_col).cast("string")
    return docs.select(
        column(docs, id_col).cast("long").alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("skey"),
        F.coalesce(F.regexp_count(column(docs, text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def _sorted_parts(df: DataFrame, *order) -> DataFrame:
    """Range-partitioned by ``order``, with the number of the part: blocks for a running sum over a whole table."""
    return stored(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "parts")


def targets(sized: DataFrame) -> DataFrame:
    """Target words of each source: all words shared by weight, none above CAP times its size, the excess shared again.

    Sources ordered by size / weight: the capped ones are the first of that order, and one running sum finds where they end.
    """
    by_source = sized.groupBy("source", "skey").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranked = running(_sorted_parts(by_source, *order), [], "part", order, F.lit(1), "rank")
    weighed = ranked.drop("part").withColumn("weight", F.col("rank") % WEIGHTS + 1).withColumn("cap", CAP * F.col("source_size"))
    level = [F.col("cap") * (F.lit(6) / F.col("weight")).cast("long"), F.col("rank")]  # cap / weight in whole numbers: 6 = lcm(1, 2, 3)
    parts = _sorted_parts(weighed, *level)
    words, weight = parts.agg(F.sum("source_size"), F.sum("weight")).first()
    if words is None:
        return parts.select("source", "skey", "source_size", "weight", "rank", F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("quota"))
    running_sums = running(running(parts, [], "part", level, F.col("cap"), "caps"), [], "part", level, F.col("weight"), "weights")
    wide = lambda c: F.col(c).cast("decimal(20,0)") if isinstance(c, str) else F.lit(c).cast("decimal(18,0)")
    capped = wide("cap") * (wide(weight) - wide("weights")) < (wide(words) - wide("caps")) * wide("weight")
    marked = stored(running_sums.withColumn("capped", capped), "sources")
    fixed, open_weight = marked.agg(F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)), F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight")))).first()
    share = F.lit(words - fixed) * F.col("weight")
    parts_of = F.lit(open_weight or 1)
    return marked.select(
        "source", "skey", "source_size", "weight", "rank",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share.cast("double") / parts_of.cast("double")).alias("target"),
        F.when(F.col("capped"), F.col("cap")).otherwise(F.floor((share - share % parts_of) / parts_of).cast("long")).alias("quota"))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """``skey``, ``block``, ``slot``: the i-th golden-ratio point falls into one source's interval of the cumulative weights and
    calls that source's next block. A few blocks that the points have not called by then are left to the end of the mix."""
    shares = sources.withColumn("blocks", F.ceil(F.col("quota") / block)).where("blocks > 0").select("skey", "rank", "blocks")
    order = [F.col("rank")]
    spans = stored(running(_sorted_parts(shares, *order), [], "part", order, F.col("blocks"), "begin"), "spans")
    total = spans.agg(F.sum("blocks")).first()[0] or 0
    point = F.shiftrightunsigned((F.col("id") * GOLDEN).bitwiseAND(F.lit(0xFFFFFFFF)) * total, 32)
    points = sources.sparkSession.range(total + total // 8 + 64 if total else 0).select(F.col("id").alias("slot"), point.alias("point"))
    cell = lambda c: F.floor(c * CELLS / max(total, 1))
    cells = spans.select("skey", "blocks", "begin", F.explode(F.sequence(cell(F.col("begin")), cell(F.col("begin") + F.col("blocks") - 1))).alias("cell"))
    called = (points.withColumn("cell", cell(F.col("point"))).join(cells, "cell")
              .where((F.col("point") >= F.col("begin")) & (F.col("point") < F.col("begin") + F.col("blocks"))).select("skey", "blocks", "slot"))
    ranked = running(stored(called.withColumn("part", F.col("slot").bitwiseAND(F.lit(~0xFFFF))), "called"), ["skey"], "part", [F.col("slot")], F.lit(1), "block")
    return ranked.where("block < blocks").select("skey", "block", "slot")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int | None = None) -> Mix:
    """Plan the mix of all ``docs``. The text is read once, for its number of words; only ids, sources and sizes are shuffled.

    A null text has no words, a null source is a source of its own and the last, null ids and repeated rows are documents like
    any other; the order inside a source is a hash of the id, then id and size, so reruns agree. An empty table, or one
    without words, gives targets of 0 and takes nothing. Other columns are ignored.
    """
    sized = stored(sizes(docs, id_col, text_col, source_col), "sizes")
    sources = stored(targets(sized), "targets")
    rows, words = sized.agg(F.count(F.lit(1)), F.sum("size")).first()
    words = words or 0
    block = block or max(1, ceil(words / MOST_BLOCKS), min(BLOCK, words // LEAST_BLOCKS))
    digits = next(k for k in range(1, 9) if k == 8 or rows <= 16**k * 2000)  # parts of a source's stream: at most about 2000 documents
    mixed = sized.withColumn("mixed", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    order = [F.col("mixed"), F.col("doc_id"), F.col("size")]
    placed = running(mixed.withColumn("part", F.substring("mixed", 1, digits)), ["skey"], "part", order, F.col("size"), "at")
    return Mix(stored(placed.select("doc_id", "source", "skey", "size", "at"), "placed"), sources, stored(schedule(sources, block), "slots"), block)


def pieces(mix: Mix) -> DataFrame:
    """The mix: ``slot``, ``skey``, ``block``, ``doc_id``, ``at``, ``from_word``, ``words``: which words of which document come when.

    A source's stream repeats until its quota is full. A block is a run of words of the stream, so all blocks are equally long
    and the join with the slots has no hot key.
    """
    b = mix.block
    taken = mix.placed.where("size > 0").join(small(mix.sources.select("skey", "source_size", "quota"), 100_000), "skey").where("at < quota")
    rounds = taken.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1 - F.col("at")) / F.col("source_size")))))
    spans = rounds.withColumn("begin", F.col("round") * F.col("source_size") + F.col("at")).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("quota")))
    cut = (spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / b), F.floor((F.col("end") - 1) / b))))
           .withColumn("low", F.greatest("begin", F.col("block") * b)).withColumn("high", F.least("end", (F.col("block") + 1) * b)))
    return (cut.join(mix.slots, ["skey", "block"], "left")
            .select("slot", "skey", "block", "doc_id", "at", (F.col("low") - F.col("begin")).alias("from_word"), (F.col("high") - F.col("low")).alias("words")))


def taken(mix: Mix) -> DataFrame:
    """Per document: ``doc_id``, ``source``, ``skey``, ``size``, ``source_size``, ``target``, ``taken`` and ``first_slot`` (null: not in the mix, or last)."""
    used = pieces(mix).groupBy("skey", "at").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    with_words = mix.placed.where("size > 0").join(used, ["skey", "at"], "left")
    rows = with_words.unionByName(mix.placed.where("size = 0").withColumns({"taken": F.lit(None).cast("long"), "first_slot": F.lit(None).cast("long")}))
    return (rows.join(small(mix.sources.select("skey", "source_size", "target"), 100_000), "skey")
            .select("doc_id", "source", "skey", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot"))
