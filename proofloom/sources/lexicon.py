"""Typo lexicons: reading, layering and matching.

A lexicon is a table ``(wrong, right, note, layer, priority)``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.functions.ordered import first_per, latest_per
from proofloom.functions.spans import let, literal_spans, strip
from proofloom.operators.issues import issue_rows
from proofloom.rules.fixed import COMMON_WORD_FIXES, IDIOM_FIXES

LEXICON_COLUMNS = ["wrong", "right", "note", "layer", "priority"]


def valid_entry(wrong: Column, right: Column) -> Column:
    return (F.length(wrong) >= 2) & (F.length(right) > 0) & (wrong != right) & ~F.contains(right, F.lit("/"))


def builtin_lexicon(spark: SparkSession) -> DataFrame:
    rows = []
    for layer, priority, fixes in (("curated", 1, COMMON_WORD_FIXES), ("idiom", 2, IDIOM_FIXES)):
        rows += [(*fix, layer, priority) for fix in fixes]
    df = spark.createDataFrame(rows, "wrong string, right string, note string, layer string, priority int")
    return df.filter(valid_entry(F.col("wrong"), F.col("right")))


def lexicon_lines(lines: DataFrame, layer: str, priority: int, line: str = "line") -> DataFrame:
    """Tab-separated lines -> lexicon rows; comments, blanks and bad rows drop out.

    When a word occurs twice the later line (by ``line_no``) wins.
    """
    parts = lines.select("line_no", strip(F.col(line)).alias("t")).filter(
        (F.length("t") > 0) & ~F.startswith("t", F.lit("#"))
    ).select("line_no", F.split("t", "\t", -1).alias("p")).filter(F.size("p") >= 2)
    rows = parts.select(
        "line_no", strip(F.col("p")[0]).alias("wrong"), strip(F.col("p")[1]).alias("right"),
        F.when(F.size("p") >= 3, strip(F.get(F.col("p"), F.lit(2)))).otherwise(F.lit("")).alias("note"),
    ).filter(valid_entry(F.col("wrong"), F.col("right")))
    default = F.concat(F.lit("'"), "wrong", F.lit("'应为'"), "right", F.lit("'"))
    rows = rows.withColumn("note", F.when(F.length("note") > 0, F.col("note")).otherwise(default))
    latest = latest_per(rows, ["wrong"], ["line_no"])
    return latest.select("wrong", "right", "note", F.lit(layer).alias("layer"), F.lit(priority).alias("priority"))


def _line_order() -> Column:
    """Orders lines by file name, then place in the file: the split's offset, then the line inside the split."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n"))


def read_lexicon(spark: SparkSession, path: str, layer: str = "common", priority: int = 3) -> DataFrame:
    """Lexicon files of ``wrong<TAB>right<TAB>note`` lines; a later line, or file by name, wins."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), _line_order().alias("line_no"))
    return lexicon_lines(lines, layer, priority)


def pair_lines(lines: DataFrame, min_count: int = 2, line: str = "line") -> DataFrame:
    """``wrong<TAB>right<TAB>count`` lines, kept when seen often enough."""
    parts = lines.select("line_no", strip(F.col(line)).alias("t")).filter(
        (F.length("t") > 0) & ~F.startswith("t", F.lit("#"))
    ).select("line_no", F.split("t", "\t", -1).alias("p")).filter(F.size("p") >= 3)
    rows = parts.select(
        "line_no", F.col("p")[0].alias("wrong"), F.col("p")[1].alias("right"),
        F.expr("try_cast(trim(get(p, 2)) AS INT)").alias("cnt"),
    ).filter((F.col("cnt") >= min_count) & valid_entry(F.col("wrong"), F.col("right")))
    latest = latest_per(rows, ["wrong"], ["line_no"])
    note = F.concat(F.lit("SIGHAN 衍生（出现 "), F.col("cnt").cast("string"), F.lit(" 次，仅供参考）"))
    return latest.select("wrong", "right", note.alias("note"), F.lit("pairs").alias("layer"), F.lit(0).alias("priority"))


def read_pairs(spark: SparkSession, path: str, min_count: int = 2) -> DataFrame:
    lines = spark.read.text(path).select(F.col("value").alias("line"), _line_order().alias("line_no"))
    return pair_lines(lines, min_count)


def merge_layers(*layers: DataFrame) -> DataFrame:
    """One row per word: the highest priority wins, pairs only fill gaps."""
    merged = layers[0].select(*LEXICON_COLUMNS)
    for layer in layers[1:]:
        merged = merged.unionByName(layer.select(*LEXICON_COLUMNS))
    return first_per(merged.withColumn("__o", -F.col("priority")), ["wrong"], ["__o", "right", "note"]).drop("__o")


def grams(text: Column, n: int) -> Column:
    """Distinct ``n``-character pieces of the text; one pass over it."""
    piece = lambda c: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0))), lambda i: F.array_join(F.slice(c, i + 1, F.lit(n)), ""))
    return F.array_distinct(let(F.split(text, ""), piece))


#: Lexicons of up to this many words are sent to all tasks instead of shuffling the pieces of the text.
SENT_WORDS = 100_000


#: Words of a lexicon that are looked for in the whole text first.
LOOKED_FOR = 1_000


def _any_of(words: list[str]) -> str:
    """A regex that finds any of the words. Their first characters are halved by ranges, so a place costs about log2 of the words."""
    if not words or not all(words):
        return "(?!)" if not words else ""

    def tree(ws: list[str]) -> str:
        firsts = sorted({w[0] for w in ws})
        if len(firsts) < 4:
            return "(?:" + "|".join(map(re.escape, ws)) + ")"
        halves = firsts[: len(firsts) // 2], firsts[len(firsts) // 2:]
        return "(?:" + "|".join(f"(?=[{re.escape(h[0])}-{re.escape(h[-1])}]){tree([w for w in ws if h[0] <= w[0] <= h[-1]])}" for h in halves) + ")"

    return tree(sorted(set(words)))


def typo_hits(elements: DataFrame, lexicon: DataFrame, gram: int = 2) -> DataFrame:
    """Every lexicon word in every element, with positions.

    Text is cut to distinct pieces of up to ``gram`` characters, so the lexicon
    is met by an equi-join on word starts rather than by trying each word on
    each text.  A word shorter than ``gram`` is its own start; entries have at
    least two characters. The words are counted first: Spark knows no size of rows made in the driver, and would move every
    piece of every text to them.
    """
    words = lexicon.select("wrong", "right", "note", F.substring("wrong", 1, gram).alias("start"))
    few = [r.wrong for r in words.select("wrong").filter("wrong IS NOT NULL").limit(max(LOOKED_FOR, 0) + 1).collect()]
    if len(few) <= LOOKED_FOR:  # an element without any word leaves before it is cut
        elements = elements.filter(F.col("content").rlike(_any_of(few)))
    words = F.broadcast(words) if words.limit(SENT_WORDS + 1).count() <= SENT_WORDS else words
    pieces = F.array_distinct(F.concat(*[grams(F.col("content"), n) for n in range(min(2, gram), gram + 1)]))
    found = elements.filter(F.length("content") >= min(2, gram)).select("*", F.explode(pieces).alias("start"))
    found = found.join(words, "start").filter(F.contains("content", F.col("wrong")))
    return found.withColumn("s", F.explode(literal_spans(F.col("content"), F.col("wrong")))).drop("start")


def typo_issues(elements: DataFrame, lexicon: DataFrame, gram: int = 2) -> DataFrame:
    h = typo_hits(elements, lexicon, gram)
    note = F.when(F.length("note") > 0, F.concat(F.lit("。"), F.col("note"))).otherwise(F.lit(""))
    return issue_rows(
        h, "typo.common_dict", {"wrong": F.col("wrong"), "right": F.col("right"), "note": note},
        element_index=F.col("element_index"), element_type=F.col("element_type"), location_text=F.col("wrong"),
        start_pos=F.col("s.start"), end_pos=F.col("s.end"), fixable=F.lit(True), fix_type=F.lit("text_replace"))
