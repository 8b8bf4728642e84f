"""Match positions inside text, built from Spark SQL functions only.

Spark has no function that returns every regex match with its offset.  The
matches and the gaps between them come from two built-ins, and the offset of a
match is the summed length of everything before it.  Positions count code
points from 0, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside a higher-order function.

    A column captured by a lambda is evaluated again for each element; going
    through a one-element array evaluates it once per row.
    """
    return F.transform(F.array(value), body)[0]


def scan(items: Column, state: Column, out_type: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Fold an array in order and return what each item gives: ``step(state, item)`` is (next state, output).

    Items are taken in runs of 64 and the outputs of a run are appended at once, so long arrays are not copied item by item.
    """
    def one(acc: Column, item: Column) -> Column:
        after, given = step(acc["s"], item)
        return F.struct(after.alias("s"), F.concat(acc["out"], F.array(given)).alias("out"))

    def run(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["s"].alias("s"), F.array().cast(f"array<{out_type}>").alias("out")), one)
        return let(inner, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def parts(xs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _STEP).cast("int")), lambda k: F.slice(xs, k * _STEP + 1, F.lit(_STEP)))
        begin = F.struct(state.alias("s"), F.array().cast(f"array<array<{out_type}>>").alias("out"))
        return F.when(F.size(xs) > 0, F.flatten(F.aggregate(runs, begin, run, lambda a: a["out"]))).otherwise(F.array().cast(f"array<{out_type}>"))

    return let(items, parts)


def _prefix_sum(lens: Column, i: Column) -> Column:
    """Sum of ``lens[0..i-1]``; whole steps first so long arrays stay cheap."""
    zero = F.lit(0)
    plus = lambda a, b: a + b
    whole = F.floor(i / F.lit(_STEP)).cast("int")
    return (
        F.aggregate(F.slice(lens["steps"], F.lit(1), whole), zero, plus)
        + F.aggregate(F.slice(lens["lens"], whole * _STEP + 1, i - whole * _STEP), zero, plus)
    )


def _with_steps(lens: Column) -> Column:
    """``struct(lens, steps)``: lengths and their sums per run of 64."""
    def steps(v: Column) -> Column:
        n = F.floor(F.size(v) / F.lit(_STEP)).cast("int")
        empty = F.array().cast("array<int>")
        return F.when(
            n > 0,
            F.transform(
                F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                lambda b: F.aggregate(F.slice(v, b * _STEP + 1, F.lit(_STEP)), F.lit(0), lambda a, x: a + x),
            ),
        ).otherwise(empty)

    return let(lens, lambda v: F.struct(v.alias("lens"), steps(v).alias("steps")))


def _locate(matches: Column, gaps: Column) -> Column:
    parts = F.struct(matches.alias("m"), gaps.alias("g"))

    def starts(p: Column) -> Column:
        lens = F.transform(p["m"], lambda m, i: F.length(m) + F.length(p["g"][i]))
        return let(
            _with_steps(lens),
            lambda v: F.transform(
                p["m"],
                lambda m, i: F.struct(
                    m.alias("hit"),
                    (_prefix_sum(v, i) + F.length(p["g"][i])).alias("start"),
                    (_prefix_sum(v, i) + F.length(p["g"][i]) + F.length(m)).alias("end"),
                ),
            ),
        )

    return let(parts, starts)


def spans(text: Column, regex: str, mark: str = "") -> Column:
    """All matches of a Java regex as ``array<struct<hit, start, end>>``. ``mark``: a piece that every match holds, looked for first."""
    pattern = F.lit(regex)
    found = _locate(F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, regex, -1))
    empty = F.array().cast("array<struct<hit:string,start:int,end:int>>")
    return F.when(F.contains(text, F.lit(mark)) & text.rlike(regex) if mark else text.rlike(regex), found).otherwise(empty)


def literal_spans(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a plain word held in a column."""
    quoted = F.concat(F.lit("\\Q"), word, F.lit("\\E"))

    def build(p: Column) -> Column:
        hits = F.slice(p["g"], F.lit(1), F.size(p["g"]) - 1)
        lens = F.transform(hits, lambda g: F.length(g) + F.length(p["w"]))
        return let(
            _with_steps(lens),
            lambda v: F.transform(
                hits,
                lambda g, i: F.struct(
                    p["w"].alias("hit"),
                    (_prefix_sum(v, i) + F.length(g)).alias("start"),
                    (_prefix_sum(v, i) + F.length(g) + F.length(p["w"])).alias("end"),
                ),
            ),
        )

    return let(F.struct(F.split(text, quoted, -1).alias("g"), word.alias("w")), build)


def char_at(text: Column, pos: Column) -> Column:
    """Character at a 0-based position, empty string outside the text."""
    return F.when(pos < 0, F.lit("")).otherwise(F.substring(text, pos + 1, F.lit(1)))


def clip(text: Column, start: Column, end: Column) -> Column:
    """``text[max(0, start):end]``."""
    begin = F.greatest(F.lit(0), start)
    return F.substring(text, begin + 1, F.greatest(end - begin, F.lit(0)))


#: What ``(?U)\s`` matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Trim all Unicode white space on both sides."""
    return F.btrim(text, F.lit(WHITE))
