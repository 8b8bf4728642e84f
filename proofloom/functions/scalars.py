"""Scalar conversions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofloom.functions.spans import let, strip
from proofloom.rules import fixed as R


def lookup(key: Column, table: dict) -> Column:
    """Value of a small fixed table, null when the key is unknown."""
    items = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*items), key)


def cn_num_to_int(text: Column) -> Column:
    """Chinese numeral 1-20 to a number, 0 otherwise."""
    return F.coalesce(lookup(text, {cn: i + 1 for i, cn in enumerate(R.CN_NUMERALS)}), F.lit(0))


def int_to_cn_num(n: Column) -> Column:
    """Number 1-20 to a Chinese numeral, digits otherwise."""
    return F.coalesce(lookup(n.cast("int"), {i + 1: cn for i, cn in enumerate(R.CN_NUMERALS)}), n.cast("string"))


def plain_number(digits: Column) -> Column:
    """Digits without leading zeros, full-width digits folded."""
    return F.regexp_replace(F.translate(digits, R.FULLWIDTH_DIGITS, "0123456789"), r"^0+(?=\d)", "")


#: A cited range of more numbers than this is not written out: its two ends stand for it.
WRITTEN_RANGE = 10_000


def citation_ranges(text: Column) -> Column:
    """``1,3-5`` -> ``[{1, 1}, {3, 5}]``; a falling range is left out."""
    num = lambda p, i: plain_number(F.regexp_extract(p, r"(?U)^(\d+)[–\-](\d+)", i)).try_cast("int")

    def one(p: Column) -> Column:
        part = F.trim(p)
        single = plain_number(part).try_cast("int")
        ends = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
        return F.when(part.rlike(r"(?U)^\d+[–\-]\d+"), ends(num(part, 1), num(part, 2))).when(part.rlike(r"(?U)^\d+$"), ends(single, single))

    return F.filter(F.transform(F.split(text, "[,，]", -1), one), lambda r: r["low"] <= r["high"])


def parse_citation_numbers(text: Column) -> Column:
    """``1,3-5`` -> ``[1, 3, 4, 5]``; a falling range is empty, one of more than ``WRITTEN_RANGE`` numbers gives its ends."""
    short = lambda r: r["high"] - r["low"] < WRITTEN_RANGE
    return F.flatten(F.transform(citation_ranges(text), lambda r: F.when(
        short(r), F.sequence(r["low"], F.when(short(r), r["high"]).otherwise(r["low"]))).otherwise(F.array(r["low"], r["high"]))))


def range_pieces(low: Column, high: Column) -> Column:
    """``low..high`` (not negative) as at most 62 aligned blocks of 2^level numbers: ``array<struct<level, block>>``.

    A number is in the range if the block it is in, at one of the levels, is among them: so ranges meet numbers by equality.
    """
    empty = F.array().cast("array<struct<level:int,block:int>>")
    start = F.struct(low.cast("long").alias("a"), (high.cast("long") + 1).alias("b"), empty.alias("out"))

    def step(acc: Column, level: Column) -> Column:
        a, b = acc["a"], acc["b"]
        piece = lambda at: F.array(F.struct(level.alias("level"), at.cast("int").alias("block")))
        left, right = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
        out = F.concat(acc["out"], F.when(left, piece(a)).otherwise(empty), F.when(right & ~(left & (a + 1 == b)), piece(b - 1)).otherwise(empty))
        return F.struct(F.shiftright(a + 1, 1).alias("a"), F.shiftright(b, 1).alias("b"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), start, step, lambda acc: acc["out"])


def fingerprint(text: Column, n: int = 40) -> Column:
    """First ``n`` characters, trimmed: identifies a paragraph."""
    return strip(F.substring(F.coalesce(text, F.lit("")), 1, n))


# --- formatting --------------------------------------------------------------

def cn_size_to_pt(text: Column) -> Column:
    """Named size or ``12pt`` / ``12磅`` / ``12`` to points."""
    def read(t: Column) -> Column:
        clean = strip(F.regexp_replace(t, "[字号]", ""))
        number = F.regexp_extract(t, r"(?iU)^(\d+(?:\.\d+)?)\s*(?:pt|磅|磅值)?$", 1).try_cast("double")
        return F.coalesce(lookup(t, R.CN_SIZES), lookup(clean, R.CN_SIZES), number)

    return let(strip(text), read)


def pt_to_cn_size(pt: Column) -> Column:
    """Nearest named size within 0.3 points, first listed on a tie."""
    sizes = F.array(*[F.struct(F.lit(v).alias("pt"), F.lit(k).alias("name")) for k, v in R.CN_SIZES.items()])
    ranked = F.transform(sizes, lambda s, i: F.struct(F.abs(s["pt"] - pt).alias("d"), i.alias("i"), s["name"].alias("name")))
    return let(F.array_min(ranked), lambda b: F.when((b["d"] < 0.3) | (b["d"] == 0), b["name"]))


def parse_alignment(text: Column) -> Column:
    return lookup(F.lower(strip(text)), R.ALIGNMENTS)


def parse_page_number_format(text: Column) -> Column:
    return lookup(F.lower(strip(text)), R.PAGE_NUMBER_FORMATS)


def parse_line_spacing(text: Column) -> Column:
    """``struct<type, value>`` of a line spacing phrase; null fields when unknown."""
    number = lambda t, regex: F.regexp_extract(t, regex, 1).try_cast("double")

    def parts(t: Column) -> Column:
        exact = F.coalesce(number(t, r"(?U)^固定值\s*(\d+(?:\.\d+)?)\s*磅?"), number(t, r"(?U)^(\d+(?:\.\d+)?)\s*磅"))
        return F.struct(exact.alias("exact"), number(t, r"(?U)^(\d+(?:\.\d+)?)\s*倍").alias("times"),
                        F.contains(t, F.lit("单倍")).alias("one"), F.contains(t, F.lit("双倍")).alias("two"))

    def read(p: Column) -> Column:
        times = p["times"]
        named = F.when(times == 1.0, "single").when(times == 1.5, "one_point_five").when(times == 2.0, "double").otherwise("multiple")
        kind = F.when(p["exact"].isNotNull(), "exact").when(p["one"], "single").when(p["two"], "double").when(times.isNotNull(), named)
        value = F.when(p["exact"].isNotNull(), p["exact"]).when(p["one"], 1.0).when(p["two"], 2.0).otherwise(times)
        return F.struct(kind.alias("type"), value.alias("value"))

    return let(let(strip(text), parts), read)


def parse_margin_cm(text: Column) -> Column:
    t = strip(text)
    regex = r"(?iU)^(\d+(?:\.\d+)?)\s*(cm|毫米|mm)"
    value = F.regexp_extract(t, regex, 1).try_cast("double")
    return F.when(F.lower(F.regexp_extract(t, regex, 2)).isin("mm", "毫米"), value / 10.0).otherwise(value)


def paper_size(width_cm: Column, height_cm: Column) -> Column:
    """Known paper within half a centimetre in either direction, else ``WxHcm``."""
    near = lambda a, b: F.abs(a - b) < R.PAPER_TOLERANCE_CM
    hits = [
        F.when((near(width_cm, F.lit(w)) & near(height_cm, F.lit(h))) | (near(width_cm, F.lit(h)) & near(height_cm, F.lit(w))), F.lit(name))
        for name, w, h in R.PAPER_SIZES]
    return F.coalesce(*hits, F.format_string("%.1fx%.1fcm", width_cm, height_cm))


def detect_doc_type(text: Column) -> Column:
    low, out = F.lower(text), F.lit("general")
    for name, words in reversed(R.DOC_TYPE_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


# --- time --------------------------------------------------------------------

def period_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def next_reset(ts: Column) -> Column:
    """Start of the following month."""
    return F.date_trunc("month", ts) + F.expr("INTERVAL 1 MONTH")


def parse_iso_ts(text: Column) -> Column:
    """ISO time; ``Z`` or no zone means UTC, anything else bad is null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(t))
