"""Rules that look at one element at a time.

Each rule maps an element to ``array<issue>``.  :func:`detect` puts all chosen
rules into one projection and explodes once, so the text is read once and
nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions.spans import char_at, clip, let, spans
from proofloom.operators.issues import element, flag, issue
from proofloom.rules import fixed as R
from proofloom.schemas import ISSUE

Detector = Callable[[SimpleNamespace], Column]


def _sign(regex: str, also: Callable[[Column], Column] | None = None) -> Callable[[Detector], Detector]:
    """Give a rule the regex (and the condition) that every text it finds something in meets. Signs of several rules are looked for
    in one pass, so they hold no flags or numbered groups; ``U`` is set."""
    def add(rule: Detector) -> Detector:
        rule.sign = (regex, also)
        return rule

    return add


def _at(e: SimpleNamespace, s: Column) -> dict[str, Column]:
    return dict(element_index=e.index, element_type=e.type, location_text=s["hit"],
                start_pos=s["start"], end_pos=s["end"])


def _char(text: Column, i: int) -> Column:
    return F.substring(text, i + 1, 1)


def _none() -> Column:
    return F.array().cast(f"array<{ISSUE.simpleString()}>")


def _replace_map(char: Column, table: dict[str, str]) -> Column:
    return F.translate(char, "".join(table), "".join(table.values()))


_MIXED = rf"(?U)[{R.CJK}]\s*[,\.;:\?!](?!\d)"


@_sign(rf"[{R.CJK}](?![{R.CJK}])\s*[,\.;:\?!](?!\d)")
def mixed_punctuation(e: SimpleNamespace) -> Column:
    """ASCII mark after a CJK character, unless a digit follows."""
    found = spans(e.text, _MIXED)

    def build(s: Column) -> Column:
        cjk, mark = _char(s["hit"], 0), F.right(s["hit"], F.lit(1))
        at = _at(e, s) | {"location_text": F.concat(cjk, mark)}
        return issue("format.mixed_punctuation",
                     {"cjk": cjk, "mark": mark, "right": _replace_map(mark, R.MIXED_MARKS)}, **at)

    return F.when(e.type != "reference", F.transform(found, build)).otherwise(_none())


_MARKS = "".join(m[0] for m in R.REPEATED_MARKS)
_DOUBLED = rf"([{_MARKS}])\1"


@_sign(rf"(?<mark>[{_MARKS}])\k<mark>")
def repeat_punctuation(e: SimpleNamespace) -> Column:
    """The same mark twice in a row."""
    found = spans(e.text, _DOUBLED)
    return F.transform(found, lambda s: issue(
        "format.repeat_punctuation", {"hit": s["hit"], "mark": _char(s["hit"], 0)}, **_at(e, s)))


def cjk_ascii_spacing(e: SimpleNamespace) -> Column:
    """CJK next to a Latin letter without a space; at most three per element."""
    found = F.slice(spans(e.text, rf"[{R.CJK}][A-Za-z]|[A-Za-z][{R.CJK}]"), 1, 3)
    return F.transform(found, lambda s: issue(
        "format.cjk_ascii_spacing",
        {"hit": s["hit"], "left": _char(s["hit"], 0), "right": _char(s["hit"], 1)}, **_at(e, s)))


_FULLWIDTH = f"[{R.FULLWIDTH_DIGITS[0]}-{R.FULLWIDTH_DIGITS[-1]}]+"


@_sign(_FULLWIDTH)
def fullwidth_digit(e: SimpleNamespace) -> Column:
    found = spans(e.text, _FULLWIDTH)
    return F.transform(found, lambda s: issue(
        "format.fullwidth_digit",
        {"hit": s["hit"], "half": F.translate(s["hit"], R.FULLWIDTH_DIGITS, "0123456789")}, **_at(e, s)))


_BRACKET = "[" + "".join("\\" + c for p in R.BRACKET_PAIRS for c in p) + "]"


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


@_sign(_BRACKET, lambda text: reduce(lambda a, b: a | b, [_count(text, p[0]) != _count(text, p[1]) for p in R.BRACKET_PAIRS]))
def bracket_pair(e: SimpleNamespace) -> Column:
    """Left and right counts differ for a bracket pair within the element."""
    head = F.concat(F.substring(e.text, 1, 60), F.when(F.length(e.text) > 60, F.lit("...")).otherwise(F.lit("")))
    count = lambda mark: _count(e.text, mark)
    found = []
    for pair in R.BRACKET_PAIRS:
        left, right = pair
        found.append(F.when(count(left) != count(right), issue(
            "format.bracket_pair",
            {"left": F.lit(left), "right": F.lit(right), "lefts": count(left), "rights": count(right)},
            element_index=e.index, element_type=e.type, location_text=head)))
    return F.when(e.text.rlike(_BRACKET), F.array_compact(F.array(*found))).otherwise(_none())


_TWICE = rf"([{R.CJK}])\1"
_TWICE_SIGN = rf"(?<twice>[{R.CJK}])\k<twice>"


@_sign(_TWICE_SIGN)
def repeat_char_3plus(e: SimpleNamespace) -> Column:
    found = spans(e.text, rf"([{R.CJK}])\1{{2,}}")
    return F.transform(found, lambda s: issue(
        "typo.repeat_char_3plus",
        {"n": F.length(s["hit"]), "char": _char(s["hit"], 0), "hit": s["hit"]}, **_at(e, s)))


@_sign(_TWICE_SIGN)
def repeat_char_2(e: SimpleNamespace) -> Column:
    """A CJK character twice, unless legal or a word boundary inside CJK text."""
    is_cjk = lambda c: c.rlike(f"^[{R.CJK}]")

    def keep(s: Column) -> Column:
        ch = _char(s["hit"], 0)
        before, after = char_at(e.text, s["start"] - 1), char_at(e.text, s["end"])
        legal = F.instr(F.lit(R.VALID_DOUBLES), ch) > 0
        longer = (before == ch) | (after == ch)
        edge = (F.instr(F.lit(R.WORD_EDGE_CHARS), ch) > 0) & is_cjk(before) & is_cjk(after)
        return ~legal & ~longer & ~edge

    found = F.filter(spans(e.text, _TWICE), keep)
    return F.transform(found, lambda s: issue(
        "typo.repeat_char_2", {"hit": s["hit"], "char": _char(s["hit"], 0)}, **_at(e, s)))


_GAP = rf"(?U)[{R.CJK}]\s+[{R.CJK}]"


@_sign(rf"[{R.CJK}](?![{R.CJK}])\s+[{R.CJK}]")
def sentence_gap(e: SimpleNamespace) -> Column:
    """One space between CJK characters in running text."""
    def keep(s: Column) -> Column:
        before = char_at(e.text, s["start"] - 1)
        gap = F.substring(s["hit"], F.lit(2), F.length(s["hit"]) - 2)
        after_end = (s["start"] > 0) & (F.instr(F.lit(R.SENTENCE_ENDS), before) > 0)
        return ~after_end & (F.length(F.regexp_replace(gap, r"^[\n\r]+|[\n\r]+\z", "")) <= 1)

    body = (e.type != "heading") & ~flag(e, "exclude_from_format_body") & ~flag(e, "exclude_from_xref_targets")
    long_text = F.regexp_count(e.text, F.lit(f"[{R.CJK}]")) > 20
    found = F.filter(spans(e.text, _GAP), keep)
    hits = F.transform(found, lambda s: issue(
        "format.sentence_gap",
        {"left": _char(s["hit"], 0), "right": F.right(s["hit"], F.lit(1))}, **_at(e, s)))
    return F.when(body & e.text.rlike(_GAP) & long_text, hits).otherwise(_none())


_UG = r"(?iU)(?<![A-Za-z\d])ug/L(?![A-Za-z\d])"
_CELSIUS = r"(?iU)(\d)\s+(°C|℃)"


@_sign(r"(?i:ug/L)")
def unit_ug_per_l(e: SimpleNamespace) -> Column:
    found = spans(e.text, _UG, "/")
    return F.transform(found, lambda s: issue("format.unit.ug_per_l", {}, **_at(e, s)))


@_sign(r"\s(?i:°C|℃)")
def unit_celsius_spacing(e: SimpleNamespace) -> Column:
    found = spans(e.text, _CELSIUS)
    return F.transform(found, lambda s: issue(
        "format.unit.celsius_spacing",
        {"digit": _char(s["hit"], 0), "unit": F.regexp_extract(s["hit"], _CELSIUS, 2)}, **_at(e, s)))


@_sign("的(?:" + "|".join(map(re.escape, R.PREDICATE_VERBS)) + ")")
def de_di_de(e: SimpleNamespace) -> Column:
    """Adverb + 的 + verb, where 地 is meant."""
    regex = rf"([{R.CJK}]{{1,4}})的([{R.CJK}]{{1,2}})"
    before = lambda s: F.regexp_extract(s["hit"], regex, 1)
    after = lambda s: F.regexp_extract(s["hit"], regex, 2)
    found = F.filter(spans(e.text, regex),
                     lambda s: before(s).isin(R.ADVERBS) & after(s).isin(R.PREDICATE_VERBS))
    return F.transform(found, lambda s: issue(
        "typo.de_di_de", {"before": before(s), "after": after(s)},
        element_index=e.index, element_type=e.type, location_text=s["hit"],
        fixable=F.lit(True), fix_type=F.lit("text_replace")))


def _any_word(text: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def _head(text: Column, n: int) -> Column:
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def contradiction(e: SimpleNamespace) -> Column:
    """An opposite word pair before and after a turn marker."""
    def at_marker(marker: str) -> Column:
        pos = F.instr(e.text, F.lit(marker)) - 1
        before = F.substring(e.text, F.lit(1), pos)
        after = F.substring(e.text, pos + len(marker) + 1, F.length(e.text))
        pair = F.coalesce(*[
            F.when(F.contains(before, F.lit(p)) & F.contains(after, F.lit(n)),
                   F.struct(F.lit(p).alias("p"), F.lit(n).alias("n")))
            for p, n in R.OPPOSITES])
        row = let(pair, lambda w: F.when(w.isNotNull(), issue(
            "logic.contradiction.marker_opposite", {"marker": F.lit(marker), "pos": w["p"], "neg": w["n"]},
            element_index=e.index, element_type=e.type,
            location_text=clip(e.text, pos - 20, pos + len(marker) + 30))))
        return F.when(F.contains(e.text, F.lit(marker)), row)

    return F.array_compact(F.array(*[at_marker(m) for m in R.TURN_MARKERS]))


def conclusion_without_data(e: SimpleNamespace) -> Column:
    marker = F.coalesce(*[F.when(F.contains(e.text, F.lit(w)), F.lit(w)) for w in R.CONCLUSION_WORDS])
    bare = ~e.text.rlike(r"(?U)\d") & ~_any_word(e.text, R.DATA_WORDS)
    return F.array_compact(F.array(F.when(marker.isNotNull() & bare, issue(
        "logic.conclusion.no_evidence", {"marker": marker},
        element_index=e.index, element_type=e.type, location_text=_head(e.text, 80)))))


def argument_without_evidence(e: SimpleNamespace) -> Column:
    bad = (
        (e.type == "paragraph") & (F.length(e.text) < 100) & _any_word(e.text, R.OPINION_WORDS)
        & ~_any_word(e.text, R.EVIDENCE_WORDS) & ~e.text.rlike(r"(?U)\d")
    )
    return F.array_compact(F.array(F.when(bad, issue(
        "logic.argument.no_evidence", {}, element_index=e.index, location_text=_head(e.text, 80)))))


def comparison(e: SimpleNamespace) -> Column:
    """A comparison without a clear partner, or two dimensions in one text."""
    compares = _any_word(e.text, R.COMPARE_WORDS)
    single = (F.length(e.text) - F.length(F.replace(e.text, F.lit("比"), F.lit("")))) == 1
    unclear = single & ~_any_word(e.text, ["与", "和", "跟"]) & (F.length(e.text) < 50)
    at = dict(element_index=e.index, location_text=_head(e.text, 60))
    found = [F.when(compares & unclear, issue("logic.comparison.unclear_target", {}, **at))]
    for one, two in R.DIMENSION_PAIRS:
        both = F.contains(e.text, F.lit(one)) & F.contains(e.text, F.lit(two))
        found.append(F.when(compares & both, issue(
            "logic.comparison.dimension_mismatch", {"one": F.lit(one), "two": F.lit(two)}, **at)))
    return F.array_compact(F.array(*found))


TEXT_RULES: dict[str, Detector] = {
    "typo.de_di_de": de_di_de,
    "format.mixed_punctuation": mixed_punctuation,
    "format.repeat_punctuation": repeat_punctuation,
    "format.fullwidth_digit": fullwidth_digit,
    "typo.repeat_char_3plus": repeat_char_3plus,
    "typo.repeat_char_2": repeat_char_2,
    "format.sentence_gap": sentence_gap,
    "format.unit.ug_per_l": unit_ug_per_l,
    "format.unit.celsius_spacing": unit_celsius_spacing,
    "format.bracket_pair": bracket_pair,
}
OPTIONAL_RULES: dict[str, Detector] = {"format.cjk_ascii_spacing": cjk_ascii_spacing}
LOGIC_RULES: dict[str, Detector] = {
    "logic.contradiction.marker_opposite": contradiction,
    "logic.conclusion.no_evidence": conclusion_without_data,
    "logic.argument.no_evidence": argument_without_evidence,
    "logic.comparison": comparison,
}


def detect(elements: DataFrame, *detectors: Detector) -> DataFrame:
    """Run element rules in one pass over the text. Where every rule says what it cannot do without, elements without any of it leave first."""
    e = element()
    found = F.flatten(F.array(*[d(e) for d in detectors])) if len(detectors) > 1 else detectors[0](e)
    rows = elements.filter(F.length("content") > 0)
    signs = [getattr(d, "sign", None) for d in detectors]
    if all(signs):
        plain = "|".join(dict.fromkeys(regex for regex, also in signs if also is None))
        tests = [F.col("content").rlike(f"(?U){plain}")] if plain else []
        tests += [F.col("content").rlike(f"(?U){regex}") & also(F.col("content")) for regex, also in signs if also is not None]
        rows = rows.filter(reduce(lambda a, b: a | b, tests))
    return rows.select("doc_id", F.inline(found))
