"""Rules that compare all elements of one document."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions.ordered import following, index_block, previous
from proofloom.functions.spans import clip, let, spans
from proofloom.operators.issues import issue_rows
from proofloom.rules import fixed as R
from proofloom.session import stored


def _with_text(elements: DataFrame) -> DataFrame:
    return elements.filter(F.length("content") > 0)


def _one_spelling(occ: DataFrame, rule: str) -> DataFrame:
    """Values of a document written in several ways -> issue per odd spelling.

    ``occ`` holds (doc_id, element_index, start, raw, value).  The spelling used
    most often wins, the first seen on a tie.  Counting per spelling combines
    before the shuffle, so a value repeated in a huge document stays cheap.
    """
    per_raw = occ.groupBy("doc_id", "value", "raw").agg(
        F.count("*").alias("n"), F.min(F.struct("element_index", "start")).alias("first"))
    per_value = per_raw.groupBy("doc_id", "value").agg(
        F.max_by("raw", F.struct(F.col("n"), -F.col("first.element_index"), -F.col("first.start"))).alias("best"),
        F.array_join(F.sort_array(F.collect_list("raw")), ", ").alias("forms"), F.count("*").alias("spellings"),
    ).filter("spellings > 1")
    odd = occ.join(per_value, ["doc_id", "value"]).filter(F.col("raw") != F.col("best"))
    return issue_rows(
        odd, rule, {c: F.col(c) for c in ("raw", "value", "forms", "best")},
        element_index=F.col("element_index"), location_text=F.col("raw"))


def number_occurrences(elements: DataFrame) -> DataFrame:
    hit = F.explode(spans(F.col("content"), R.NUMBER_PATTERN))
    raw = F.regexp_extract("s.hit", R.NUMBER_PATTERN, 1)
    return _with_text(elements).select("doc_id", "element_index", hit.alias("s")).select(
        "doc_id", "element_index", F.col("s.start").alias("start"), raw.alias("raw"),
        F.regexp_replace(raw, "[,，]", "").alias("value"))


def number_format(elements: DataFrame) -> DataFrame:
    """One number written with and without thousands separators."""
    return _one_spelling(number_occurrences(elements), "consistency.number_format")


def date_occurrences(elements: DataFrame) -> DataFrame:
    def normal(s: Column, regex: str) -> Column:
        part = lambda i: F.regexp_extract(s["hit"], regex, i)
        pad = lambda c: F.when(F.length(c) < 2, F.concat(F.lit("0"), c)).otherwise(c)
        return F.concat_ws("-", part(1), pad(part(2)), pad(part(3)))

    def dates(regex: str) -> Column:
        return F.transform(spans(F.col("content"), regex), lambda s: F.struct(
            s["hit"].alias("raw"), s["start"].alias("start"), normal(s, regex).alias("value")))

    found = F.flatten(F.array(*[dates(r) for r in R.DATE_PATTERNS]))
    return _with_text(elements).select("doc_id", "element_index", F.inline(found))


def date_format(elements: DataFrame) -> DataFrame:
    """One day written in several formats."""
    return _one_spelling(date_occurrences(elements), "consistency.date_format")


def org_names(elements: DataFrame) -> DataFrame:
    """Distinct organisation names per document with count and first place."""
    hit = F.explode(spans(F.col("content"), R.ORG_NAME_PATTERN))
    return _with_text(elements).select("doc_id", "element_index", hit.alias("s")).groupBy(
        "doc_id", F.col("s.hit").alias("name")
    ).agg(F.count("*").alias("n"), F.min(F.struct(F.col("element_index").alias("idx"), F.col("s.start").alias("pos"))).alias("first"))


def _drop_one(strings: Column) -> Column:
    """All strings got by deleting one character."""
    return F.flatten(F.transform(strings, lambda s: F.transform(
        F.sequence(F.lit(1), F.length(s)),
        lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))))


def similar_names(elements: DataFrame) -> DataFrame:
    """Pairs of names of one document within two edits; the rarer is suspect.

    Two strings within two edits share a string reachable from both by at most
    two deletions, so candidates meet in an equi-join on that string instead of
    pairing all names of a document.
    """
    names = org_names(elements)
    once = _drop_one(F.array("name"))
    keys = F.array_distinct(F.concat(F.array("name"), once, _drop_one(once)))
    keyed = names.select("*", F.explode(keys).alias("key"))
    a = keyed.select("doc_id", "key", F.struct("name", "n", "first").alias("a"))
    b = keyed.select("doc_id", "key", F.struct("name", "n", "first").alias("b"))
    pairs = a.join(b, ["doc_id", "key"]).filter(F.col("a.first") < F.col("b.first"))
    pairs = pairs.filter(F.levenshtein("a.name", "b.name", 2) >= 0).select("doc_id", "a", "b").distinct()
    first_is_suspect = F.col("a.n") <= F.col("b.n")
    return pairs.select(
        "doc_id", F.when(first_is_suspect, F.col("a")).otherwise(F.col("b")).alias("suspect"),
        F.when(first_is_suspect, F.col("b.name")).otherwise(F.col("a.name")).alias("other"))


def proper_noun(elements: DataFrame) -> DataFrame:
    p = similar_names(elements)
    return issue_rows(
        p, "consistency.proper_noun", {"suspect": F.col("suspect.name"), "other": F.col("other")},
        element_index=F.col("suspect.first.idx"), location_text=F.col("suspect.name"), related_text=F.col("other"))


# --- alias forms of terms and units -----------------------------------------

_HAS_CJK = re.compile(r"[一-鿿]")


def term_rules(table: dict[str, list[str]] = R.TERM_FORMS) -> list[tuple[str, str, str, bool]]:
    """(standard, form, regex or '', case matters) per form."""
    rows = []
    for standard, aliases in table.items():
        rows.append((standard, standard, "", True))
        for alias in aliases:
            if _HAS_CJK.search(alias):
                rows.append((standard, alias, "", True))
            else:
                rows.append((standard, alias, rf"(?i)(?<![A-Za-z0-9])\Q{alias}\E(?![A-Za-z0-9])", False))
    return rows


def unit_rules(table: dict[str, list[str]] = R.UNIT_FORMS) -> list[tuple[str, str, str, bool]]:
    rows = []
    for standard, aliases in table.items():
        for form in [standard, *aliases]:
            if len(form) == 1 and form in R.ONE_LETTER_UNITS:
                regex = rf"(?U)\d\s*\Q{form}\E(?!\w)"
            else:
                regex = rf"(?U)\b\Q{form}\E\b"
            rows.append((standard, form, regex, True))
    return rows


def alias_hits(elements: DataFrame, rules: list[tuple[str, str, str, bool]]) -> DataFrame:
    """Forms that occur in each element.

    The rule list is a literal; a plain ``contains`` runs before the regex, so
    most forms cost one substring test.  Elements that hold none of the shortest
    forms leave first, by a filter that is compiled, unlike functions of arrays.
    """
    def held(text: Column, forms: set[str]) -> list[Column]:
        return [F.contains(text, F.lit(f)) for f in sorted(forms) if not any(o != f and o in f for o in forms)]

    def found(t: Column) -> Column:
        tests = []
        for standard, form, regex, exact in rules:
            text, word = (t["text"], form) if exact else (t["low"], form.lower())
            hit = F.contains(text, F.lit(word))
            if regex:
                hit = hit & t["text"].rlike(regex)
            tests.append(F.when(hit, F.struct(F.lit(standard).alias("standard"), F.lit(form).alias("form"))))
        return F.array_compact(F.array(*tests))

    text = F.struct(F.col("content").alias("text"), F.lower("content").alias("low"))
    # behind a generator, so the filter reads the lowered text and does not make it again for each form
    rows = _with_text(elements).select("doc_id", "element_index", F.inline(F.array(text)))
    some = reduce(lambda a, b: a | b, [*held(F.col("text"), {f for _, f, _, exact in rules if exact}),
                                       *held(F.col("low"), {f.lower() for _, f, _, exact in rules if not exact})])
    return rows.filter(some).select("doc_id", "element_index", F.inline(found({"text": F.col("text"), "low": F.col("low")})))


def _one_form(hits: DataFrame, rule: str) -> DataFrame:
    hits = stored(hits, "hits")  # read twice, made once
    forms = hits.select("doc_id", "standard", "form").distinct().groupBy("doc_id", "standard").agg(
        F.array_join(F.sort_array(F.collect_list("form")), ", ").alias("forms"), F.count("*").alias("n")).filter("n > 1")
    odd = hits.filter(F.col("form") != F.col("standard")).join(forms, ["doc_id", "standard"])
    return issue_rows(
        odd, rule, {c: F.col(c) for c in ("form", "standard", "forms")},
        element_index=F.col("element_index"), location_text=F.col("form"), related_text=F.col("standard"))


def term_alias(elements: DataFrame) -> DataFrame:
    """A term and its aliases used side by side in one document."""
    return _one_form(alias_hits(elements, term_rules()), "consistency.term_alias")


def unit_alias(elements: DataFrame) -> DataFrame:
    """A unit written in several forms in one document."""
    return _one_form(alias_hits(elements, unit_rules()), "consistency.unit_alias")


# --- order within the document ----------------------------------------------

def year_mentions(elements: DataFrame) -> DataFrame:
    hit = F.explode(spans(F.col("content"), R.YEAR_PATTERN))
    years = _with_text(elements).select("doc_id", "element_index", "content", hit.alias("s")).select(
        "doc_id", "element_index", F.col("s.start").alias("start"),
        F.regexp_extract("s.hit", R.YEAR_PATTERN, 1).cast("int").alias("year"),
        clip(F.col("content"), F.col("s.start") - 15, F.col("s.end") + 5).alias("context"))
    return years.filter(F.col("year").between(R.YEAR_MIN, R.YEAR_MAX))


def timeline(elements: DataFrame) -> DataFrame:
    """A year more than one below the year mentioned just before."""
    years = previous(
        year_mentions(elements), ["doc_id"], ["element_index", "start"], [index_block()],
        earlier=F.col("year"), earlier_context=F.col("context"))
    back = years.filter(F.col("earlier") - F.col("year") > 1)
    return issue_rows(
        back, "logic.timeline.backward", {"earlier": F.col("earlier"), "later": F.col("year")},
        element_index=F.col("element_index"), location_text=F.col("context"), related_text=F.col("earlier_context"))


def empty_section(elements: DataFrame) -> DataFrame:
    """A heading of level 1-2 with the next heading right behind it.

    Only headings take part: the following element is found by an equi-join on
    the position, not by a window over all elements.
    """
    heads = elements.filter(F.col("element_type") == "heading")
    nxt = heads.select("doc_id", (F.col("element_index") - 1).alias("element_index"), F.col("level").alias("next_level"))
    empty = heads.filter(F.col("level") <= 2).join(nxt, ["doc_id", "element_index"]).filter("next_level <= level")
    return issue_rows(
        empty, "logic.structure.empty_section", {"text": F.col("content")},
        element_index=F.col("element_index"), element_type=F.lit("heading"), location_text=F.col("content"))


def _any(words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains("content", F.lit(w))
    return hit


def causality(elements: DataFrame) -> DataFrame:
    """A cause word with no result word here or in the next element."""
    flags = _with_text(elements).select(
        "doc_id", "element_index", "element_type",
        _any(R.RESULT_WORDS).alias("result"), F.contains("content", F.lit(R.CAUSE_WORD)).alias("cause"),
        F.when(F.contains("content", F.lit(R.CAUSE_WORD)), F.substring("content", 1, 50)).alias("head"))
    rows = following(flags, ["doc_id"], ["element_index"], [index_block()], next_result=F.col("result"))
    bad = rows.filter(F.col("cause") & ~F.col("result") & ~F.col("next_result"))
    return issue_rows(
        bad, "logic.causality.incomplete", {"n": F.col("element_index") + 1},
        element_index=F.col("element_index"), element_type=F.col("element_type"),
        location_text=F.concat("head", F.lit("...")))


def conditionals(elements: DataFrame) -> DataFrame:
    """An if-word whose then-words are missing here and in the next element."""
    ifs = F.array(*[F.contains("content", F.lit(w)) for w, _ in R.IF_THEN])
    thens = F.array(*[_any(ws) for _, ws in R.IF_THEN])
    flags = _with_text(elements).select(
        "doc_id", "element_index", ifs.alias("ifs"), thens.alias("thens"),
        F.when(_any([w for w, _ in R.IF_THEN]), F.substring("content", 1, 60)).alias("head"))
    rows = following(flags, ["doc_id"], ["element_index"], [index_block()], next_thens=F.col("thens"))
    found = []
    for i, (word, then_words) in enumerate(R.IF_THEN):
        has_then = F.col("thens")[i] | F.coalesce(F.col("next_thens")[i], F.lit(False))
        found.append(F.when(F.col("ifs")[i] & ~has_then, F.struct(
            F.lit(word).alias("word"), F.lit("/".join(then_words)).alias("thens"))))
    bad = rows.select("doc_id", "element_index", "head", F.inline(F.array_compact(F.array(*found))))
    return issue_rows(
        bad, "logic.conditional.incomplete", {"word": F.col("word"), "thens": F.col("thens")},
        element_index=F.col("element_index"), location_text=F.concat("head", F.lit("...")))


CONSISTENCY_RULES = {
    "consistency.number_format": number_format,
    "consistency.date_format": date_format,
    "consistency.proper_noun": proper_noun,
    "consistency.term_alias": term_alias,
    "consistency.unit_alias": unit_alias,
}
ORDER_RULES = {
    "logic.timeline.backward": timeline,
    "logic.structure.empty_section": empty_section,
    "logic.causality.incomplete": causality,
    "logic.conditional.incomplete": conditionals,
}
