"""Cross references: targets, reference points and their match.

Targets and points are two tables per corpus; matching is a join on
(document, type, number).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions.ordered import first_per, index_block, last_seen, numbered, running_sum
from proofloom.functions.scalars import citation_ranges, cn_num_to_int, fingerprint, int_to_cn_num, parse_citation_numbers, plain_number, range_pieces
from proofloom.functions.spans import clip, let, spans, strip
from proofloom.operators.issues import element, flag, issue_rows
from proofloom.rules import fixed as R
from proofloom.session import stored

KEY = ["doc_id", "target_type", "number"]


def without_excluded(elements: DataFrame, key: str = "exclude_from_xref_targets") -> DataFrame:
    """Drop elements whose metadata excludes them (cover pages, contents)."""
    return elements.filter(~flag(element(), key))


_PREFIX = {"figure": "_fig_", "table": "_tbl_", "equation": "_eq_", "chapter": "_chapter_", "reference": "_ref_"}


def _target_kind(t: Column, kind: Column) -> Column:
    """Which target rule an element fits: first rule wins, ``figure2`` has a two-part number."""
    body = kind.isin("caption", "paragraph")
    # a regex reads the text anew, so a plain look at the text goes first
    marks = {"figure": F.startswith(t, F.lit("图")), "table": F.startswith(t, F.lit("表")), "equation": F.contains(t, F.lit("(")) | F.contains(t, F.lit("（")),
             "chapter": F.lit(True), "reference": F.contains(t, F.lit("["))}
    fits = lambda name, i: marks[name] & t.rlike(R.TARGET_PATTERNS[name][i])
    return (
        F.when((kind == "heading") & fits("chapter", 0), "chapter1")
        .when((kind == "heading") & fits("chapter", 1), "chapter2")
        .when(body & fits("figure", 0), "figure2").when(body & fits("figure", 1), "figure1")
        .when(body & fits("table", 0), "table2").when(body & fits("table", 1), "table1")
        .when((kind == "paragraph") & fits("equation", 0), "equation2")
        .when((kind == "reference") & fits("reference", 0), "reference1"))


# Where the number parts and the title sit in each pattern.
_ONE = {"chapter1": ("chapter", 0, 1), "chapter2": ("chapter", 1, 1), "figure2": ("figure", 0, 1), "figure1": ("figure", 1, 1),
        "table2": ("table", 0, 1), "table1": ("table", 1, 1), "equation2": ("equation", 0, 1), "reference1": ("reference", 0, 1)}
_TWO = {"figure2": ("figure", 0, 2), "table2": ("table", 0, 2), "equation2": ("equation", 0, 2)}
_REST = {"chapter1": ("chapter", 0, 2), "chapter2": ("chapter", 1, 2), "figure2": ("figure", 0, 3), "figure1": ("figure", 1, 2),
         "table2": ("table", 0, 3), "table1": ("table", 1, 2), "reference1": ("reference", 0, 2)}


def _by_kind(t: Column, kind: Column, groups: dict[str, tuple[str, int, int]]) -> Column:
    out = F.lit(None).cast("string")
    for name, (pattern, i, group) in groups.items():
        out = F.when(kind == name, F.regexp_extract(t, R.TARGET_PATTERNS[pattern][i], group)).otherwise(out)
    return out


def _read_target(text: Column, kind: Column) -> Column:
    """``array<struct<target_type, title, one, two>>`` with at most one entry.

    The steps are nested bindings: each regex runs once per element, and no
    filter above can copy them into the scan.
    """
    def named(t: Column, k: Column, raw: Column, two: Column, title: Column) -> Column:
        def numbered_(one: Column) -> Column:
            row = F.struct(F.substring(k, F.lit(1), F.length(k) - 1).alias("target_type"), title.alias("title"),
                           one.alias("one"), plain_number(two).alias("two"))
            # A chapter number that is no number, or zero, is no target.
            return F.when(~F.startswith(k, F.lit("chapter")) | (one.try_cast("int") > 0), row)

        cn = F.when(F.startswith(k, F.lit("chapter")), cn_num_to_int(raw)).otherwise(0)
        return let(F.when(cn > 0, cn.cast("string")).otherwise(plain_number(raw)), numbered_)

    def with_kind(t: Column, k: Column) -> Column:
        title = strip(F.when(k == "equation2", F.regexp_replace(t, R.TARGET_PATTERNS["equation"][0], "")).otherwise(
            _by_kind(t, k, _REST)))
        parts = F.struct(_by_kind(t, k, _ONE).alias("one"), _by_kind(t, k, _TWO).alias("two"), title.alias("title"))
        return F.when(k.isNotNull(), let(parts, lambda p: named(t, k, p["one"], p["two"], p["title"])))

    row = let(strip(text), lambda t: let(_target_kind(t, kind), lambda k: with_kind(t, k)))
    return F.array_compact(F.array(row))


def _named_targets(rows: DataFrame) -> DataFrame:
    kind = F.col("target_type")
    number = F.concat_ws("-", "one", "two")
    label = (
        F.when(kind == "chapter", F.concat(F.lit("第"), int_to_cn_num(F.col("one").try_cast("int")), F.lit("章")))
        .when(kind == "figure", F.concat(F.lit("图"), number)).when(kind == "table", F.concat(F.lit("表"), number))
        .when(kind == "equation", F.concat(F.lit("("), number, F.lit(")")))
        .otherwise(F.concat(F.lit("["), number, F.lit("]"))))
    titled = kind.isin("chapter", "figure", "table") & (F.length("title") > 0)
    prefix = F.try_element_at(F.create_map(*[F.lit(x) for kv in _PREFIX.items() for x in kv]), kind)
    whole = F.col("two").isNull()
    return rows.select(
        "doc_id", "element_index", "target_type", number.alias("number"),
        F.when(titled, F.concat(label, F.lit(" "), "title")).otherwise(label).alias("label"), "title",
        F.when(whole & (kind != "chapter"), F.lit(0)).otherwise(F.col("one").try_cast("int")).alias("chapter_num"),
        F.when(kind == "chapter", F.lit(0)).otherwise(F.coalesce("two", "one").try_cast("int")).alias("seq_num"),
        F.concat(prefix, F.concat_ws("_", "one", "two")).alias("bookmark_name"))


def bibliography_state(elements: DataFrame) -> DataFrame:
    """Add ``section_start``: index of the bibliography heading an element sits under, else null."""
    text = strip(F.col("content"))
    heading = F.col("element_type") == "heading"
    event = F.when(heading, F.struct(
        F.when(text.rlike(R.BIBLIOGRAPHY_HEADING), F.col("element_index")).alias("start")))
    out = last_seen(elements, ["doc_id"], ["element_index"], [index_block()], __section=event)
    return out.select(*elements.columns, F.col("__section.start").alias("section_start"))


def _events(elements: DataFrame) -> DataFrame:
    """What the target rules read in each element, stored: ``heading`` (starts a section, a bibliography or another), ``plain`` (a
    target outside bibliographies) and ``entry`` (number and title of a bibliography entry). Elements with none of them are left out."""
    e, t, regex = element(), strip(F.col("content")), R.TARGET_PATTERNS["reference"][0]
    rows = without_excluded(elements).filter(F.length("content") > 0)

    def entry(text: Column) -> Column:
        written = F.contains(text, F.lit("[")) & text.rlike(regex)
        return F.when(F.length(text) > 0, F.struct(
            F.when(written, plain_number(F.regexp_extract(text, regex, 1))).alias("number"),
            F.substring(F.when(written, strip(F.regexp_extract(text, regex, 2))).otherwise(text), 1, 120).alias("title")))

    heading = F.when(e.type == "heading", F.struct(F.when(t.rlike(R.BIBLIOGRAPHY_HEADING), F.col("element_index")).alias("start")))
    rows = rows.select("doc_id", "element_index", heading.alias("heading"), F.get(_read_target(e.text, e.type), F.lit(0)).alias("plain"),
                       F.when(e.type.isin("paragraph", "reference"), let(t, entry)).alias("entry"))
    return stored(rows.filter("heading IS NOT NULL OR plain IS NOT NULL OR entry IS NOT NULL"), "events")


def targets(elements: DataFrame) -> DataFrame:
    """Everything that can be referred to, at most one per element. A stored table."""
    key, order, block = ["doc_id"], ["element_index"], [index_block()]
    rows = last_seen(_events(elements), key, order, block, __section=F.col("heading"))
    rows = rows.withColumn("section_start", F.col("__section.start"))
    in_bib = F.col("section_start").isNotNull()
    plain = rows.filter(~in_bib & F.col("plain").isNotNull()).select("doc_id", "element_index", "plain.*")
    # Inside the bibliography a written [N] wins, other entries are counted in order.
    entries = rows.filter(in_bib & F.col("entry").isNotNull()).select("doc_id", "element_index", "section_start", "entry.*")
    entries = running_sum(entries, ["doc_id", "section_start"], order, block, position=F.when(F.col("number").isNull(), 1).otherwise(0))
    listed = entries.select(
        "doc_id", "element_index", F.lit("reference").alias("target_type"), "title",
        F.coalesce("number", F.col("position").cast("string")).alias("one"), F.lit(None).cast("string").alias("two"))
    return stored(_named_targets(plain.unionByName(listed)), "targets")


def points(elements: DataFrame, exclude_self: bool = False) -> DataFrame:
    """Every reference token with ``scan_index``, its place in reading order. A stored table."""
    def hits(no: int, kind: str, regex: str) -> Column:
        def one(s: Column) -> Column:
            part = lambda i: F.regexp_extract(s["hit"], regex, i)
            if kind == "reference":
                numbers = F.regexp_extract_all(part(1), F.lit(r"(?U)\d+"), F.lit(0))
            elif kind == "chapter":
                cn = cn_num_to_int(part(1))
                numbers = F.array_compact(F.array(F.when(cn > 0, cn.cast("string")).otherwise(
                    F.when(part(1).rlike(r"(?U)^\d+$"), plain_number(part(1))))))
            elif regex.count(r"(\d+)") > 1:
                numbers = F.array(F.concat(plain_number(part(1)), F.lit("-"), plain_number(part(2))))
            else:
                numbers = F.array(plain_number(part(1)))
            return F.struct(s["start"].alias("start_pos"), s["end"].alias("end_pos"), F.lit(no).alias("pattern_no"),
                            F.lit(kind).alias("target_type"), s["hit"].alias("hit"), numbers.alias("numbers"))

        return F.transform(spans(F.col("content"), regex, R.POINT_MARKS[no]), one)

    found = F.flatten(F.array(*[hits(i, kind, rx) for i, (kind, rx) in enumerate(R.POINT_PATTERNS)]))
    found = F.array_sort(F.filter(found, lambda h: F.size(h["numbers"]) > 0))
    same_span = lambda a, b: (a["start_pos"] == b["start_pos"]) & (a["end_pos"] == b["end_pos"])
    found = let(found, lambda hs: F.filter(hs, lambda h, i: (i == 0) | ~same_span(h, hs[F.greatest(i - 1, F.lit(0))])))
    # compiled, unlike the functions of arrays below: most elements hold no character that a reference needs
    marked = reduce(lambda a, b: a | b, [F.contains("content", F.lit(m)) for m in ("图", "表", "(", "（", "式", "章", "节", "[")])
    rows = elements.filter(marked & ~F.col("element_type").isin("heading", "reference"))
    rows = rows.select("doc_id", "element_index", F.explode(found).alias("h"))
    rows = rows.select("doc_id", "element_index", "h.*").select(
        "doc_id", "element_index", "start_pos", "end_pos", "pattern_no", "target_type", "hit",
        F.posexplode("numbers").alias("sub_pos", "number"))
    rows = rows.withColumn("ref_text", F.when(
        F.col("target_type") == "reference", F.concat(F.lit("["), "number", F.lit("]"))).otherwise(F.col("hit"))).drop("hit")
    if exclude_self:
        own = targets(elements).select(*KEY, "element_index")
        rows = rows.join(own, [*KEY, "element_index"], "left_anti")
    found = numbered(stored(rows, "tokens"), ["doc_id"], ["element_index", "start_pos", "pattern_no", "sub_pos"], [index_block()], "scan_index")
    return stored(found, "points")


def first_targets(targets_: DataFrame) -> DataFrame:
    """The target a number stands for: the first one in the document."""
    return first_per(targets_, KEY, ["element_index"])


def matched(targets_: DataFrame, points_: DataFrame) -> DataFrame:
    """Each point with its target; no target means dangling."""
    first = first_targets(targets_).select(
        *KEY, F.col("element_index").alias("target_index"), "label", "title", "bookmark_name")
    out = points_.join(first, KEY, "left")
    valid = F.col("target_index").isNotNull()
    return out.select(
        "doc_id", "target_type", "number", "ref_text", "element_index", "start_pos", "end_pos", "scan_index",
        F.when(valid, "valid").otherwise("dangling").alias("status"), "target_index",
        F.coalesce("label", F.concat(F.lit("未知"), "target_type")).alias("label"), "bookmark_name",
        F.when(valid, "").otherwise(F.concat(F.lit('找不到目标："'), "ref_text", F.lit('"'))).alias("message"))


def _target_rows(rows: DataFrame, status: str, text: str) -> DataFrame:
    return rows.select(
        "doc_id", "target_type", "number", F.lit("").alias("ref_text"), F.lit(-1).alias("element_index"),
        F.lit(-1).alias("start_pos"), F.lit(-1).alias("end_pos"), F.lit(-1).alias("scan_index"),
        F.lit(status).alias("status"), F.col("element_index").alias("target_index"), "label", "bookmark_name",
        F.concat(F.lit(text + '："'), "label", F.lit('"')).alias("message"))


def unreferenced(targets_: DataFrame, points_: DataFrame) -> DataFrame:
    return _target_rows(targets_.join(points_.select(*KEY).distinct(), KEY, "left_anti"), "unreferenced", "目标未被引用")


def duplicates(targets_: DataFrame) -> DataFrame:
    """Second and later targets with the same type and number."""
    first = targets_.groupBy(*KEY).agg(F.min("element_index").alias("__first"), F.count("*").alias("__n")).filter("__n > 1")
    later = targets_.join(first, KEY).filter("element_index > __first").select(*targets_.columns)
    return _target_rows(later, "duplicate", "重复编号")


def matches(targets_: DataFrame, points_: DataFrame) -> DataFrame:
    """Points with their targets, targets without a point, and repeated targets. A stored table."""
    return stored(matched(targets_, points_).unionByName(unreferenced(targets_, points_)).unionByName(duplicates(targets_)), "matches")


def in_scan_order(matches_: DataFrame) -> DataFrame:
    """Points in reading order, rows without a point last."""
    return matches_.orderBy("doc_id", F.col("scan_index") < 0, "scan_index", "status", "target_type", "number", "target_index")


def match_issues(matches_: DataFrame) -> DataFrame:
    bad = matches_.filter(F.col("status") != "valid")
    out = None
    for status in ("dangling", "unreferenced", "duplicate"):
        point = status == "dangling"
        rows = issue_rows(
            bad.filter(F.col("status") == status), f"xref.{status}", {"ref": F.col("ref_text"), "label": F.col("label")},
            rule_id=F.concat(F.lit(f"xref.{status}."), "target_type"), element_type=F.lit(""),
            element_index=F.col("element_index") if point else F.col("target_index"),
            location_text=F.col("ref_text") if point else F.col("label"))
        out = rows if out is None else out.unionByName(rows)
    return out


def crossref_issues(elements: DataFrame) -> DataFrame:
    t, p = targets(elements), points(elements)
    return match_issues(matches(t, p))


def summary(targets_: DataFrame, points_: DataFrame, matches_: DataFrame) -> DataFrame:
    """Counters per document."""
    kinds = ("figure", "table", "equation", "chapter", "reference")
    t = targets_.groupBy("doc_id").agg(F.count("*").alias("target_count"), *[
        F.count_if(F.col("target_type") == k).alias(f"{k}_targets") for k in kinds])
    p = points_.groupBy("doc_id").agg(F.count("*").alias("ref_point_count"))
    m = matches_.groupBy("doc_id").agg(*[
        F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("valid", "dangling", "mismatch", "unreferenced")])
    return t.join(p, "doc_id", "full").join(m, "doc_id", "full").na.fill(0)


def suggestions(matches_: DataFrame) -> DataFrame:
    """Advice rows a reviewer confirms."""
    s, ref, label = F.col("status"), F.col("ref_text"), F.col("label")
    text = (
        F.when(s == "dangling", F.concat(F.lit('请检查引用"'), ref, F.lit('"是否正确')))
        .when(s == "unreferenced", F.concat(F.lit('目标"'), label, F.lit('"未被引用，是否需要添加引用？')))
        .when(s == "duplicate", F.concat(F.lit('存在重复编号"'), label, F.lit('"，请检查'))))
    return matches_.filter(s != "valid").select(
        "doc_id", s.alias("type"), F.when(s == "dangling", ref).otherwise(label).alias("subject"), "message",
        text.alias("suggestion"), "scan_index", "target_index")


def adoptable(matches_: DataFrame, fielded: DataFrame) -> DataFrame:
    """Plain-text references that can become fields, plus dangling ones.

    ``fielded`` lists ``(doc_id, ref_text)`` that already are fields.
    """
    refs = matches_.filter((F.col("target_type") == "reference") & (F.length("ref_text") > 0))
    free = refs.filter("status = 'valid'").join(fielded.select("doc_id", "ref_text").distinct(), ["doc_id", "ref_text"], "left_anti")
    first = first_per(free, ["doc_id", "ref_text"], ["scan_index"])
    ok = first.select(
        "doc_id", F.lit("unreferenced").alias("type"), F.col("ref_text").alias("target_label"), "bookmark_name",
        "element_index", "start_pos", "scan_index", F.concat(F.lit("可创建字段："), "ref_text").alias("title"),
        F.concat(F.lit("「"), "ref_text", F.lit("」在正文中为纯文本，采纳后导出时自动转为 Word REF 字段")).alias("description"),
        F.col("ref_text").alias("suggestion"))
    bad = refs.filter("status = 'dangling'").select(
        "doc_id", F.lit("dangling").alias("type"), F.col("ref_text").alias("target_label"),
        F.lit(None).cast("string").alias("bookmark_name"), "element_index", "start_pos", "scan_index",
        F.concat(F.lit("悬空引用："), "ref_text").alias("title"),
        F.concat(F.lit("「"), "ref_text", F.lit("」找不到对应目标，请检查引用是否正确")).alias("description"),
        F.lit(None).cast("string").alias("suggestion"))
    return ok.unionByName(bad)


# --- plain-text citations ----------------------------------------------------

def bibliography_start(elements: DataFrame) -> DataFrame:
    """Index of the first bibliography heading per document."""
    head = (F.col("element_type") == "heading") & strip(F.col("content")).rlike(R.BIBLIOGRAPHY_HEADING)
    return elements.filter(head).groupBy("doc_id").agg(F.min("element_index").alias("bib_start"))


def bibliography_entries(elements: DataFrame) -> DataFrame:
    """Entry number -> element index; a later entry replaces an earlier one."""
    text = strip(F.col("content"))
    rows = elements.filter(text.rlike(R.BIBLIOGRAPHY_ENTRY)).select(
        "doc_id", "element_index", plain_number(F.regexp_extract(text, R.BIBLIOGRAPHY_ENTRY, 1)).try_cast("int").alias("ref_number"))
    rows = rows.join(bibliography_start(elements), "doc_id").filter("element_index > bib_start")
    return rows.groupBy("doc_id", "ref_number").agg(F.max("element_index").alias("ref_index"))


def body_citations(elements: DataFrame) -> DataFrame:
    """``[n]`` written by hand before the bibliography, with the entries found."""
    body = elements.filter(~F.col("element_type").isin("header", "footer"))
    cites = body.select("doc_id", "element_index", "content", F.explode(spans(F.col("content"), R.CITATION_PATTERN)).alias("s"))
    inner = F.regexp_extract("s.hit", R.CITATION_PATTERN, 1)
    cites = cites.select(
        "doc_id", "element_index", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"),
        F.col("s.hit").alias("citation"), parse_citation_numbers(inner).alias("numbers"), citation_ranges(inner).alias("ranges"),
        fingerprint(F.col("content")).alias("fingerprint"),
        strip(clip(F.col("content"), F.col("s.start") - 10, F.col("s.end") + 10)).alias("location_text"))
    cites = cites.join(bibliography_start(elements), "doc_id").filter("element_index < bib_start")
    place, key = ["doc_id", "element_index", "start_pos"], ["doc_id", "level", "block"]
    # A range meets the entries in it by its aligned blocks, so its length does not matter.
    asked = cites.select(*place, F.posexplode("ranges").alias("n", "r")).select(*place, "n", F.inline(range_pieces(F.col("r.low"), F.col("r.high"))))
    entries = bibliography_entries(elements).select("doc_id", "ref_number", "ref_index", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("level"))
    entries = entries.withColumn("block", F.expr("CAST(shiftright(CAST(ref_number AS BIGINT), level) AS INT)"))
    found = asked.join(entries, key).groupBy(*place).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n", "ref_number", "ref_index"))), lambda x: x["ref_index"]).alias("ref_indices"))
    return cites.join(found, place, "left").withColumn("fixable", F.col("ref_indices").isNotNull())


def citation_issues(elements: DataFrame) -> DataFrame:
    c = body_citations(elements)
    payload = F.when(F.col("fixable"), F.struct(
        F.lit("xref").alias("type"), F.lit(None).cast("string").alias("attr"), F.lit(None).cast("string").alias("scope"),
        F.lit(None).cast("string").alias("mode"), F.lit(None).cast("string").alias("value"),
        F.col("element_index").alias("para_idx"), F.col("fingerprint").alias("para_fingerprint"),
        F.col("citation").alias("citation_text"), F.col("numbers").alias("ref_numbers"),
        F.col("ref_indices").alias("ref_element_indices")))
    return issue_rows(
        c, "xref.plain_text_citation", {"cite": F.col("citation")}, element_index=F.col("element_index"),
        element_type=F.lit(""), location_text=F.col("location_text"), start_pos=F.col("start_pos"), end_pos=F.col("end_pos"),
        fixable=F.col("fixable"), fix_type=F.when(F.col("fixable"), "xref"), fix_payload=payload)


def citation_warnings(elements: DataFrame) -> DataFrame:
    """Documents without a bibliography heading."""
    docs = elements.select("doc_id").distinct()
    return docs.join(bibliography_start(elements), "doc_id", "left_anti").select(
        "doc_id", F.lit(R.NO_BIBLIOGRAPHY_WARNING).alias("warning"))
