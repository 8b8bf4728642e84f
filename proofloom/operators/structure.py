"""Structural role of each element: cover, contents, headings, bibliography, body.

The role of an element depends on what came before it.  The cover can only
touch the first elements of a document; past them only two yes/no states remain
(inside the contents, inside the bibliography).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions.ordered import index_block
from proofloom.functions.spans import let, strip
from proofloom.rules import fixed as R
from proofloom.session import stored


def views(elements: DataFrame) -> DataFrame:
    """The attributes the rules look at, one row per element."""
    hint = (
        F.when(F.col("element_type") == "heading", F.concat(F.lit("h"), F.when(F.col("level").between(1, 3), F.col("level")).otherwise(3).cast("string")))
        .when(F.col("element_type") == "paragraph", "p").when(F.col("element_type") == "list_item", "li")
        .when(F.col("element_type") == "reference", "ref").when(F.col("element_type").isin("caption", "table"), F.col("element_type")).otherwise(""))
    return elements.select(
        "doc_id", F.col("element_index").alias("idx"), strip(F.coalesce("content", F.lit(""))).alias("text"),
        F.lower(F.coalesce("style_name", F.lit(""))).alias("style"), hint.alias("hint"), F.coalesce("font.font_size_pt", F.lit(0.0)).alias("size"),
        F.lower(F.coalesce("para.alignment", F.lit(""))).alias("align"), F.coalesce("first_indent_twips", F.lit(0.0)).alias("indent"),
        F.coalesce("font.bold", F.lit(False)).alias("bold"), (F.col("element_type") == "section_break").alias("is_break"))


def baseline(v: DataFrame) -> DataFrame:
    """Per document: usual body size and alignment, and where the cover ends."""
    body = v.filter(F.col("hint").isin("p", "li") & (F.length("text") >= 4))
    first_max = lambda value, weight: F.max_by(value, F.struct(F.col(weight), -F.col("first")))
    sizes = body.filter("size > 0").groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("w"), F.min("idx").alias("first"))
    sizes = sizes.groupBy("doc_id").agg(first_max("size", "w").alias("body_size"))
    aligns = body.filter("align <> ''").groupBy("doc_id", "align").agg(F.count("*").alias("w"), F.min("idx").alias("first"))
    aligns = aligns.groupBy("doc_id").agg(first_max("align", "w").alias("body_align"))
    edge = v.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("is_break") & (F.col("idx") < R.COVER_LIMIT), F.col("idx"))), F.lit(R.COVER_LIMIT)).alias("boundary"))
    return edge.join(sizes, "doc_id", "left").join(aligns, "doc_id", "left").select(
        "doc_id", F.coalesce("body_size", F.lit(0.0)).alias("body_size"), F.coalesce("body_align", F.lit("")).alias("body_align"), "boundary")


#: Role, confidence and reason of every class; elements carry its place in this list.
_CLASSES: list[tuple[str, float, str]] = []


def _cls(role: str, confidence: float, reason: str) -> Column:
    """The number of a class. A reason that ends in ``style:`` is completed by the element's own style."""
    if (role, confidence, reason) not in _CLASSES:
        _CLASSES.append((role, confidence, reason))
    return F.lit(_CLASSES.index((role, confidence, reason))).cast("tinyint")


def _class_field(code: Column, field: int, kind: str) -> Column:
    return F.get(F.array(*[F.lit(c[field]) for c in _CLASSES]).cast(f"array<{kind}>"), code.cast("int"))


def _has_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def _marks(v: DataFrame) -> DataFrame:
    """State-free facts about each element, and its class for each state."""
    t, style, hint, idx = F.col("text"), F.col("style"), F.col("hint"), F.col("idx")
    toc_style = F.lit(False)
    for p in R.TOC_STYLE_PREFIXES:
        toc_style = toc_style | F.startswith(style, F.lit(p))
    v = v.select(
        "*", (F.length(t) > 0).alias("filled"), hint.isin("h1", "h2", "h3").alias("is_h"), toc_style.alias("toc_style"),
        t.rlike(R.TOC_HEADING).alias("toc_heading"), (t.rlike(R.TOC_LEADER) | t.rlike(R.TOC_TAB_PAGE)).alias("leader"),
        t.rlike(R.TOC_TRAILING_PAGE).alias("trailing"), t.rlike(R.SECTION_NAME).alias("section_name"),
        (t.rlike(R.CHAPTER_LINE) | t.rlike(R.NUMBERED_LINE) | t.rlike(R.CN_NUMBERED_LINE)).alias("numbered"),
        t.rlike(r"(?U)^\s*\[\d+\]").alias("ref_item"), t.rlike(R.CAPTION_LINE).alias("caption_line"), t.rlike(R.COVER_AUTHOR).alias("author"),
        (F.contains(t, F.lit("参考文献")) | F.lower(t).isin("references", "reference", "bibliography")).alias("ref_heading"))
    n, flat, size, body = F.length("text"), F.col("indent") <= 1.0, F.col("size"), F.col("body_size")
    toc_entry = F.col("filled") & (F.col("leader") | F.col("toc_style") | (
        (n <= 80) & (F.col("trailing") | F.col("toc_heading") | F.col("section_name") | F.col("numbered"))))
    goes_on = (
        F.col("filled") & (n <= 40) & ~F.col("toc_heading") & ~F.col("section_name") & ~F.col("trailing") & flat
        & (F.col("align").isin("center", "") | (size >= body)) & (idx < F.col("boundary") * 3))

    def classify(in_ref: bool, after_cover: bool) -> Column:
        inside, center = idx < F.col("boundary"), F.col("align") == "center"
        big = inside & center & (size > 0) & (body > 0) & (size >= body * 1.3) & flat
        near = F.lit(True) if after_cover else idx <= 2
        bigger = (size > 0) & (body > 0) & (size > body + 0.5)
        short_number = F.col("numbered") & (n <= 60)
        out = F.when(~F.col("filled"), _cls("body", 0.3, "empty_text"))
        out = out.when(F.col("toc_style") | style.isin(R.TOC_STYLE_NAMES), _cls("toc", 0.95, "style:toc"))
        out = out.when(F.col("toc_heading") & (idx < R.COVER_LIMIT * 2), _cls("heading", 0.85, "section_name:toc_heading"))
        out = out.when(F.col("leader"), _cls("toc", 0.85, "dotted_leader"))
        if in_ref:
            out = out.when(hint.isin("p", "li", "ref"), _cls("reference", 0.9, "in_reference_section"))
        return (
            out.when(_has_any(style, R.REFERENCE_STYLE_WORDS), _cls("reference", 0.9, "style:"))
            .when(F.col("ref_item"), _cls("reference", 0.8, "ref_item_pattern"))
            .when(_has_any(style, R.CAPTION_STYLE_WORDS), _cls("caption", 0.95, "style:caption"))
            .when(F.col("caption_line"), _cls("caption", 0.85, "caption_pattern"))
            .when(hint == "table", _cls("table", 0.95, "type:table"))
            .when(F.col("is_h") & F.col("section_name"), _cls("heading", 0.95, "section_name"))
            .when(hint == "h1", _cls("heading", 0.9, "style:h1")).when(hint == "h2", _cls("heading", 0.9, "style:h2")).when(hint == "h3", _cls("heading", 0.9, "style:h3"))
            .when(big, _cls("cover", 0.85, "cover_first_page_centered_large"))
            .when(inside & F.col("author") & (n <= 40) & flat & near, _cls("cover", 0.82, "cover_author_line"))
            .when(inside & (idx < 3) & center & (n <= 30) & flat, _cls("cover", 0.7, "cover_short_centered"))
            .when(F.col("section_name") & (n <= 12), _cls("heading", 0.85, "section_name"))
            .when(short_number & (bigger | F.col("bold") | center), _cls("heading", 0.75, "numbered_heading"))
            .when(short_number & (size == 0), _cls("heading", 0.6, "numbered_heading_no_size"))
            .otherwise(_cls("body", 0.5, "default")))

    # cls[2 * in bibliography + after cover]
    classes = F.array(*[classify(r, c) for r in (False, True) for c in (False, True)])
    # what a role would say of the text is read here, so that neither text nor style goes through the blocks
    level = heading_level(F.lit("heading"), hint, t)
    return v.select("doc_id", "idx", "filled", "is_h", "toc_heading", "ref_heading", toc_entry.alias("toc_entry"), goes_on.alias("goes_on"),
                    classes.alias("cls"), level.cast("tinyint").alias("level"), named_section(t).alias("named"),
                    F.when(_has_any(style, R.REFERENCE_STYLE_WORDS), F.substring(style, 1, 20)).alias("own_style"))


#: Elements per block of the state fold.
BLOCK = 256
#: Outcomes past the four classes of an element.
_COVER, _TOC = 4, 5


def _outcome(s: Column, x: Column) -> Column:
    """Which class an element gets in a state: 0-3, cover continuation or inside the contents."""
    place = F.when(s["r"], 2).otherwise(0) + F.when(s["p"], 1).otherwise(0)
    return F.when(s["c"] & x["goes_on"], _COVER).when(s["t"] & x["filled"] & ~x["is_h"] & x["toc_entry"], _TOC).otherwise(place)


def _moved(s: Column, x: Column, k: Column) -> Column:
    """The state after an element with outcome ``k``: the last was cover, the cover goes on, inside contents, inside bibliography."""
    heading, is_cover = (k < 4) & F.get(x["headings"], k), (k == _COVER) | ((k < 4) & F.coalesce(F.get(x["covers"], k), F.lit(False)))
    leaves = x["filled"] & ((x["is_h"] & ~x["toc_heading"]) | ~x["toc_entry"])
    heading = F.coalesce(heading, F.lit(False))
    return F.struct(is_cover.alias("p"), F.when(x["filled"], is_cover).otherwise(s["c"]).alias("c"),
                    ((heading & x["toc_heading"]) | (s["t"] & ((k >= 4) | ~leaves))).alias("t"),
                    F.when(heading, x["ref_heading"]).otherwise(s["r"]).alias("r"))


def _state(t: Column, r: Column) -> Column:
    no = F.lit(False)
    return F.struct(no.alias("p"), no.alias("c"), t.alias("t"), r.alias("r"))


def _exit(xs: Column, start: Column) -> Column:
    """The state at the end of a block."""
    return F.aggregate(xs, start, lambda s, x: let(_outcome(s, x), lambda k: _moved(s, x, k)))


def _outcomes(xs: Column, start: Column) -> Column:
    """The outcome of each element of a block."""
    begin = F.struct(start.alias("s"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(xs, begin, lambda a, x: let(_outcome(a["s"], x), lambda k: F.struct(_moved(a["s"], x, k).alias("s"), F.concat(a["out"], F.array(k)).alias("out"))), lambda a: a["out"])


def classify(elements: DataFrame) -> DataFrame:
    """Role, confidence, reason, exclusion flags, heading level and section kind per element.

    Each element moves a small automaton. Blocks of elements are functions of the state they are entered in: past the opening two
    flags are left, so four states. These functions are folded over the blocks of a document, and then every block on its own.
    """
    v = stored(views(elements), "views")
    marks = _marks(v.join(baseline(v), "doc_id"))
    is_role = lambda x, role: F.transform(x["cls"], lambda c: c.isin([i for i, k in enumerate(_CLASSES) if k[0] == role]))
    each = F.struct("idx", "filled", "is_h", "toc_heading", "ref_heading", "toc_entry", "goes_on", "cls", "level", "named", "own_style")
    told = lambda x: x.withField("headings", is_role(x, "heading")).withField("covers", is_role(x, "cover"))
    blocks = stored(marks.groupBy("doc_id", index_block("idx", BLOCK).alias("block")).agg(F.sort_array(F.collect_list(each)).alias("xs")), "blocks")
    blocks = blocks.withColumn("xs", F.transform("xs", told))
    exits = F.array(*[_exit(F.col("xs"), _state(F.lit(t), F.lit(r))) for r in (False, True) for t in (False, True)])
    place = lambda s: F.when(s["t"], 1).otherwise(0) + F.when(s["r"], 2).otherwise(0)
    each_block = F.struct("block", F.transform(exits, place).alias("to"))
    long = blocks.filter("block > 0").select("doc_id").distinct()
    walked = blocks.join(long, "doc_id", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_list(each_block)).alias("bs"))
    begin = F.struct(F.lit(0).alias("s"), F.array().cast("array<struct<block:bigint,entry:int>>").alias("out"))
    entries = F.aggregate("bs", begin, lambda a, b: F.struct(
        F.get(b["to"], a["s"]).alias("s"), F.concat(a["out"], F.array(F.struct(b["block"].alias("block"), a["s"].alias("entry")))).alias("out")), lambda a: a["out"])
    entered = blocks.join(walked.select("doc_id", F.inline(entries)), ["doc_id", "block"], "left")
    entry = let(F.coalesce("entry", F.lit(0)), lambda e: _state(e % 2 == 1, e >= 2))
    rows = entered.select("doc_id", F.inline(F.arrays_zip("xs", _outcomes(F.col("xs"), entry).alias("k")))).select("doc_id", "xs.*", "k")
    result = F.when(F.col("k") == _COVER, _cls("cover", 0.78, "cover_continuation")).when(F.col("k") == _TOC, _cls("toc", 0.88, "in_toc_section")).otherwise(F.get("cls", F.col("k")))
    return _described(rows.select("doc_id", "idx", "filled", "level", "named", "own_style", result.alias("code")))


def heading_level(role: Column, hint: Column, text: Column) -> Column:
    decimal = F.regexp_extract(text, R.HEADING_DECIMAL, 1)
    top = text.rlike(R.HEADING_TOP_NAMES) | text.rlike(R.CHAPTER_LINE) | text.rlike(R.CN_NUMBERED_LINE)
    return F.when(role == "heading", F.when(hint == "h1", 1).when(hint == "h2", 2).when(hint == "h3", 3).when(F.length(text) == 0, None)
                  .when(top, 1).when(F.length(decimal) > 0, F.length(decimal) - F.length(F.replace(decimal, F.lit("."), F.lit(""))) + 2))


def named_section(text: Column) -> Column:
    """The section a heading text opens by its own wording, whatever its role."""
    compact = F.regexp_replace(F.lower(text), r"(?U)\s+", "")
    return (F.when(compact.isin("目录", "contents", "tableofcontents"), "toc_heading").when(compact == "摘要", "abstract_heading_zh")
            .when(compact == "abstract", "abstract_heading_en").when(compact.isin("参考文献", "references", "reference", "bibliography"), "references_heading")
            .when(text.rlike(R.KEYWORDS_LINE), "keywords"))


def section_kind(role: Column, level: Column, filled: Column, named: Column) -> Column:
    return F.when(filled, (
        F.when(role == "toc", "toc_entry").when(role == "reference", "reference_item").when(role == "caption", "caption").when(role == "cover", "cover")
        .when(named.isNotNull(), named).when(role == "heading", F.coalesce(F.concat(F.lit("heading_"), level.cast("string")), F.lit("heading")))))


def _described(rows: DataFrame) -> DataFrame:
    code = F.col("code")
    rows = rows.withColumns({"role": _class_field(code, 0, "string"), "confidence": _class_field(code, 1, "double"), "reason": _class_field(code, 2, "string")})
    role, confidence = F.col("role"), F.col("confidence")
    out = rows.select(
        "doc_id", F.col("idx").alias("element_index"), "role", "confidence",
        F.when(F.col("reason") == "style:", F.concat("reason", "own_style")).otherwise(F.col("reason")).alias("reason"),
        (role.isin("cover", "toc", "reference", "caption", "table") & (confidence >= R.FORMAT_EXCLUDE_CONFIDENCE)).alias("exclude_from_format_body"),
        (role.isin("cover", "toc") & (confidence >= R.XREF_EXCLUDE_CONFIDENCE)).alias("exclude_from_xref_targets"),
        F.when(role == "heading", F.col("level").cast("int")).alias("heading_level"), "filled", "named")
    return out.withColumn("section_kind", section_kind(F.col("role"), F.col("heading_level"), F.col("filled"), F.col("named"))).drop("filled", "named")


def with_structure(elements: DataFrame, roles: DataFrame) -> DataFrame:
    """Write the roles into the metadata the checkers read."""
    meta = F.create_map(
        F.lit("structure_role"), F.col("role"), F.lit("structure_confidence"), F.col("confidence").cast("string"), F.lit("structure_reason"), F.col("reason"),
        F.lit("exclude_from_format_body"), F.col("exclude_from_format_body").cast("string"),
        F.lit("exclude_from_xref_targets"), F.col("exclude_from_xref_targets").cast("string"),
        F.lit("heading_level"), F.col("heading_level").cast("string"), F.lit("section_kind"), F.col("section_kind"))
    joined = elements.join(roles, ["doc_id", "element_index"])
    return joined.withColumn("metadata", F.map_filter(F.map_concat("metadata", meta), lambda k, x: x.isNotNull())).select(*elements.columns)


def profile(roles: DataFrame) -> DataFrame:
    return roles.groupBy("role", "section_kind", "exclude_from_format_body", "exclude_from_xref_targets").agg(F.count("*").alias("n"))


def dominant_run_style(runs: Column) -> Column:
    """``struct<font, size, bold>`` by character-weighted vote over runs, in the row."""
    full = F.filter(runs, lambda r: F.length(strip(F.coalesce(r["text"], F.lit("")))) > 0)
    weighed = F.transform(full, lambda r: F.struct(
        F.length(strip(r["text"])).alias("n"), F.coalesce(F.nullif(r["font_eastAsia"], F.lit("")), F.nullif(r["font_name"], F.lit(""))).alias("font"),
        F.when(r["font_size_pt"] > 0, r["font_size_pt"]).alias("size"), F.coalesce(r["bold"], F.lit(False)).alias("bold")))

    def vote(rs: Column, field: str) -> Column:
        names = F.array_compact(F.array_distinct(F.transform(rs, lambda r: r[field])))
        score = lambda v, i: F.struct(
            F.aggregate(F.filter(rs, lambda r: r[field] == v), F.lit(0), lambda a, r: a + r["n"]).alias("n"), (-i).alias("i"), v.alias("v"))
        return F.array_max(F.transform(names, score))["v"]

    def pick(rs: Column) -> Column:
        total = F.aggregate(rs, F.lit(0), lambda a, r: a + r["n"])
        heavy = F.aggregate(F.filter(rs, lambda r: r["bold"]), F.lit(0), lambda a, r: a + r["n"])
        return F.struct(vote(rs, "font").alias("font"), vote(rs, "size").alias("size"),
                        F.coalesce(heavy / F.nullif(total, F.lit(0)) >= 0.6, F.lit(False)).alias("bold"))

    return let(weighed, pick)
