"""Formatting rules: conformance checks, applying rules, inferring and parsing them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.functions.ordered import first_per, index_block, last_seen, top_per
from proofloom.functions.scalars import cn_size_to_pt, fingerprint, lookup, parse_alignment, parse_line_spacing
from proofloom.functions.spans import let, strip
from proofloom.operators.elements import ancestors
from proofloom.operators.issues import element, flag, issue_rows
from proofloom.rules import fixed as R

STYLE_FIELDS = {
    "font_name_cn": "string", "font_name_en": "string", "font_size_pt": "double", "bold": "boolean", "italic": "boolean", "underline": "boolean",
    "color": "string", "alignment": "string", "first_indent_chars": "double", "first_indent_cm": "double", "left_indent_cm": "double",
    "right_indent_cm": "double", "line_spacing_type": "string", "line_spacing_value": "double", "space_before_pt": "double",
    "space_after_pt": "double", "keep_with_next": "boolean", "keep_lines_together": "boolean",
}

# --- conformance ---------------------------------------------------------------


def semantic_slot(e=None) -> Column:
    """``heading_1`` .. ``heading_4`` or ``paragraph_0``; an inferred heading beats the element type."""
    e = e or element()
    inferred = F.lower(strip(F.coalesce(e.metadata["structure_role"], F.lit("")))) == "heading"
    guess = F.least(F.coalesce(e.metadata["heading_level"].try_cast("int"), e.level, F.lit(0)), F.lit(4))
    own = F.least(F.coalesce(e.level, F.lit(0)), F.lit(4))
    return F.when(inferred & (guess > 0), F.concat(F.lit("heading_"), guess.cast("string"))).when(
        e.type == "heading", F.concat(F.lit("heading_"), own.cast("string"))).otherwise("paragraph_0")


def load_rule_sets(raw: DataFrame) -> DataFrame:
    """Wide text rules (h1Font, h1Size, .., bFont, bSize) -> (rule_set_id, slot, font, size).

    Bad numbers count as 0; a rule set without any value yields no rows.
    """
    slots = {"heading_1": "h1", "heading_2": "h2", "heading_3": "h3", "heading_4": "h4", "paragraph_0": "b"}
    rows = F.array(*[F.struct(F.lit(s).alias("slot"), F.coalesce(F.col(f"{p}Font"), F.lit("")).alias("font"),
                              F.coalesce(F.col(f"{p}Size").try_cast("double"), F.lit(0.0)).alias("size")) for s, p in slots.items()])
    return raw.select("rule_set_id", F.inline(F.filter(let(rows, lambda rs: F.when(
        F.exists(rs, lambda r: (F.length(r["font"]) > 0) | (r["size"] != 0)), rs).otherwise(F.array().cast("array<struct<slot:string,font:string,size:double>>"))),
        lambda r: F.length(r["slot"]) > 0)))


def trusted_rules(rules: DataFrame, default_source: str | None = None) -> DataFrame:
    """Rule sets saved by a user from a trusted source; a missing source takes the default."""
    source = F.coalesce("save_source", F.lit(""))
    if default_source:
        source = F.when(F.col("saved_by_user") & (source == ""), default_source).otherwise(source)
    return rules.withColumn("save_source", source).filter(
        F.coalesce("saved_by_user", F.lit(False)) & F.lower(F.trim("save_source")).isin(R.TRUSTED_RULE_SOURCES))


def _payload(attr: str, value: Column, mode: Column | None = None) -> Column:
    null = lambda t: F.lit(None).cast(t)
    return F.struct(
        null("string").alias("type"), F.lit(attr).alias("attr"), F.lit("paragraph").alias("scope"), (null("string") if mode is None else mode).alias("mode"),
        value.cast("string").alias("value"), F.col("element_index").alias("para_idx"), F.col("loc").alias("para_fingerprint"),
        null("string").alias("citation_text"), null("array<int>").alias("ref_numbers"), null("array<int>").alias("ref_element_indices"))


def checked_elements(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """Elements joined to the expected font and size of their slot (slot, font, size)."""
    e = element()
    rows = elements.filter(~flag(e, "exclude_from_format_body")).withColumn("slot", semantic_slot(e)).withColumn("loc", fingerprint(e.text))
    rows = rows.filter(F.length("loc") > 0).join(rules.select("slot", F.col("font").alias("want_font"), F.col("size").alias("want_size")), "slot")
    actual = F.coalesce(F.nullif(F.col("font.font_name_cn"), F.lit("")), F.col("font.font_name_en"), F.lit(""))
    return rows.withColumn("font_now", actual).withColumn("size_now", F.coalesce("font.font_size_pt", F.lit(0.0)))


def _label() -> Column:
    return lookup(F.col("slot"), R.SLOT_LABELS)


def font_issues(checked: DataFrame) -> DataFrame:
    bad = checked.filter((F.length("font_now") > 0) & (F.length("want_font") > 0) & (F.col("font_now") != F.col("want_font")))
    return issue_rows(
        bad, "format_font", {"label": _label(), "expected": F.col("want_font"), "actual": F.col("font_now"), "loc": F.col("loc")},
        rule_id=F.concat(F.lit("format_font_"), "slot"), element_type=F.lit(""), element_index=F.col("element_index"), location_text=F.col("loc"),
        fixable=F.lit(True), fix_type=F.lit("format_attr"), fix_payload=_payload("font_name", F.col("want_font")))


def size_issues(checked: DataFrame) -> DataFrame:
    bad = checked.filter((F.col("size_now") != 0) & (F.col("want_size") != 0) & (F.abs(F.col("size_now") - F.col("want_size")) > R.SIZE_TOLERANCE_PT))
    return issue_rows(
        bad, "format_size", {"label": _label(), "expected": F.col("want_size"), "actual": F.col("size_now"), "loc": F.col("loc")},
        rule_id=F.concat(F.lit("format_size_"), "slot"), element_type=F.lit(""), element_index=F.col("element_index"), location_text=F.col("loc"),
        fixable=F.lit(True), fix_type=F.lit("format_attr"), fix_payload=_payload("font_size", F.col("want_size")))


def spacing_issues(checked: DataFrame, mode: str, value: float, limit: int = R.MAX_SPACING_ISSUES) -> DataFrame:
    """Line spacing that differs from the rule, the first few per document."""
    mode = mode.strip().lower()
    now, size = F.col("para.line_spacing_type"), F.col("para.line_spacing_value")
    wrong = (now != mode) | (F.abs(size - value) > (R.SPACING_TOLERANCE_PT if mode == "exact" else R.SPACING_TOLERANCE_MULTIPLE))
    bad = checked.filter(F.lit(mode in ("multiple", "exact") and value > 0) & ~((now == "single") & (size == 1.0)) & wrong)
    bad = top_per(bad, ["doc_id"], ["element_index"], limit)
    if mode == "exact":
        expected, actual = F.lit(f"固定值 {value}pt"), F.when(now == "exact", F.format_string("固定值 %.1fpt", size)).otherwise(F.concat(F.lit("非固定值行距（"), now, F.lit("）")))
    else:
        expected, actual = F.lit(f" {value} 倍行距"), F.when(now == "multiple", F.format_string("%.2f 倍", size)).otherwise(F.concat(F.lit("非倍数行距（"), now, F.lit("）")))
    return issue_rows(
        bad, "format_line_spacing", {"expected": expected, "actual": actual, "loc": F.substring("loc", 1, 20)}, element_type=F.lit(""),
        element_index=F.col("element_index"), location_text=F.col("loc"), fixable=F.lit(True), fix_type=F.lit("format_attr"),
        fix_payload=_payload("line_spacing", F.lit(value), F.lit(mode)))


def format_issues(elements: DataFrame, rules: DataFrame, mode: str = "", value: float = 0.0) -> DataFrame:
    c = checked_elements(elements, rules)
    return font_issues(c).unionByName(size_issues(c)).unionByName(spacing_issues(c, mode, value))


# --- applying rules ------------------------------------------------------------


def rule_slot(e=None) -> Column:
    """Style slot of an element: headings by level, captions by their first character."""
    e = e or element()
    level = F.when(e.level > 0, e.level).otherwise(1)
    return (
        F.when((e.type == "heading") & (level <= 4), F.concat(F.lit("heading"), level.cast("string"))).when(e.type.isin("heading", "paragraph", "list_item"), "body")
        .when((e.type == "caption") & F.startswith(e.text, F.lit("图")), "figure_caption").when(e.type == "caption", "table_caption")
        .when(e.type == "reference", "reference"))


def apply_styles(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """Set the style fields a rule names, keep the others (rules: slot + style columns).

    A heading level without a rule takes the body rule: each slot gets its rule in the rule table, so the elements are joined
    once. Of several rules for a slot the greatest by its values wins, and no element is repeated.
    """
    known = [c for c in rules.columns if c in STYLE_FIELDS]
    r = rules.groupBy("slot").agg(F.max(F.struct(*known)).alias("rule"))
    slots = r.sparkSession.createDataFrame([(f"heading{k}", False) for k in range(1, 5)] + [("body", True)], "slot string, plain boolean")
    body = r.filter("slot = 'body'").select(F.explode(F.array(*[F.lit(f"heading{k}") for k in range(1, 5)])).alias("slot"), F.col("rule").alias("__body"))
    r = (r.join(slots.select("slot"), "slot", "full").join(body, "slot", "left")
         .select(F.col("slot").alias("__slot"), F.coalesce("rule", "__body").alias("__use")).filter("__use IS NOT NULL"))
    # a heading deeper than the named levels is body text by its slot already
    rows = elements.withColumn("__slot", rule_slot()).join(r, "__slot", "left")
    font, para = F.col("font"), F.col("para")
    for part, name in ((font, "font"), (para, "para")):
        have = elements.schema[name].dataType.names
        out = part
        for c in known:
            if c in have:
                out = out.withField(c, F.coalesce(F.col(f"__use.{c}"), F.col(f"{name}.{c}")))
        rows = rows.withColumn(name, out)
    return rows.select(*elements.columns)


def apply_page_rules(docs: DataFrame, page: dict, sections: list[dict]) -> DataFrame:
    """Page setup fields overridden where set; section list replaced when rules have one."""
    out = docs
    for name, value in page.items():
        if value is not None:
            out = out.withColumn(name, F.lit(value))
    if sections:
        items = [F.struct(
            F.lit(s.get("name", "")).alias("name"), F.lit(s.get("header_text", "")).alias("header_text"), F.lit(s.get("header_font") or "").alias("header_font"),
            F.lit(float(s.get("header_size_pt") or 10.5)).alias("header_size_pt"), F.lit(bool(s.get("first_page_different"))).alias("first_page_different"),
            F.lit(bool(s.get("page_number_enabled"))).alias("page_number_enabled")) for s in sections]
        out = out.withColumn("sections", F.array(*items))
    return out


def apply_table_style(cells: DataFrame, style: dict) -> DataFrame:
    """Style of body cells; header cells keep theirs."""
    out = cells
    for name, value in style.items():
        out = out.withColumn(name, F.when(~F.col("is_header") & F.lit(value is not None), F.lit(value)).otherwise(F.col(name)))
    return out


def merge_styles(base: dict[str, Column], over: dict[str, Column]) -> list[Column]:
    """Right values override left ones where set."""
    return [F.coalesce(over[c], base[c]).alias(c) for c in base]


def fill_defaults(rules: DataFrame) -> DataFrame:
    """Defaults of body and page attributes that no rule row sets (template_id, slot, attr, value)."""
    given = [("body", "font_name_cn", "宋体"), ("body", "font_name_en", "Times New Roman"), ("body", "font_size_pt", "12.0"),
             ("body", "first_indent_chars", "2"), ("page", "paper_size", "A4")]
    wanted = rules.select("template_id").distinct().select("template_id", F.inline(F.array(*[
        F.struct(F.lit(s).alias("slot"), F.lit(a).alias("attr"), F.lit(v).alias("value")) for s, a, v in given])))
    return rules.unionByName(wanted.join(rules, ["template_id", "slot", "attr"], "left_anti").select(rules.columns))


def preset_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(R.PRESET_RULES, "preset string, slot string, attr string, value string")


# --- style tables --------------------------------------------------------------


def resolve_styles(styles: DataFrame) -> DataFrame:
    """Effective fonts and size along the base_style chain, of any length; the nearest value wins.

    (template_id, style_name, base_style, east_asia, ascii, size_pt).  A cycle
    only repeats styles already seen nearer.
    """
    walk = ancestors(styles, ["template_id"], "style_name", "base_style").select("template_id", F.col("node").alias("style_name"), "at", "depth")
    own = styles.select("template_id", F.col("style_name").alias("at"), "east_asia", "ascii", "size_pt")
    near = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c)
    return walk.join(own, ["template_id", "at"]).groupBy("template_id", "style_name").agg(near("east_asia"), near("ascii"), near("size_pt"))


def run_fonts(runs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Run values, else the values of the paragraph style."""
    r = resolved.withColumnsRenamed({"east_asia": "__ea", "ascii": "__as", "size_pt": "__sz"})
    out = runs.join(r, ["template_id", "style_name"], "left")
    set_ = lambda c: F.nullif(F.col(c), F.lit(""))
    return out.withColumn("font_eastAsia", F.coalesce(set_("font_eastAsia"), "__ea")).withColumn(
        "font_ascii", F.coalesce(set_("font_ascii"), "__as")).withColumn("font_size_pt", F.coalesce("font_size_pt", "__sz")).withColumn(
        "font_name", F.coalesce(set_("font_name"), "font_ascii", "font_eastAsia")).drop("__ea", "__as", "__sz")


def style_slot(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(lookup(low, R.STYLE_SLOTS), F.when(F.contains(low, F.lit("bibliography")) | F.contains(low, F.lit("参考")), "reference").when(
        F.contains(low, F.lit("caption")) | F.contains(low, F.lit("题注")), "caption"))


def infer_template_style(paragraphs: DataFrame, samples: int = 3) -> DataFrame:
    """Style per (template, style name) from its first non-empty paragraphs.

    Most frequent font, size, weight, alignment and spacing kind (first seen on a
    tie), mean of spacing values.
    """
    rows = paragraphs.filter(F.length(strip(F.col("text"))) > 0)
    top = top_per(rows, ["template_id", "style_name"], ["para_index"], samples)
    fields = ["cn_font", "en_font", "size_pt", "bold", "alignment", "spacing_type", "spacing_value", "space_before", "space_after"]
    lists = top.groupBy("template_id", "style_name").agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("xs"))
    # Whether captions name tables or figures shows in the first marked one, wherever it stands.
    mark = F.substring(strip(F.col("text")), 1, 1)
    marks = rows.filter(mark.isin("表", "图")).groupBy("template_id", "style_name").agg(F.min_by(mark, "para_index").alias("mark"))
    lists = lists.join(marks, ["template_id", "style_name"], "left")

    def mode(xs: Column, field: str) -> Column:
        values = F.array_compact(F.transform(xs, lambda x: x[field]))
        ranked = let(values, lambda vs: F.transform(vs, lambda v, i: F.struct(
            F.size(F.filter(vs, lambda u: u == v)).alias("n"), (-i).alias("i"), v.alias("v"))))
        return F.array_max(ranked)["v"]

    def mean(values: Column) -> Column:
        return let(F.array_compact(values), lambda vs: F.when(F.size(vs) > 0, F.aggregate(vs, F.lit(0.0), lambda a, v: a + v) / F.size(vs)))

    xs = F.col("xs")
    kind = mode(xs, "spacing_type")
    spacing = let(F.struct(xs.alias("xs"), kind.alias("k")), lambda s: mean(F.transform(
        F.filter(s["xs"], lambda x: x["spacing_type"] == s["k"]), lambda x: x["spacing_value"])))
    slot = style_slot(F.col("style_name"))
    return lists.select(
        "template_id", "style_name",
        F.when(slot == "caption", F.when(F.col("mark") == "表", "table_caption").when(F.col("mark") == "图", "figure_caption")).otherwise(slot).alias("slot"),
        mode(xs, "cn_font").alias("font_name_cn"), mode(xs, "en_font").alias("font_name_en"), mode(xs, "size_pt").alias("font_size_pt"), mode(xs, "bold").alias("bold"),
        mode(xs, "alignment").alias("alignment"), kind.alias("line_spacing_type"), spacing.alias("line_spacing_value"),
        F.round(mean(F.transform(xs, lambda x: x["space_before"])), 1).alias("space_before_pt"), F.round(mean(F.transform(xs, lambda x: x["space_after"])), 1).alias("space_after_pt"))


def first_style_sample(paragraphs: DataFrame, limit: int = 300) -> DataFrame:
    """First heading 1-3 and first body paragraph near the start of a template -> rule rows."""
    low = strip(F.lower("style_name"))
    slot = F.when(low.rlike("^(heading|标题) ?1$"), "h1").when(low.rlike("^(heading|标题) ?2$"), "h2").when(low.rlike("^(heading|标题) ?3$"), "h3").when(
        low.isin("normal", "正文", "body text", "default paragraph font") & (F.length(strip(F.col("text"))) > 0), "body")
    rows = paragraphs.filter((F.col("para_index") < limit) & F.col("has_runs")).withColumn("slot", slot).filter("slot IS NOT NULL")
    first = rows.groupBy("template_id", "slot").agg(F.min_by(F.struct("cn_font", "en_font", "size_pt", "alignment", "spacing_value", "first_indent_pt"), "para_index").alias("p"))
    body = F.col("slot") == "body"
    pairs = F.array(
        F.struct(F.concat("slot", F.lit("Font")).alias("key"), F.coalesce("p.cn_font", "p.en_font").alias("value")),
        F.struct(F.concat("slot", F.lit("Size")).alias("key"), F.round("p.size_pt", 1).cast("string").alias("value")),
        F.struct(F.lit("westFont").alias("key"), F.when(body, F.col("p.en_font")).alias("value")),
        F.struct(F.lit("indent").alias("key"), F.when(body & (F.col("p.size_pt") > 0), F.round(F.col("p.first_indent_pt") / F.col("p.size_pt"), 1).cast("string")).alias("value")),
        F.struct(F.lit("lineHeight").alias("key"), F.when(body, F.round("p.spacing_value", 2).cast("string")).alias("value")),
        F.struct(F.lit("align").alias("key"), F.when(body, F.col("p.alignment")).alias("value")))
    return first.select("template_id", F.inline(F.filter(pairs, lambda kv: kv["value"].isNotNull())))


def first_section_margins(sections: DataFrame) -> DataFrame:
    """Margins of the first section of each template in centimetres -> rule rows (template_id, section_index, top, bottom, left, right; lengths in EMU)."""
    first = first_per(sections, ["template_id"], ["section_index"])
    cm = lambda side: F.round(F.col(side) / R.EMU_PER_CM, 2).cast("string")
    pairs = F.array(*[F.struct(F.lit("margin" + side.capitalize()).alias("key"), cm(side).alias("value")) for side in ("top", "bottom", "left", "right")])
    return first.select("template_id", F.inline(F.filter(pairs, lambda kv: kv["value"].isNotNull())))


# --- rules from text -----------------------------------------------------------


def normalize_style_map(raw: Column) -> Column:
    """A map with Chinese or English keys to a style struct."""
    def either(*keys: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_element_at(raw, F.lit(k)), F.lit("")) for k in keys])

    def read(m: Column) -> Column:
        has_cn = m["font"].rlike("[" + R.CN_FONT_CHARS + "]")
        spacing = parse_line_spacing(m["spacing"])
        yes = lambda v: F.when(F.coalesce(~F.lower(v).isin("false", "0"), F.lit(False)), True)
        indent = F.coalesce(F.regexp_extract(m["indent"], r"(?U)^(\d+)\s*字符?", 1).try_cast("double"), m["indent"].try_cast("double"))
        return F.struct(
            F.coalesce(m["cn"], F.when(has_cn, m["font"])).alias("font_name_cn"), F.coalesce(m["en"], F.when(~has_cn, m["font"])).alias("font_name_en"),
            cn_size_to_pt(m["size"]).alias("font_size_pt"), yes(m["bold"]).alias("bold"), yes(m["italic"]).alias("italic"), yes(m["underline"]).alias("underline"),
            parse_alignment(m["align"]).alias("alignment"), indent.alias("first_indent_chars"), spacing["type"].alias("line_spacing_type"),
            spacing["value"].alias("line_spacing_value"), m["before"].try_cast("double").alias("space_before_pt"), m["after"].try_cast("double").alias("space_after_pt"))

    names = {"font": ("font", "字体"), "cn": ("font_cn", "中文字体"), "en": ("font_en", "英文字体"), "size": ("size", "字号", "font_size"), "bold": ("bold", "加粗"),
             "italic": ("italic", "斜体"), "underline": ("underline", "下划线"), "align": ("align", "对齐", "alignment"), "indent": ("first_indent", "首行缩进"),
             "spacing": ("line_spacing", "行距"), "before": ("space_before", "段前"), "after": ("space_after", "段后")}
    return let(F.struct(*[either(*keys).alias(n) for n, keys in names.items()]), read)


def _found(text: Column, *patterns: str) -> Column:
    """Group 1 of the first pattern that matches, else null."""
    return F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, 1)) for p in patterns])


def _described_style(slot: str, desc: Column) -> list[Column]:
    """Rule entries in a phrase such as ``居中，黑体，二号，加粗``."""
    row = lambda attr, value: F.struct(F.lit(slot).alias("slot"), F.lit(attr).alias("attr"), value.cast("string").alias("value"))
    fonts = F.coalesce(*[F.when(F.contains(desc, F.lit(f)), F.lit(f)) for f in R.DESCRIBED_FONTS])
    has_cn = fonts.rlike("[" + R.CN_FONT_CHARS + "华文]")
    size = cn_size_to_pt(_found(desc, "(初号|小初|一号|小一|二号|小二|三号|小三|四号|小四|五号|小五|六号|小六|七号|八号)", r"(?U)(\d+(?:\.\d+)?)\s*[号pt磅]"))
    on = lambda word: F.when(F.contains(desc, F.lit(word)), F.lit("true"))
    return [row("font_name_cn", F.when(has_cn, fonts)), row("font_name_en", F.when(~has_cn, fonts)), row("font_size_pt", size), row("bold", on("加粗")),
            row("alignment", F.when(F.contains(desc, F.lit("居中")), "center")), row("italic", on("斜体"))]


def _header(desc: Column) -> list[Column]:
    """Text of the page header and the font and size named in it."""
    row = lambda attr, value: F.struct(F.lit("header").alias("slot"), F.lit(attr).alias("attr"), value.cast("string").alias("value"))
    part = lambda i: F.when(desc.rlike(R.HEADER_FONT), F.regexp_extract(desc, R.HEADER_FONT, i))
    return [row("header_text", desc), row("header_font", part(1)), row("header_size_pt", cn_size_to_pt(part(2)))]


def rules_from_text(docs: DataFrame, column: str = "text") -> DataFrame:
    """Requirement texts to rule rows (rule_text_id, slot, attr, value).

    A table of short texts is a small file, so its rows are dealt to all cores first; that spread also serves the last grouping.
    Phrases found in a text are bound once, however many entries are read from them.
    """
    row = lambda slot, attr, value: F.struct(F.lit(slot).alias("slot"), F.lit(attr).alias("attr"), value.cast("string").alias("value"))

    def margins(t: Column, both: Column) -> Column:
        out = []
        for name, pattern in R.MARGIN_TEXT.items():
            one = _found(t, pattern)
            out.append(row("page", f"margin_{name}_cm", (F.coalesce(both, one) if name in ("left", "right") else one).try_cast("double")))
        return F.array(*out)

    def spacing(s: Column) -> Column:
        value = F.coalesce(s["times"], s["exact"], s["loose"]).try_cast("double")
        kind = F.when(s["times"].isNull() & s["exact"].isNotNull(), "exact").when(value == 1.5, "one_point_five").when(value.isNotNull(), "multiple")
        return F.array(row("body", "line_spacing_type", kind), row("body", "line_spacing_value", value))

    def read(t: Column) -> Column:
        described = lambda slot, patterns: let(_found(t, *patterns), lambda d: F.when(d.isNotNull(), F.array(*_described_style(slot, d))))
        times, exact, loose = (_found(t, p).alias(n) for n, p in (("times", R.LINE_SPACING_TIMES), ("exact", R.LINE_SPACING_EXACT), ("loose", R.LINE_SPACING_LOOSE)))
        parts = [F.array(row("page", "paper_size", F.when(F.contains(F.lower(t), F.lit("a4")), "A4").when(F.contains(t, F.lit("A3")), "A3").otherwise("A4"))),
                 let(_found(t, R.MARGIN_BOTH_SIDES), lambda both: margins(t, both))]
        parts += [described(slot, patterns) for slot, patterns in R.STYLE_TEXT.items()]
        parts += [let(F.struct(times, exact, loose), spacing), let(_found(t, R.HEADER_TEXT), lambda d: F.when(d.isNotNull(), F.array(*_header(d))))]
        out = [row("numbering", slot, _found(t, *patterns)) for slot, patterns in R.NUMBERING_TEXT.items()]
        out += [row("xref", "enabled", F.when(F.contains(t, F.lit("引用")), "true")), row("xref", "figure_pattern", _found(t, R.FIGURE_NUMBER_TEXT)),
                row("xref", "table_pattern", _found(t, R.TABLE_NUMBER_TEXT)),
                row("special", "punctuation", F.when(F.contains(t, F.lit("中文输入")) | F.contains(t, F.lit("中文标点")), "必须使用中文输入格式")),
                row("special", "number_format", F.when(F.contains(t, F.lit("千位分隔")), "千位分隔符")), row("special", "money_unit", _found(t, R.MONEY_UNIT_TEXT)),
                row("special", "forbidden", _found(t, R.FORBIDDEN_TEXT))]
        for attr, v in (("font_name_cn", "宋体"), ("font_name_en", "Times New Roman"), ("font_size_pt", "12.0"), ("first_indent_chars", "2.0")):
            out.append(row("body_default", attr, F.lit(v)))
        return F.filter(F.flatten(F.array_compact(F.array(*parts, F.array(*out)))), lambda r: r["value"].isNotNull())

    dealt = docs.select("rule_text_id", column).repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "rule_text_id")
    rows = dealt.select("rule_text_id", F.inline(let(F.col(column), read)))
    own = F.when(F.col("slot") == "body_default", "body").otherwise(F.col("slot"))
    ranked = rows.select("rule_text_id", own.alias("slot"), "attr", "value", (F.col("slot") == "body_default").alias("d"))
    return ranked.groupBy("rule_text_id", "slot", "attr").agg(F.min_by("value", "d").alias("value"))


MODEL_SLOTS = ["page", "title", "heading1", "heading2", "heading3", "heading4", "body", "table_caption", "figure_caption", "reference"]
_PAGE_KEYS = ["paper_size", "margin_top_cm", "margin_bottom_cm", "margin_left_cm", "margin_right_cm", "gutter_cm"]


def rules_from_model_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Model JSON ``{slot: {attr: value}}`` to rule rows; unknown slots and attributes drop out."""
    parsed = F.from_json(F.col(column), "map<string, map<string, string>>")
    return rows.select("template_id", F.explode(parsed).alias("slot", "attrs")).filter(F.col("slot").isin(MODEL_SLOTS)).select(
        "template_id", "slot", F.explode("attrs").alias("attr", "value")).filter(
        F.when(F.col("slot") == "page", F.col("attr").isin(_PAGE_KEYS)).otherwise(F.col("attr").isin(list(STYLE_FIELDS))))


def answer_key(lines: DataFrame) -> DataFrame:
    """Answer-key Markdown lines (template_id, line_no, line) to (template_id, key, value)."""
    number = r"^[0-9]+(?:\.[0-9]+)*\s*"
    head = F.regexp_extract("line", r"(?U)^#+\s+(.+?)\s*$", 1)
    rows = lines.withColumn("__h", F.when(F.length(head) > 0, strip(F.regexp_replace(head, number, ""))))
    rows = last_seen(rows, ["template_id"], ["line_no"], [index_block("line_no")], heading=F.col("__h"))
    bullet = r"(?U)^\s*[-*]\s*([^:：]+)[:：]\s*(.*)$"
    rows = rows.filter(F.col("line").rlike(bullet)).select(
        "template_id", "line_no", F.coalesce("heading", F.lit("")).alias("h"), strip(F.regexp_replace(strip(F.regexp_extract("line", bullet, 1)), number, "")).alias("label"),
        strip(F.replace(F.regexp_extract("line", bullet, 2), F.lit("`"), F.lit(""))).alias("v"))
    h, label, v = F.col("h"), F.col("label"), F.col("v")
    named = F.coalesce(*[F.when(F.contains(v, F.lit(k)), F.lit(p)) for k, p in R.CN_SIZES.items()])
    size = F.coalesce(named, F.regexp_extract(v, r"(?iU)([0-9]+(?:\.[0-9]+)?)\s*pt", 1).try_cast("double")).cast("string")
    prefix = lookup(h, {"一级标题": "h1", "二级标题": "h2", "三级标题": "h3", "四级标题": "h4", "正文": "body", "主标题": "title"})
    level, body = h.isin("一级标题", "二级标题", "三级标题", "四级标题"), h == "正文"
    exact = F.regexp_extract(v, r"(?U)固定值\s*([0-9]+(?:\.[0-9]+)?)\s*磅", 1).try_cast("double")
    times = F.coalesce(F.regexp_extract(v, r"(?U)([0-9]+(?:\.[0-9]+)?)\s*倍", 1).try_cast("double"), F.when(F.contains(v, F.lit("单倍行距")), 1.0))
    spacing = (level | body) & (label == "行距")
    margin = lookup(label, {"上": "marginTop", "下": "marginBottom", "左": "marginLeft", "右": "marginRight"})
    kv = lambda k, value: F.struct(k.alias("key"), value.cast("string").alias("value"))
    pairs = F.array(
        kv(F.lit("titleAlign"), F.when((h == "主标题") & (label == "对齐"), v)), kv(F.lit("titleFont"), F.when((h == "主标题") & (label == "字体"), v)),
        kv(F.concat(prefix, F.lit("Size")), F.when(((h == "主标题") | level | body) & label.isin("字号", "正文字号"), size)),
        kv(F.concat(prefix, F.lit("Font")), F.when((level & label.isin("中文字体", "字体")) | (body & label.isin("字体", "正文字体")), v)),
        kv(F.lit("westFont"), F.when(level & (label == "西文字体"), v)),
        kv(F.lit("lineSpacingMode"), F.when(spacing & exact.isNotNull(), "exact").when(spacing & times.isNotNull(), "multiple")),
        kv(F.lit("lineSpacingValue"), F.when(spacing, F.coalesce(exact, times))),
        kv(margin, F.when(h == "页边距", F.regexp_extract(v, r"(?iU)([0-9]+(?:\.[0-9]+)?)\s*cm", 1).try_cast("double"))))
    rows = rows.select("template_id", "line_no", F.inline(F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull())))
    return rows.groupBy("template_id", "key").agg(F.max_by("value", "line_no").alias("value"))


def answer_mismatches(answers: DataFrame, parsed: DataFrame) -> DataFrame:
    """Keys whose parsed value differs from the answer key."""
    p = parsed.select("template_id", "key", F.col("value").alias("parsed"))
    return answers.join(p.hint("merge"), ["template_id", "key"], "left").filter(~F.col("value").eqNullSafe(F.col("parsed")))
