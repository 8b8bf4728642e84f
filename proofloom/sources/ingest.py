"""Raw documents to elements.

A document arrives whole in one row, so every splitter here works inside the
row and explodes once: no shuffle, and a large collection only means more rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.functions.ordered import running_sum
from proofloom.functions.spans import let, scan, strip
from proofloom.operators.plans import file_size_gate
from proofloom.rules import fixed as R
from proofloom.rules.fixed import MAX_FILE_MB, SUPPORTED_FORMATS
from proofloom.schemas import JSON_ELEMENTS

_NO_META = "map<string,string>"

# --- structured elements -----------------------------------------------------

_QA_TYPES = {"h1": ("heading", 1), "h2": ("heading", 2), "h3": ("heading", 3)}
_XREF_TYPES = _QA_TYPES | {"caption": ("caption", 0), "ref": ("reference", 0)}


def _map_type(kind: Column, table: dict) -> tuple[Column, Column]:
    name, level = F.lit("paragraph"), F.lit(0)
    for key, (t, lv) in table.items():
        name = F.when(kind == key, t).otherwise(name)
        level = F.when(kind == key, lv).otherwise(level)
    return name, level


def elements_from_json(docs: DataFrame, column: str = "elements_json", for_xref: bool = False) -> DataFrame:
    """``[{type, text, runs, metadata}]`` per document -> elements, blank text dropped."""
    arr = F.from_json(F.col(column), JSON_ELEMENTS)
    kept = F.filter(arr, lambda e: F.length(strip(F.coalesce(e["text"], F.lit("")))) > 0)
    rows = docs.select("doc_id", F.posexplode(kept).alias("element_index", "e"))
    kind = F.coalesce("e.type", F.lit("p"))
    if for_xref:
        kind = F.lower(F.when(F.length(kind) > 0, kind).otherwise("p"))
    name, level = _map_type(kind, _XREF_TYPES if for_xref else _QA_TYPES)
    meta = F.coalesce("e.metadata", F.create_map().cast(_NO_META))
    return rows.select("doc_id", "element_index", name.alias("element_type"), level.alias("level"),
                       strip(F.col("e.text")).alias("content"), F.col("e.runs").alias("runs"), meta.alias("metadata"))


# --- plain text --------------------------------------------------------------

def txt_line_type(line: Column) -> Column:
    """``struct<element_type, level>`` of a trimmed line of plain text."""
    kind = lambda t, lv: F.struct(F.lit(t).alias("element_type"), F.lit(lv).alias("level"))
    hashes = F.length(F.regexp_extract(line, r"^(#+)", 1))
    return (
        F.when(line.rlike("^[一二三四五六七八九十]+、"), kind("heading", 1))
        .when(line.rlike("^（[一二三四五六七八九十]+）"), kind("heading", 2))
        .when(line.rlike(r"(?U)^\d+\.\s") & (F.length(line) < 50), kind("heading", 3))
        .when(line.rlike(r"(?U)^（\d+）"), kind("heading", 4))
        .when(line.rlike(r"(?U)^第[一二三四五六七八九十\d]+[章节篇部]"), kind("heading", 1))
        .when(F.startswith(line, F.lit("#")), F.struct(F.lit("heading").alias("element_type"), F.least(hashes, F.lit(6)).alias("level")))
        .when(line.rlike(r"(?U)^\[[\d,\-–]+\]"), kind("reference", 0))
        .when((F.length(line) < 30) & ~line.rlike("[，。！？；：、]"), kind("heading", 0))
        .otherwise(kind("paragraph", 0)))


def _lines(text: Column) -> Column:
    """Trimmed non-blank lines."""
    return F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: F.length(x) > 0)


def segment_txt(docs: DataFrame, column: str = "text") -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(_lines(F.col(column))).alias("element_index", "content"))
    return rows.select("doc_id", "element_index", txt_line_type(F.col("content")).alias("k"), "content").select(
        "doc_id", "element_index", "k.element_type", "k.level", "content")


def plain_line_type(line: Column) -> Column:
    """``struct<type, text>`` for the light line format (h1-h3, li, ref, caption, p)."""
    row = lambda t, text: F.struct(F.lit(t).alias("type"), text.alias("text"))
    bullet = r"(?U)^[\-\*]\s+"
    return (
        F.when(line.rlike("^####? "), row("h3", strip(F.regexp_replace(line, "^#+", ""))))
        .when(F.startswith(line, F.lit("## ")), row("h2", strip(F.substring(line, F.lit(4), F.length(line)))))
        .when(F.startswith(line, F.lit("# ")), row("h1", strip(F.substring(line, F.lit(3), F.length(line)))))
        .when(line.rlike(bullet), row("li", F.concat(F.lit("• "), F.regexp_replace(line, bullet, ""))))
        .when(line.rlike(r"(?U)^\d+\.\s+"), row("li", line))
        .when(line.rlike(r"(?U)^\[\d+\]"), row("ref", line))
        .when(line.rlike(r"(?U)^(图|表|Figure|Table)\s*\d"), row("caption", line))
        .otherwise(row("p", line)))


def segment_plain_lines(docs: DataFrame, column: str = "text") -> DataFrame:
    parts = F.transform(_lines(F.regexp_replace(F.col(column), "\r\n?", "\n")), plain_line_type)
    return docs.select("doc_id", F.posexplode(parts).alias("element_index", "e")).select("doc_id", "element_index", "e.type", "e.text")


# --- Markdown ----------------------------------------------------------------

def clean_markdown(text: Column) -> Column:
    """Strip inline marks in a fixed order."""
    for pattern in (r"\*\*\*(.+?)\*\*\*", r"\*\*(.+?)\*\*", r"\*(.+?)\*", r"__(.+?)__", r"_(.+?)_", r"`(.+?)`",
                    r"\[([^\]]+)\]\([^)]+\)", r"!\[([^\]]*)\]\([^)]+\)"):
        text = F.regexp_replace(text, pattern, "$1")
    return strip(text)


def _line_facts(lines: Column) -> Column:
    """What each line is on its own: the block it would open, and whether it goes on with an open one."""
    def facts(line: Column, i: Column) -> Column:
        def of(bare: Column) -> Column:
            item, ordered = line.rlike(R.MD_LIST), line.rlike(R.MD_ORDERED)
            pipe, fence = F.contains(line, F.lit("|")), F.startswith(bare, F.lit("```"))
            rule_next = F.coalesce(strip(F.get(lines, i + 1)).rlike(R.MD_TABLE_RULE), F.lit(False))
            own = (F.when(F.startswith(line, F.lit("#")), "heading").when(fence, "code").when(pipe & rule_next, "table").when(item, "list")
                   .when(bare.rlike(R.MD_IMAGE), "image").when(F.startswith(line, F.lit(">")), "quote").when(bare.rlike(R.MD_RULER), "ruler").otherwise("paragraph"))
            stops = F.startswith(line, F.lit("#")) | ordered | (bare.rlike(R.MD_MARK) & ~line.rlike(R.MD_BULLET))
            return F.struct(own.alias("own"), (F.length(bare) == 0).alias("blank"), fence.alias("fence"), pipe.alias("pipe"), item.alias("item"), (~stops).alias("goes_on"))

        return let(strip(line), of)

    return F.transform(lines, facts)


def _line_kinds(lines: Column) -> Column:
    """``array<struct<kind, fresh>>``: the kind of block each line is in, and whether it opens it; an automaton over the lines."""
    def step(open_: Column, x: Column) -> tuple[Column, Column]:
        kind = (F.when((open_ == "code") & x["fence"], "fence").when(open_ == "code", "code").when((open_ == "table") & x["pipe"], "table")
                .when(x["blank"], "blank").when((open_ == "list") & x["item"], "list").when((open_ == "paragraph") & x["goes_on"], "paragraph").otherwise(x["own"]))
        joins = (open_ == "code") | ((open_ == "table") & x["pipe"]) | (~x["blank"] & (((open_ == "list") & x["item"]) | ((open_ == "paragraph") & x["goes_on"])))
        # a closing fence ends the code block; headings, images and rules stand alone
        return F.when(kind.isin("code", "table", "list", "paragraph"), kind).otherwise(""), F.struct(kind.alias("kind"), (~joins).alias("fresh"))

    return scan(_line_facts(lines), F.lit(""), "struct<kind:string,fresh:boolean>", step)


def _markdown_blocks(docs: DataFrame, column: str) -> DataFrame:
    """(doc_id, blocks): ``block``, ``kind``, ``line_no``, ``lines`` and ``closed`` of each block, blank lines included; cut inside the row."""
    def cut(lines: Column, kinds: Column, at: Column) -> Column:
        return F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda a, k: let(F.get(at, k + 1), lambda end: F.struct(
            (k + 1).alias("block"), F.get(kinds, a)["kind"].alias("kind"), a.alias("line_no"), F.slice(lines, a + 1, end - a).alias("lines"),
            (F.get(kinds, end - 1)["kind"] == "fence").alias("closed"))))

    def begun(lines: Column, kinds: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(kinds) - 1), lambda i: F.get(kinds, i)["fresh"])
        return let(F.concat(starts, F.array(F.size(kinds))), lambda at: cut(lines, kinds, at))

    # bound step by step: a column used inside a lambda would be computed again for every line
    blocks = let(F.split(F.coalesce(F.col(column), F.lit("")), "\n", -1), lambda lines: let(_line_kinds(lines), lambda kinds: begun(lines, kinds)))
    return docs.select("doc_id", blocks.alias("blocks"))


def markdown_lines(docs: DataFrame, column: str = "text") -> DataFrame:
    """Every line with the block it belongs to."""
    blocks = _markdown_blocks(docs, column).select("doc_id", F.inline("blocks"))
    rows = blocks.select("doc_id", "block", "kind", "closed", "line_no", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "line"))
    kind = F.when(F.col("closed") & (F.col("i") == F.col("n") - 1), "fence").otherwise(F.col("kind"))
    return rows.select("doc_id", (F.col("line_no") + F.col("i")).alias("line_no"), "line", "block", kind.alias("kind"))


def _content(kind: Column, lines: Column, closed: Column) -> Column:
    """Text of a block that is not a list."""
    code = F.array_join(F.slice(lines, F.lit(2), F.size(lines) - F.when(closed, 2).otherwise(1)), "\n")
    first = F.get(lines, F.lit(0))
    return (F.when(kind == "heading", F.when(first.rlike(R.MD_HEADING), clean_markdown(F.regexp_replace(first, r"(?U)^#{1,6}\s+", ""))).otherwise(strip(first)))
            .when(kind == "quote", strip(F.regexp_replace(first, r"(?U)^>\s*", ""))).when(kind == "image", F.regexp_extract(first, R.MD_IMAGE_PARTS, 1))
            .when(kind == "code", code).when(kind == "paragraph", clean_markdown(F.array_join(F.transform(lines, strip), "\n"))))


def _filled(b: Column) -> Column:
    """A code block with nothing but white space is no element."""
    return (b["kind"] != "code") | (F.length(strip(_content(b["kind"], b["lines"], b["closed"]))) > 0)


def _item(line: Column) -> Column:
    return clean_markdown(F.regexp_replace(line, R.MD_LIST, ""))


def markdown_elements(docs: DataFrame, column: str = "text") -> DataFrame:
    """The element tree of Markdown documents: one row per element and per list item, made inside the row of the document.

    ``element_index`` counts the elements of a document. List items have null there, ``parent_index`` of their list and
    ``child_index``. ``numbering_type`` is that of a list's first item, ``language`` that of a code block, ``blockquote`` marks
    quotes. Tables and images are kept apart: :func:`markdown_cells`, :func:`segment_markdown`.
    """
    blocks = F.filter("blocks", lambda b: b["kind"].isin("heading", "code", "list", "quote", "paragraph") & _filled(b))
    rows = _markdown_blocks(docs, column).select("doc_id", F.posexplode(blocks).alias("at", "b"))
    kind, lines, first, none = F.col("b.kind"), F.col("b.lines"), F.get("b.lines", F.lit(0)), F.lit(None)
    is_list = kind == "list"

    def row(index, parent, child, type_, level, content, numbering, language, quote) -> Column:
        return F.struct(index.cast("int").alias("element_index"), parent.cast("int").alias("parent_index"), child.cast("int").alias("child_index"), type_.alias("element_type"),
                        level.alias("level"), content.alias("content"), numbering.cast("string").alias("numbering_type"), language.cast("string").alias("language"), quote.alias("blockquote"))

    name = F.when(kind == "code", "code_block").when(kind == "quote", "paragraph").otherwise(kind)
    top = row(F.col("at"), none, none, name, F.when(kind == "heading", F.length(F.regexp_extract(first, R.MD_HEADING, 1))).otherwise(0),
              F.when(is_list, "").otherwise(_content(kind, lines, F.col("b.closed"))), F.when(is_list, F.when(first.rlike(R.MD_ORDERED), "decimal").otherwise("bullet")),
              F.when(kind == "code", strip(F.substring(strip(first), 4, 1 << 30))), kind == "quote")
    items = F.transform(lines, lambda line, k: row(none, F.col("at"), k, F.lit("list_item"), F.lit(0), _item(line), none, none, F.lit(False)))
    return rows.select("doc_id", F.inline(F.when(is_list, F.concat(F.array(top), items)).otherwise(F.array(top))))


def segment_markdown(docs: DataFrame, column: str = "text") -> DataFrame:
    """Blocks and images of Markdown documents in order, list items in the place of their list."""
    blocks = F.filter("blocks", lambda b: ~b["kind"].isin("blank", "ruler", "table") & _filled(b))
    rows = _markdown_blocks(docs, column).select("doc_id", F.inline(blocks))
    kind, lines, first = F.col("kind"), F.col("lines"), F.get("lines", F.lit(0))
    name = F.when(kind == "code", "code_block").when(kind.isin("heading", "image"), kind).otherwise("paragraph")

    def row(part, type_, level, content, numbering) -> Column:
        return F.struct(part.alias("part"), type_.alias("element_type"), level.alias("level"), content.alias("content"), numbering.cast("string").alias("numbering_type"))

    block = row(F.lit(-1), name, F.when(kind == "heading", F.length(F.regexp_extract(first, R.MD_HEADING, 1))).otherwise(0), _content(kind, lines, F.col("closed")), F.lit(None))
    items = F.transform(lines, lambda line, k: row(F.col("line_no") + k, F.lit("list_item"), F.lit(0), _item(line), F.when(line.rlike(R.MD_ORDERED), "decimal").otherwise("bullet")))
    return rows.select("doc_id", "block", F.inline(F.when(kind == "list", items).otherwise(F.array(block))))


def markdown_cells(docs: DataFrame, column: str = "text") -> DataFrame:
    """Cells of Markdown tables; the rule line drops out, the first row is the header."""
    rows = markdown_lines(docs, column).filter("kind = 'table'").filter(~strip(F.col("line")).rlike(r"(?U)^\|[\s\-:|]+\|$"))
    parts = F.split(strip(F.col("line")), r"\|", -1)
    rows = rows.select("doc_id", "block", "line_no", let(parts, lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(0)))).alias("cells"))
    rows = rows.filter(F.size("cells") > 0)
    first = rows.groupBy("doc_id", "block").agg(F.min("line_no").alias("header_line"))
    cells = rows.join(first, ["doc_id", "block"]).select(
        "doc_id", "block", "line_no", (F.col("line_no") == F.col("header_line")).alias("is_header"), F.posexplode("cells").alias("col", "c"))
    return cells.select("doc_id", F.col("block").alias("table_block"), "line_no", "col", "is_header", clean_markdown(F.col("c")).alias("content"))


# --- HTML --------------------------------------------------------------------

def _unescape(text: Column) -> Column:
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(ch))
    return text


def _inner(html: Column) -> Column:
    return strip(_unescape(F.regexp_replace(html, "<[^>]+>", "")))


_H = r"<h([1-6])[^>]*>(.*?)</h[1-6]>"
_P = r"<(?:p|li)[^>]*>(.*?)</(?:p|li)>"


def segment_html(docs: DataFrame, column: str = "html", bare_text: bool = True) -> DataFrame:
    """Headings, paragraphs and list items of HTML; ``bare_text`` adds loose text
    and caption promotion, without it only references are promoted."""
    pattern = f"(?is){_H}|{_P}" + (r"|[^\n<]+" if bare_text else "")

    def one(hit: Column) -> Column:
        heading = hit.rlike(f"(?is)^{_H}$")
        text = (
            F.when(heading, _inner(F.regexp_extract(hit, f"(?is)^{_H}$", 2)))
            .when(F.startswith(hit, F.lit("<")), _inner(F.regexp_extract(hit, f"(?is)^{_P}$", 1)))
            .otherwise(strip(hit)))

        def row(t: Column) -> Column:
            promoted = F.when(t.rlike(r"(?U)^\[\d+\]"), "reference").otherwise("paragraph")
            if bare_text:
                promoted = F.when(t.rlike(r"(?U)^(图|表)\s*\d+([\-\.]\d+)?"), "caption").otherwise(promoted)
            return F.struct(
                F.when(heading, "heading").otherwise(promoted).alias("element_type"),
                F.when(heading, F.regexp_extract(hit, f"(?is)^{_H}$", 1).try_cast("int")).otherwise(0).alias("level"),
                t.alias("content"))

        return let(text, row)

    parts = F.transform(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0)), one)
    kept = F.filter(parts, lambda e: F.length(e["content"]) > 0)
    return docs.select("doc_id", F.posexplode(kept).alias("element_index", "e")).select("doc_id", "element_index", "e.*")


def segment_html_export(docs: DataFrame, column: str = "html") -> DataFrame:
    """Variant for export: div, caption and whole tables kept, ``<br>`` is a newline."""
    pattern = r"(?is)<(h[1-6]|p|div|caption|li)[^>]*>(.*?)</\1>|(<table>.*?</table>)"
    html = F.regexp_replace(F.col(column), r"<br\s*/?>", "\n")

    def one(hit: Column) -> Column:
        tag = F.regexp_extract(hit, r"(?is)^<(h[1-6]|p|div|caption|li)", 1)
        table = hit.rlike(r"(?is)^<table>.*</table>$")
        kind = (
            F.when(table, "table").when(tag.isin("h1", "h2", "h3", "caption", "li"), tag)
            .when(tag.isin("h4", "h5", "h6"), "h3").otherwise("p"))
        text = F.when(table, hit).otherwise(strip(F.regexp_replace(
            F.regexp_extract(hit, r"(?is)^<(h[1-6]|p|div|caption|li)[^>]*>(.*)</\1>$", 2), "<[^>]+>", "")))
        return F.struct(kind.alias("type"), text.alias("text"))

    parts = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), one)
    kept = F.filter(parts, lambda e: F.length(e["text"]) > 0)
    return docs.select("doc_id", F.posexplode(kept).alias("element_index", "e")).select("doc_id", "element_index", "e.*")


def inject_css(html: Column, rules: dict[str, str] | None = None) -> Column:
    """Inline style on h1-h3 and p; an existing style attribute is extended."""
    rules = rules or {}
    sizes = {"h1": ("heading1", "16"), "h2": ("heading2", "14"), "h3": ("heading3", "12"), "p": ("body", "10.5")}
    for tag, (name, size) in sizes.items():
        style = "; ".join([
            f"font-family: {rules.get(name + '_font', '宋体')}", f"font-size: {rules.get(name + '_size', size)}pt",
            f"line-height: {rules.get('line_height', '1.5')}"])
        html = F.regexp_replace(html, rf'(?i:<{tag})((?:(?!style=)[^>])*)>', f'<{tag}\u0001$1 style="{style}">')
        html = F.regexp_replace(html, rf'(?i:<{tag})([^>\u0001]*?)style="([^">]*)"([^>]*)>', f'<{tag}$1style="$2; {style}"$3>')
        html = F.replace(html, F.lit("\u0001"), F.lit(""))
    return html


# --- extracted pages and tables ----------------------------------------------

def likely_heading(t: Column) -> Column:
    return (F.length(t) <= 50) & (
        t.rlike("^[一二三四五六七八九十]+、") | t.rlike(r"(?U)^第[一二三四五六七八九十\d]+[章节篇部]")
        | (t.rlike(r"(?U)^\d+(\.\d+)*\s") & (F.length(t) < 40))
        | ((F.length(t) < 25) & ~t.rlike("[，。！？；：]")))


def page_line_type(t: Column) -> Column:
    kind = lambda n, lv: F.struct(F.lit(n).alias("element_type"), F.lit(lv).alias("level"))
    return (
        F.when(t.rlike(r"(?U)^第[一二三四五六七八九十\d]+[章节篇部]"), kind("heading", 1))
        .when(t.rlike("^[一二三四五六七八九十]+、"), kind("heading", 1))
        .when(t.rlike("^（[一二三四五六七八九十]+）"), kind("heading", 2))
        .when(t.rlike(r"(?U)^\d+\.\s") & (F.length(t) < 50), kind("heading", 3))
        .when(t.rlike(r"(?U)^（\d+）"), kind("heading", 4))
        .when(t.rlike(r"(?U)^\[[\d,\-–]+\]"), kind("reference", 0))
        .when(t.rlike(r"(?U)^(图|表|Figure|Table)\s*[\d\-–]"), kind("caption", 0))
        .otherwise(kind("paragraph", 0)))


def merge_page_lines(lines: DataFrame) -> DataFrame:
    """Lines ``(doc_id, page, line, text)`` to paragraphs: blank lines and
    heading-like lines break, other lines join with a space."""
    t = strip(F.col("text"))
    rows = lines.select("doc_id", "page", "line", t.alias("t")).withColumn(
        "alone", (F.length("t") > 0) & likely_heading(F.col("t"))).withColumn("cut", F.col("alone") | (F.length("t") == 0))
    rows = running_sum(rows, ["doc_id", "page"], ["line"], [F.floor(F.col("line") / F.lit(8192))], cuts=F.col("cut").cast("int"))
    rows = rows.filter(F.length("t") > 0)
    paragraphs = rows.groupBy("doc_id", "page", "cuts", "alone").agg(
        F.min("line").alias("first_line"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), " ").alias("content"))
    return paragraphs.select("doc_id", "page", "first_line", "content", page_line_type(F.col("content")).alias("k")).select(
        "doc_id", "page", "first_line", "k.element_type", "k.level", "content")


def tables_kept(cells: DataFrame) -> DataFrame:
    """Rows with any content, and how many cells they have."""
    filled = F.length(F.coalesce(strip(F.col("content")), F.lit(""))) > 0
    return cells.groupBy("doc_id", "table_index", "row").agg(F.bool_or(filled).alias("keep"), F.count("*").alias("n_cells")).filter("keep")


def tables_from_cells(cells: DataFrame) -> DataFrame:
    """Size, header row and caption per table; rows without any content drop out."""
    return tables_kept(cells).groupBy("doc_id", "table_index").agg(
        F.count("*").alias("num_rows"), F.max("n_cells").alias("num_cols"), F.min("row").alias("header_row")
    ).withColumn("caption", F.concat(F.lit("表"), F.col("doc_id").cast("string"), F.lit("-"), F.col("table_index").cast("string")))


def rows_from_cells(cells: DataFrame) -> DataFrame:
    """The cells of the kept rows, trimmed; those of a sheet's row ``1`` are headers."""
    kept = tables_kept(cells)
    return cells.join(kept, ["doc_id", "table_index", "row"], "left_semi").select(
        "doc_id", "table_index", "row", "col", F.coalesce(strip(F.col("content")), F.lit("")).alias("content"), (F.col("row") == 1).alias("is_header"))


# --- files -------------------------------------------------------------------

def decode_bytes(content: Column) -> Column:
    """UTF-8 when valid, else GBK, GB18030, Latin-1, the first without bad bytes."""
    bad = F.lit("�")
    text = [F.decode(content, c) for c in ("GBK", "GB18030")]
    clean = [F.when(~F.contains(t, bad), t) for t in text]
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(F.regexp_replace(utf8, "^﻿", ""), *clean, F.decode(content, "ISO-8859-1"))


def route_files(files: DataFrame, path: str = "path", size: str = "length", empty: str | None = None) -> DataFrame:
    """Format per file and a reject code; accepted files have a null code."""
    ext = F.lower(F.regexp_extract(F.col(path), r"(\.[^./\\]+)$", 1))
    fmt = F.try_element_at(F.create_map(*[F.lit(x) for kv in SUPPORTED_FORMATS.items() for x in kv]), ext)
    code = (
        F.when(fmt.isNull(), "UNSUPPORTED_FORMAT").when(F.col(size) > MAX_FILE_MB * 1024 * 1024, "FILE_TOO_LARGE")
        .when(F.col(size) == 0, "EMPTY_RESULT"))
    return files.withColumn("extension", ext).withColumn("format", fmt).withColumn("reject_code", code)


def route_for_plan(files: DataFrame, entitlements: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """:func:`route_files` with the size limit of the owner's plan (``user_id`` of the file, ``file_size_mb`` of the plan, null: none)."""
    limits = entitlements.select("user_id", "file_size_mb", "tier")
    routed = route_files(files, path, size).join(limits, "user_id", "left")
    over = file_size_gate(F.col(size)) != "OK"
    keeps = F.coalesce(F.col("reject_code"), F.lit("EMPTY_RESULT")) != "EMPTY_RESULT"  # checked before the plan
    return routed.withColumn("reject_code", F.when(keeps, F.col("reject_code")).when(over, F.lit("FILE_TOO_LARGE_FOR_PLAN")).otherwise(F.col("reject_code")))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Text files of unknown encoding as one row per file."""
    files = route_files(spark.read.format("binaryFile").load(path))
    return files.filter("reject_code IS NULL").select(
        F.xxhash64("path").alias("doc_id"), "path", "format", decode_bytes(F.col("content")).alias("text"))


def area_sizes(files: DataFrame, depth: int = 1) -> DataFrame:
    """Bytes per data area (leading path part)."""
    area = F.regexp_extract("path", rf"^((?:[^/]+/){{{depth}}})", 1)
    return files.groupBy(area.alias("area")).agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))
