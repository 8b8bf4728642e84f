"""Personal data: patterned spans, and terms that reveal them by information content, estimated from the whole corpus.

An entity is a patterned value (an address, a number). A term near it discloses it as far as seeing the term raises the chance of
the entity: pointwise mutual information of entity and term over the information content of the entity, 1 if the term never
stands without it. Entities that are mentioned once or twice borrow from what they share with others over the whole corpus:
their domain or leading digits, and the parts of their name. Terms above the threshold are spans too, in every document that
mentions the entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from proofloom.llm.common import column, small, stored, unused

KINDS = ("email", "ip", "card", "phone", "term")
#: Fixed patterns. A run of digits can only begin a match at its first digit, which keeps long runs linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Terms are runs of letters and digits in lower case, of at least this length.
TERM, LEAST_LENGTH = r"[\p{L}\p{N}]+", 3
TERMS = re.compile(TERM)
#: Terms on each side of an entity that are its context, distinct contexts from which a pair's count is taken as it is (smaller
#: ones are smoothed), and the disclosure from which a term goes.
WINDOW, SUPPORT, DISCLOSURE = 8, 3, 0.8
SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from the at signs: the run before it, then the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all patterned spans, sorted; kinds by their place in KINDS."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-3].strip("0") for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def _hash(text: str) -> int:
    h = xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (h >> 63 << 64)


def groups_of(kind: int, value: str) -> list[tuple[str, str]]:
    """What an entity shares with others: (group, the term it is a name for, or ``""``). Addresses: the domain and each part of name
    and domain but the last; numbers: their leading half."""
    value = value.lower()
    if kind == 0:
        name, domain = value.rsplit("@", 1)
        parts = {w for w in re.findall(r"\p{L}+|\p{N}+", name) + TERMS.findall(domain.rpartition(".")[0]) if len(w) >= LEAST_LENGTH}
        return [(f"@{domain}", ""), *((f"={w}", w) for w in sorted(parts))]
    if kind == 1:
        return [(f"{kind}:{value.rpartition('.')[0]}", "")]
    digits = re.sub("[^0-9]", "", value)
    return [(f"{kind}:{digits[:len(digits) // 2]}", "")]


def contexts(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[dict], list[str]]:
    """Each mention's entity, context (hash of the terms around it) and distinct terms; and all distinct terms of the text.
    Terms inside patterned spans are left out."""
    terms, starts, k = [], [], 0
    for m in TERMS.finditer(text):
        while k < len(spans) and spans[k][2] <= m.start():
            k += 1
        if m.end() - m.start() >= LEAST_LENGTH and not any(a < m.end() and m.start() < b for a, _, b in spans[k:k + 4]):
            terms.append(m[0].lower())
            starts.append(m.start())
    mentions, at = [], 0
    for a, kind, b in spans:
        while at < len(starts) and starts[at] < a:
            at += 1
        near = terms[max(0, at - WINDOW):at + WINDOW]
        entity = _hash(f"{kind}:{text[a:b].lower()}")
        groups = [{"id": entity, "part": ""}, *({"id": _hash(g), "part": part} for g, part in groups_of(kind, text[a:b]))]
        mentions.append({"entity": entity, "context": _hash(" ".join(near)), "terms": sorted(set(near)), "groups": groups})
    return mentions, sorted(set(terms))


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over all texts: spans of every row, and mentions and terms of rows that have spans."""
    kinds = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("terms", pa.list_(pa.string())),
                               ("groups", pa.list_(pa.struct([("id", pa.int64()), ("part", pa.string())])))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, mentions, terms = [], [], []
            for x in batch.column(2):
                text = x.as_py() or ""
                found = base_spans(text)
                near, every = contexts(text, found) if found else ([], [])
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found])
                mentions.append(near)
                terms.append(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPANS), pa.array(mentions, kinds), pa.array(terms, pa.list_(pa.string()))],
                                             ["doc_id", "key", "spans", "mentions", "terms"])

    text = column(docs, text_col)
    slim = docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    return slim.mapInArrow(run, f"doc_id long, key long, spans {SPANS}, mentions array<struct<entity:long,context:long,terms:array<string>,groups:array<struct<id:long,part:string>>>>, terms array<string>")


def disclosing(base: DataFrame, docs: DataFrame, text_col: str = "text", support: int = SUPPORT, threshold: float = DISCLOSURE) -> DataFrame:
    """``entity``, ``term``, ``disclosure`` of the pairs at or above the threshold.

    n(e), n(e, t): distinct contexts of the entity, and those with the term; n(t), N: distinct texts of the whole corpus with the
    term, and all of them; so copies count once everywhere. disclosure = ln(n(e, t) N / (n(e) n(t))) / ln(N / n(e)).

    The same is estimated over each group g of the entity (domain, leading digits, parts of its name), with n(g) and n(g, t) in
    place of n(e) and n(e, t) above the bar, for the terms that stand near the entity; the largest value is taken. A pair seen r
    times, r < ``support``, counts as Good and Turing have it, (r + 1) times the pairs seen r + 1 times over those seen r times in
    this corpus, so a chance meeting weighs little; a term that is itself a part of the entity's name is no chance meeting and
    counts in full.
    """
    said = base.select(F.explode("mentions").alias("m")).select("m.*").groupBy("entity", "context").agg(F.first("terms").alias("terms"), F.first("groups").alias("groups"))
    said = stored(said, "said")
    total = base.select("key").distinct().count()
    grouped = said.select("entity", "context", "terms", F.explode("groups").alias("g")).select("entity", "context", "terms", F.col("g.id").alias("group"), F.col("g.part").alias("part"))
    once = stored(grouped.groupBy("group", "context").agg(F.first("part").alias("part"), F.first("terms").alias("terms")), "once")
    seen = once.groupBy("group").agg(F.count(F.lit(1)).alias("seen"))
    pairs = once.select("group", "part", F.explode("terms").alias("term")).groupBy("group", "term").agg(F.count(F.lit(1)).alias("both"), F.max(F.col("part") == F.col("term")).alias("named"))
    pairs = stored(pairs, "pairs")
    times = dict(pairs.where(~F.col("named") & (F.col("both") <= support)).groupBy("both").count().collect())
    count = F.col("both").cast("double")
    for r in range(1, support):
        smooth = min(float(r), (r + 1) * times.get(r + 1, 0) / times[r]) if times.get(r) else 0.0
        count = F.when(~F.col("named") & (F.col("both") == r), F.lit(smooth)).otherwise(count)
    # a term passes only if n(t) is at most this (a group's entity is no rarer than one context); its texts among those with
    # entities are a first part of n(t), so common words fall out here and the corpus is searched for the few others
    most = F.col("count") * F.lit(float(total)) / F.col("seen") * F.pow(F.lit(float(max(total, 1))), F.lit(-threshold)) * F.pow(F.col("seen"), F.lit(threshold))
    pairs = pairs.withColumn("count", count).where("count > 0").join(seen, "group").where(most >= 1 - 1e-9)
    beside = base.where(F.size("spans") > 0).dropDuplicates(["key"]).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("beside"))
    pairs = stored(pairs.join(beside, "term", "left").where(F.coalesce("beside", F.lit(0)) <= most * (1 + 1e-9)).select("group", "term", "count", "both", "seen"), "pairs")
    known = stored(pairs.select("term").distinct(), "terms")
    if known.isEmpty():
        return said.select("entity", F.lit("").alias("term"), F.lit(0.0).alias("disclosure")).limit(0)
    words = docs.select(F.xxhash64(column(docs, text_col)).alias("key"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(column(docs, text_col)), F.lit(TERM), 0))).alias("term"))
    held = words.join(small(known, 100_000), "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("held"))
    pairs = stored(pairs.join(held, "term", "left"), "told")
    own = said.groupBy("entity").agg(F.count(F.lit(1)).alias("own"))
    near = grouped.select("entity", "group", F.explode("terms").alias("term")).join(small(known, 100_000), "term").distinct()
    held_ = F.greatest(F.coalesce(F.col("held"), F.col("both")), F.col("both"))
    rare = F.log(F.lit(total) / F.col("own"))
    ratio = F.when(rare > 0, F.log(F.col("count") * total / (F.col("seen") * held_)) / rare).otherwise(F.lit(0.0))
    found = near.join(pairs, ["group", "term"]).join(own, "entity").select("entity", "term", ratio.alias("disclosure"))
    return found.groupBy("entity", "term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= threshold)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, threshold: float = DISCLOSURE) -> DataFrame:
    """``doc_id``, ``key`` (hash of the text), ``base`` (patterned spans) and ``spans`` (these and disclosing terms) of every row.

    Spans are kind, start and end in code points, end exclusive, by start and then by kind. Null and empty texts have none;
    repeated rows have equal spans; an empty table gives no rows; long texts are read whole and in linear time. A term overlaps no
    patterned span. Only ids and texts are read from ``docs``.
    """
    base = stored(_base(docs, id_col, text_col), "base")
    named = base.where(F.size("spans") > 0)
    told = stored(disclosing(base, docs, text_col, support, threshold).select("entity", "term"), "told")
    # a document's terms meet the telling pairs by term, then the entities it mentions: linear in its words
    own = named.select("doc_id", "key", F.explode("terms").alias("term"), F.array_distinct(F.transform("mentions", lambda m: m["entity"])).alias("entities"))
    hits = own.join(small(told, 100_000), "term").where(F.array_contains("entities", F.col("entity")))
    hits = stored(hits.groupBy("doc_id", "key").agg(F.collect_set("term").alias("hidden")), "hits")
    text = column(docs, text_col)
    rows = docs.select(column(docs, id_col).cast("long").alias("__id"), F.xxhash64(text).alias("__key"), text.alias("__text"))
    marked = rows.join(small(hits, 100_000), rows["__id"].eqNullSafe(hits["doc_id"]) & (rows["__key"] == hits["key"])).select("doc_id", "key", "__text", "hidden").dropDuplicates(["doc_id", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, hidden in zip(batch.column(2), batch.column(3).to_pylist()):
                text, hidden = x.as_py(), set(hidden)
                spans, k = base_spans(text), 0
                found = list(spans)
                for m in TERMS.finditer(text):
                    while k < len(spans) and spans[k][2] <= m.start():
                        k += 1
                    if m[0].lower() in hidden and not any(a < m.end() and m.start() < b for a, _, b in spans[k:k + 4]):
                        found.append((m.start(), 4, m.end()))
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _SPANS)], ["__id", "__key", "__spans"])

    more = marked.mapInArrow(run, f"__id long, __key long, __spans {SPANS}")
    joined = base.join(more, base["doc_id"].eqNullSafe(more["__id"]) & (base["key"] == more["__key"]), "left")
    return joined.select("doc_id", "key", F.col("spans").alias("base"), F.coalesce("__spans", "spans").alias("spans"))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Patterned spans become their kind in brackets; terms with digits are generalised, each digit to #, other terms removed to [TERM]."""
    out, at = [], 0
    for kind, a, b in spans:
        if a < at:  # inside what is hidden already
            if b <= at:
                continue
            a = at
        piece = text[a:b]
        out += [text[at:a], re.sub("[0-9]", "#", piece) if kind == "term" and re.search("[0-9]", piece) else f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """``docs`` with the text redacted and its ``spans`` (an existing column of this name is replaced). A null text stays null."""
    id_, key, marks = (unused(docs, name) for name in ("id", "key", "marks"))
    found = find(docs, id_col, text_col, **kwargs).where(F.size("spans") > 0).select(F.col("doc_id").alias(id_), F.col("key").alias(key), F.col("spans").alias(marks)).dropDuplicates([id_, key])
    text = column(docs, text_col)
    joined = docs.drop("spans").join(found, column(docs, id_col).cast("long").eqNullSafe(found[id_]) & (F.xxhash64(text) == found[key]), "left")

    @F.pandas_udf("string")
    def hide(texts, spans):
        return texts.combine(spans, lambda t, s: t if t is None or s is None or not len(s) else redacted(t, [(x["kind"], x["start"], x["end"]) for x in s]))

    return joined.withColumn(text_col, hide(F.col("`" + text_col + "`"), F.col(marks))).withColumn("spans", F.coalesce(marks, F.array().cast(SPANS))).drop(id_, key, marks)
