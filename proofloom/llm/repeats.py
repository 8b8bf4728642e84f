"""Long exact repeats by a run-length index: byte strings of a given length that occur anywhere else are taken out of all texts.

Anchors (minima of a rolling hash) cut each document into segments such that equal long strings lie in segments with equal
anchors. Segments whose anchor occurs once are unique and go no further. Those of a shared anchor meet in one group, where a
run-compressed Burrows-Wheeler transform with sampled run ends gives the matching statistics of every position. Groups of many
segments are cut by where the anchor stands in the windows, until each group is small: equal windows have it at the same place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from proofloom.llm.common import column, small, stored

#: Bytes of a repeat, and of the strings whose hash makes an anchor (a power of two, at most half as long).
LENGTH, GRAM = 400, 128
#: Window starts hashed at once, bytes indexed at once, and distinct strings indexed as one group; larger groups are cut.
BLOCK, BATCH, PART = 1 << 20, 1_000_000, 1024
_MIX = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_STEPS = np.random.default_rng(12).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 21) - 1)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every string of ``gram`` bytes, by doubling."""
    h, size = _MIX[data], 1
    while size < gram:
        h = h[:-size] * _STEPS[size.bit_length()] + h[size:]
        size *= 2
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def segments(text: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int]]:
    """(anchor, begin, end) of the segments of a text: every window of ``length`` bytes lies in exactly one of them, that of its
    anchor, the first of the smallest gram hashes inside the window. Equal windows have equal anchors wherever they stand."""
    span = length - gram + 1  # grams in a window
    for base in range(0, len(text) - length + 1, BLOCK):
        starts = min(BLOCK, len(text) - length + 1 - base)
        h = _gram_hashes(np.frombuffer(text, np.uint8, starts + length - 1, base), gram)
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)  # hash first, then place: the minimum is the first of the smallest
        size = 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if span > size:
            low = np.minimum(low[:starts], low[span - size:span - size + starts])
        place = (low[:starts] & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], starts) - 1
        for anchor, a, b in zip(h[place[first]].view(np.int64).tolist(), first.tolist(), last.tolist()):
            yield anchor, base + a, base + b + length


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some byte strings with suffix samples at the ends of runs.

    Inside a run the longest common prefix with a neighbour in suffix order is one less than at the position before, so only
    run ends are compared and the matching statistics of all other positions follow by streaming through the text.
    """

    def __init__(self, parts: list[bytes]) -> None:
        sizes = np.array([len(p) + 1 for p in parts])
        self.begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        n = int(sizes.sum())
        raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        ends = self.begins + sizes - 1
        self.symbols = raw.astype(np.int16) + 1
        self.symbols[ends] = 0
        part = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        # ranks of the first 7 symbols; where an end is among them the part tells, so ends are all different
        padded = np.concatenate((self.symbols, np.zeros(7, np.int16))).astype(np.uint64)
        left = np.repeat(ends, sizes) - np.arange(n)
        key = np.zeros(n, np.uint64)
        for k in range(7):
            key = (key << np.uint64(9)) | np.where(left >= k, padded[k:k + n], 0)
        order = np.lexsort((np.where(left < 7, part, -1), key))
        fresh = np.ones(n, bool)
        fresh[1:] = (key[order[1:]] != key[order[:-1]]) | ((left[order[1:]] < 7) & (part[order[1:]] != part[order[:-1]]))
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(fresh) - 1
        self.levels, size = [(7, rank)], 7
        while not fresh.all():
            after = np.zeros(n, np.int64)
            after[:n - size] = rank[size:]
            both = rank.astype(np.int64) * n + after
            order = np.argsort(both, kind="stable")
            both = both[order]
            fresh = np.ones(n, bool)
            fresh[1:] = both[1:] != both[:-1]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(fresh) - 1
            size *= 2
            self.levels.append((size, rank))
        self.suffixes = order
        before = np.where(order > 0, self.symbols[order - 1], 0)
        change = (before[1:] != before[:-1]) | (before[1:] == 0)  # ends are all different
        self.heads = np.flatnonzero(change) + 1  # first row of each run but the first; the row above is the last of a run
        self.runs = len(self.heads) + 1

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes, by the ranks of each doubling."""
        done, n = np.zeros(len(a), np.int64), len(self.symbols)
        for size, rank in reversed(self.levels):
            x, y = a + done, b + done
            fits = np.maximum(x, y) < n
            same = fits & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
            done += size * same
        live = np.ones(len(a), bool)
        for _ in range(6):
            x, y = a + done, b + done
            live &= np.maximum(x, y) < n
            sx = self.symbols[np.minimum(x, n - 1)]
            live &= (sx == self.symbols[np.minimum(y, n - 1)]) & (sx > 0)
            done += live
        return done

    def statistics(self) -> np.ndarray:
        """For each position the length of the longest string that begins there and also begins elsewhere."""
        n = len(self.symbols)
        above, below = self.suffixes[self.heads - 1], self.suffixes[self.heads]
        shared = self.common(above, below)
        best = np.zeros(n, np.int64)
        for sampled, edge in ((below, self.suffixes[0]), (above, self.suffixes[-1])):
            value = np.full(n, -1, np.int64)
            value[sampled] = shared
            value[edge] = 0
            last = np.maximum.accumulate(np.where(value >= 0, np.arange(n), 0))
            best = np.maximum(best, value[last] - (np.arange(n) - last))
        return best

    def repeats(self, length: int) -> list[list[tuple[int, int]]]:
        """Per string the (begin, end) of what strings of ``length`` bytes that begin elsewhere too cover."""
        long = np.flatnonzero(self.statistics() >= length)
        out: list[list[tuple[int, int]]] = [[] for _ in self.begins]
        if len(long):
            cut = np.flatnonzero(np.diff(long) > 1)
            for a, b in zip(long[np.concatenate(([0], cut + 1))].tolist(), long[np.append(cut, len(long) - 1)].tolist()):
                k = int(np.searchsorted(self.begins, a, "right")) - 1
                out[k].append((a - int(self.begins[k]), b - int(self.begins[k]) + length))
        return out


SEGMENT = "struct<anchor:long,c1:long,c2:long,size:int,begins:array<int>>"


def _long(x: int) -> int:
    return x - (x >> 63 << 64)


def _segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``doc_id``, ``key``, ``found``: the segments of each text of at least ``length`` bytes, equal ones of a document together."""
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("size", pa.int32()), ("begins", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(2):
                text, own = x.as_py(), {}
                for anchor, a, b in segments(text, length, gram):
                    own.setdefault((anchor, xxh3_128_intdigest(text[a:b]), b - a), []).append(a)
                out.append([{"anchor": k, "c1": _long(c >> 64), "c2": _long(c & (1 << 64) - 1), "size": s, "begins": begins} for (k, c, s), begins in own.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["doc_id", "key", "found"])

    return docs.where(F.octet_length("text") >= length).mapInArrow(run, f"doc_id long, key long, found array<{SEGMENT}>")


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of ``wanted`` (doc_id, key, begin, size, ...) segments, one representative of each."""
    by_doc = stored(wanted.groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "c1", "c2", "begin", "size", "kinds")).alias("cuts"))
                    .withColumnsRenamed({"doc_id": "__id", "key": "__key"}), "cuts")
    keys = small(by_doc.select("__id", "__key"))
    same = docs["doc_id"].eqNullSafe(by_doc["__id"]) & (docs["key"] == by_doc["__key"])
    holders = docs.join(keys, docs["doc_id"].eqNullSafe(keys["__id"]) & (docs["key"] == keys["__key"]), "left_semi").dropDuplicates(["doc_id", "key"])
    cut = holders.join(by_doc, same).select("text", F.explode("cuts").alias("c"))
    return cut.select("c.anchor", "c.c1", "c.c2", "c.kinds", F.substring(F.col("text").cast("binary"), F.col("c.begin") + 1, F.col("c.size")).alias("bytes"))


def _cut(pieces: DataFrame, length: int, gram: int, width: int) -> DataFrame:
    """``pieces`` (anchor, c1, c2, start, place, bytes) cut so that in one cut the anchor stands at ``width`` neighbouring places of the windows.

    ``g1``, ``g2`` hash what all windows of a cut share, ``p1``, ``p2`` the whole cut. Every window lies in one cut of its piece,
    and equal windows in cuts of equal ``g1``, ``g2``; at width 1 a cut is a window.
    """
    kinds = {"anchor": pa.int64(), "c1": pa.int64(), "c2": pa.int64(), "start": pa.int32(), "place": pa.int32(), "size": pa.int32(),
             "g1": pa.int64(), "g2": pa.int64(), "p1": pa.int64(), "p2": pa.int64(), "bytes": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, c1, c2, start, place, data in zip(*(c.to_pylist() for c in batch.columns)):
                if place is None:  # a whole segment: that of its first window
                    place = int(np.argmin(_gram_hashes(np.frombuffer(data, np.uint8, length), gram) & ~_PLACE))
                near, last = place - start, len(data) - length
                for k in range((near - last) // width, near // width + 1):
                    high = near - k * width  # the last start of a window in this cut, if the piece goes so far
                    a, b = max(0, high - width + 1), min(last, high)
                    g = xxh3_128_intdigest(b"%d %d " % (anchor, k) + data[high:high - width + 1 + length])
                    p = xxh3_128_intdigest(data[a:b + length])
                    out.append((anchor, c1, c2, start + a, place, b - a + length, *(_long(x) for h in (g, p) for x in (h >> 64, h & (1 << 64) - 1)), data[a:b + length]))
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))

    schema = "anchor long, c1 long, c2 long, start int, place int, size int, g1 long, g2 long, p1 long, p2 long, bytes binary"
    return pieces.select("anchor", "c1", "c2", "start", "place", "bytes").mapInArrow(run, schema)


SPANS = "anchor long, c1 long, c2 long, spans array<struct<begin:int,end:int>>"


def _indexed(rows: DataFrame, length: int) -> DataFrame:
    """``anchor``, ``c1``, ``c2``, ``spans``: what repeats in ``rows`` (g1, g2, anchor, c1, c2, start, bytes) of one group. Whole groups are indexed together, several small ones at once."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group, size = None, 0

        def flush() -> pa.RecordBatch:
            found = RunLengthIndex([h[4] for h in held]).repeats(length)
            rows = [(h, f) for h, f in zip(held, found) if f]
            return pa.RecordBatch.from_arrays([*(pa.array([h[k] for h, _ in rows], pa.int64()) for k in range(3)),
                                               pa.array([[{"begin": h[3] + a, "end": h[3] + b} for a, b in f] for h, f in rows], kind)], ["anchor", "c1", "c2", "spans"])

        for batch in batches:
            for g1, g2, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (g1, g2) != group and size >= BATCH:
                    yield flush()
                    held, size = [], 0
                group = (g1, g2)
                held.append(tuple(row))
                size += len(row[4]) + 1
        if held:
            yield flush()

    groups = rows.select("g1", "g2", "anchor", "c1", "c2", "start", "bytes").repartition("g1", "g2").sortWithinPartitions("g1", "g2")
    return groups.mapInArrow(run, SPANS)


def _matched(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """``anchor``, ``c1``, ``c2``, ``spans``: what repeats inside each of the ``wanted`` segments.

    A group of more than PART segments is cut, and its cuts meet in finer groups: those alone in theirs are unique, equal ones
    repeat whole, and one of each kind is indexed, or cut again if they are still too many. Each segment leaves a few cuts a
    round, so the work grows with the segments; cuts of one window are all equal, so the rounds end.
    """
    start = F.lit(0).alias("start")
    found = [_indexed(_fetched(docs, wanted.where(F.col("kinds") <= PART)).select("anchor", "c1", "c2", F.col("anchor").alias("g1"), F.lit(0).cast("long").alias("g2"), start, "bytes"), length)]
    large = wanted.where(F.col("kinds") > PART)
    if not large.isEmpty():
        pieces = _fetched(docs, large).select("anchor", "c1", "c2", start, F.lit(None).cast("int").alias("place"), "bytes")
        width = 1
        while 8 * width <= length - gram + 1:
            width *= 4
        while width:
            cuts = stored(_cut(pieces, length, gram, width), "cuts")
            same = stored(cuts.groupBy("g1", "g2", "p1", "p2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("anchor", "c1", "c2", "start")).alias("at")), "same")
            copied = cuts.join(small(same.where("n > 1").select("g1", "g2", "p1", "p2")), ["g1", "g2", "p1", "p2"])
            found.append(copied.select("anchor", "c1", "c2", F.array(F.struct(F.col("start").alias("begin"), (F.col("start") + F.col("size")).alias("end"))).alias("spans")))
            groups = stored(same.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "groups")
            chosen = same.join(small(groups), ["g1", "g2"]).select("at.*", "kinds")
            kept = stored(cuts.join(chosen, ["anchor", "c1", "c2", "start"]), "kept")
            found.append(_indexed(kept.where(F.col("kinds") <= PART), length))
            pieces = kept.where(F.col("kinds") > PART)
            width = 0 if pieces.isEmpty() else width // 4
    return reduce(DataFrame.unionByName, found).groupBy("anchor", "c1", "c2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The slim documents (doc_id, key, text; a null text is empty), and doc_id, key, ``spans`` of the repeats of those that have any.

    Spans are begin and end in bytes of UTF-8 and may overlap. Strings are compared within and across all documents, never over
    the end of one.
    """
    gram = gram or min(GRAM, 1 << ((length // 2).bit_length() - 1))
    text = F.coalesce(column(docs, text_col), F.lit(""))
    slim = docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))
    every = stored(_segments(slim, length, gram), "segments").select("doc_id", "key", F.explode("found").alias("s")).select("doc_id", "key", "s.*")
    shared = stored(every.groupBy("anchor").agg(F.sum(F.size("begins")).alias("n")).where("n > 1").select("anchor"), "shared")
    held = stored(every.join(small(shared), "anchor"), "held")
    # copies of a segment repeat all of it; what is left to the index is one representative of each distinct segment of a mixed anchor
    distinct = stored(held.groupBy("anchor", "c1", "c2", "size").agg(F.sum(F.size("begins")).alias("copies"), F.min(F.struct("doc_id", "key", F.col("begins")[0].alias("begin"))).alias("at")), "distinct")
    mixed = stored(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "mixed")
    wanted = distinct.join(small(mixed), "anchor").select("anchor", "c1", "c2", "size", "kinds", "at.doc_id", "at.key", "at.begin")
    matched = stored(_matched(slim, wanted, length, gram), "matched")
    whole = distinct.where("copies > 1").select("anchor", "c1", "c2", F.array(F.struct(F.lit(0).alias("begin"), F.col("size").alias("end"))).alias("spans"))
    once = distinct.where("copies = 1").select("anchor", "c1", "c2").join(matched, ["anchor", "c1", "c2"]).select("anchor", "c1", "c2", "spans")
    hits = held.join(whole.unionAll(once), ["anchor", "c1", "c2"])
    each = F.flatten(F.transform("begins", lambda b: F.transform("spans", lambda s: F.struct((b + s["begin"]).alias("begin"), (b + s["end"]).alias("end")))))
    return slim, stored(hits.groupBy("doc_id", "key").agg(F.flatten(F.collect_list(each)).alias("spans")), "repeats")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs, null: none) and ``kept`` (bytes left; null: all) and ``kept_sha256`` of every row.

    Every byte covered by a string of ``length`` bytes that also begins anywhere else is removed. Null and empty texts, and all
    shorter ones, lose nothing; rows that are equal in id and text are two documents and repeat each other; an empty table
    gives no rows; very long texts are hashed in blocks and only their repeated segments are indexed. What is left may not be
    valid UTF-8, so it is bytes. Other columns are ignored.
    """
    slim, found = find(docs, id_col, text_col, length, gram)
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for x, own in zip(batch.column(2), batch.column(3).to_pylist()):
                text = x.as_py()
                runs = merged([(s["begin"], s["end"]) for s in own])
                edges = [0, *(e for r in runs for e in r), len(text)]
                spans.append([{"begin": a, "end": b} for a, b in runs])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array([sha256(k).hexdigest() for k in kept])],
                                             ["__id", "__key", "spans", "kept", "sha"])

    keys = small(found.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")))
    holders = slim.join(keys, slim["doc_id"].eqNullSafe(keys["__id"]) & (slim["key"] == keys["__key"]), "left_semi").dropDuplicates(["doc_id", "key"])
    marked = holders.join(found, holders["doc_id"].eqNullSafe(found["doc_id"]) & (holders["key"] == found["key"])).select(holders["doc_id"], holders["key"], "text", "spans")
    left = marked.mapInArrow(run, "__id long, __key long, spans array<struct<begin:int,end:int>>, kept binary, sha string")
    rows = slim.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    joined = rows.join(left, rows["doc_id"].eqNullSafe(left["__id"]) & (rows["key"] == left["__key"]), "left")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return joined.select("doc_id", "n_bytes", F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"), "spans", "kept", F.coalesce("sha", "whole").alias("kept_sha256"))
