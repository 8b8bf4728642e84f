"""Collocations of two to five words: suffix pointers are routed by their leading words and sorted by multikey three-way quicksort,
where the size of an equal partition is the count of a phrase and partitions below the least count are abandoned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as Win
from xxhash import xxh3_64_intdigest

from proofloom.llm import words as W
from proofloom.llm.common import column, stored

#: Words of the longest phrase, least count, phrases reported per language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: A phrase goes with a longer one around it that has at least this share (in percent) of its count.
SHARE = 100
#: Pieces end at `.,;:!?` and line ends, words at spaces and tabs.
KINDS = W.separators(b" \t", b".,;:!?\n\v\f\r")
#: Bytes of text cut at once, and rows sorted at once.
SLICE, ROWS = 8 << 20, 400_000
#: Bits of the map that tells frequent leading pairs: 16 MB, however large the corpus. Pairs that share a bit are kept, never dropped.
MAP_BITS = 27
#: A leading pair that opens more pointers than this (or a 2^20th of all pairs) is routed by its first DEEP words. So at most 2^20 pairs are.
HOT, DEEP = 1 << 16, 4
#: Routes for each shuffle partition.
ROUTES = 8
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def _cut(batch: pa.RecordBatch) -> tuple[W.Words, np.ndarray, pa.Array]:
    """Words of a batch (lang, text), the number of each word's language, and the languages."""
    words, langs = W.cut(batch.column(1), KINDS, lower=True), batch.column(0).dictionary_encode()
    return words, langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.text], langs.dictionary


def _hashes(values: pa.Array) -> np.ndarray:
    return np.array([xxh3_64_intdigest(v) for v in values.cast(pa.binary()).to_pylist()], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def _pairs(words: W.Words, lang: np.ndarray, langs: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next word is of the same piece, and a 64-bit hash of the two words and the language. ``known``: hashes of the words."""
    at = np.flatnonzero(~words.first[1:])
    h = (_hashes(words.values) if known is None else known)[words.codes]
    return at, _mixed(h[at] * _ODD[0] + h[at + 1] * _ODD[2] + _hashes(langs)[lang[at]]) if len(at) else np.zeros(0, np.uint64)


def _bucket(pair: np.ndarray) -> np.ndarray:
    """Which of 2^32 counters a pair has."""
    return (pair >> np.uint64(32)).astype(np.int64)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, word, n), counts of a slice."""
    for part in W.slices(batches, 1, SLICE):
        words, lang, langs = _cut(part)
        key, n = np.unique(lang * max(1, len(words.values)) + words.codes, return_counts=True)
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(key // max(1, len(words.values)))), words.values.take(pa.array(key % max(1, len(words.values)))).cast(pa.string()), pa.array(n)], ["lang", "word", "n"])


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (bucket, n): how many neighbouring words of a slice fall into each counter."""
    for part in W.slices(batches, 1, SLICE):
        bucket, n = np.unique(_bucket(_pairs(*_cut(part))[1]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], ["bucket", "n"])


def pointers(batch: pa.RecordBatch, often: np.ndarray, hot: np.ndarray, longest: int = LONGEST, routes: int = 64) -> pa.RecordBatch:
    """Distinct suffixes of a slice, up to ``longest`` words of one piece or up to the first infrequent pair, with their counts, in
    one packet for each route, language and kind.

    ``route``: by a hash of language and leading pair, of the first DEEP words where the pair is hot (``spread``). ``often``: the bits
    of frequent pairs; ``hot``: sorted counters of hot pairs.
    """
    words, lang, langs = _cut(batch)
    known = _hashes(words.values)
    at, pair = _pairs(words, lang, langs, known)
    bit = _bucket(pair) & ((1 << MAP_BITS) - 1)
    good = (often[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
    at, pair = at[good], pair[good]
    goes_on = np.zeros(len(words.codes) + longest, bool)
    goes_on[at] = True
    size, on = np.ones(len(at), np.int64), np.ones(len(at), bool)
    rows = np.full((len(at), longest), -1, np.int64)
    rows[:, 0] = words.codes[at]
    for k in range(1, longest):
        on &= goes_on[at + k - 1]
        size += on
        rows[on, k] = words.codes[at[on] + k]
    order = np.lexsort([*rows.T[::-1], lang[at]])
    rows, size, tongue, pair = rows[order], size[order], lang[at][order], pair[order]
    new = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(1) | (tongue[1:] != tongue[:-1]))) if len(rows) else np.zeros(0, np.int64)
    n = np.diff(np.append(new, len(rows)))
    rows, size, tongue, pair = rows[new], size[new], tongue[new], pair[new]
    bucket, deep = _bucket(pair), pair
    spread = hot[np.minimum(np.searchsorted(hot, bucket), len(hot) - 1)] == bucket if len(hot) else np.zeros(len(bucket), bool)
    for k in range(2, min(DEEP, longest)):
        deep = np.where(rows[:, k] >= 0, _mixed(deep * _ODD[0] + known[rows[:, k]]), deep) if len(known) else deep
    route = (np.where(spread, deep, pair) % np.uint64(routes)).astype(np.int64)
    order = np.lexsort([tongue, spread, route])  # stable: suffixes stay in order
    route, spread, tongue = route[order], spread[order], tongue[order]
    new = np.flatnonzero(np.append(True, (np.diff(route) != 0) | (spread[1:] != spread[:-1]) | (np.diff(tongue) != 0))) if len(route) else order
    bounds = pa.array(np.append(new, len(route)).astype(np.int32))
    return pa.RecordBatch.from_arrays([
        pa.array(route[new]), pa.array(spread[new]), langs.take(pa.array(tongue[new])),
        pa.ListArray.from_arrays(bounds, _joined(rows[order], size[order], words.values)), pa.ListArray.from_arrays(bounds, pa.array(n[order]))], ["route", "spread", "lang", "suffixes", "n"])


def _joined(rows: np.ndarray, size: np.ndarray, values: pa.Array) -> pa.Array:
    """The first words of each row, joined by a space."""
    taken = rows[np.arange(rows.shape[1])[None, :] < size[:, None]]
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), values.take(pa.array(taken)))
    return pc.binary_join(lists, b" ").cast(pa.string())


def quicksort(rows: np.ndarray, n: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(row, depth, count) of every prefix of at least ``least`` occurrences: rows of numbers, -1 behind the end, each ``n`` times.

    Multikey three-way quicksort of pointers to the rows: by the number at the current depth they fall below, into or above that of a
    pivot. The equal ones share one more number, so their weight is the count of that prefix; they are sorted one deeper. Parts whose
    weight is below ``least`` hold nothing to report and are abandoned, as are rows that have ended.
    """
    found, todo = [], [(np.arange(len(rows)), 0)]
    while todo:
        part, depth = todo.pop()
        if depth == rows.shape[1] or n[part].sum() < least:
            continue
        key = rows[part, depth]
        pivot = key[len(key) // 2]
        below, equal = key < pivot, key == pivot
        same = part[equal]
        if len(same) < len(part):
            todo += [(part[below], depth), (part[~(below | equal)], depth)]
        if pivot >= 0 and (count := int(n[same].sum())) >= least:
            found.append((int(same[0]), depth + 1, count))
            todo.append((same, depth + 1))
    return found


def sort_routes(batches: Iterator[pa.RecordBatch], least: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Packets, all of a route in a row, to (lang, phrase, n): whole counts of at least ``least``, and parts of the counts of phrases
    shorter than the words they were routed by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(len(b.column("n").flatten()) for b in held) >= ROWS:
            rows = pa.Table.from_batches(held).combine_chunks()
            route = rows.column("route").to_numpy()
            whole = int(np.searchsorted(route, route[-1]))  # the last route may go on
            held = rows.slice(whole).to_batches()
            if whole:
                yield _sorted(rows.slice(0, whole), least, longest)
    if held:
        yield _sorted(pa.Table.from_batches(held), least, longest)


def _sorted(table: pa.Table, least: int, longest: int) -> pa.RecordBatch:
    suffixes, packets = table.column("suffixes").combine_chunks(), table.column("n").combine_chunks()
    words, n = W.cut(suffixes.flatten().cast(pa.binary()), W.separators(b" ")), packets.flatten().to_numpy()
    langs, each = table.column("lang").combine_chunks().dictionary_encode(), pc.list_value_length(packets).to_numpy()
    tongue = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), each)
    spread = np.repeat(table.column("spread").to_numpy(), each)
    size = np.diff(words.begins)
    rows = np.full((len(size), longest), -1, np.int64)
    rows[words.text, np.arange(len(words.codes)) - words.begins[words.text]] = words.codes
    deep = min(DEEP, longest)
    found = [(r, d - 1, c) for r, d, c in quicksort(np.column_stack([tongue, rows]), n, least) if d > (deep if spread[r] else 2)]
    row, depth, count = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    for d in range(2, deep):  # what is routed deeper has its shorter phrases in many places: parts of their counts
        more = np.flatnonzero(spread & (size >= d))
        more = more[np.lexsort([*rows[more, :d].T, tongue[more]])]
        key = np.column_stack([tongue[more], rows[more, :d]])
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))) if len(more) else more
        row, depth = np.append(row, more[new]), np.append(depth, np.full(len(new), d))
        count = np.append(count, np.add.reduceat(n[more], new)) if len(new) else count
    return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(tongue[row])), _joined(rows[row], depth, words.values), pa.array(count)], ["lang", "phrase", "n"])


def counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Stored counts of all phrases of one to ``longest`` words with at least ``least`` occurrences (``lang``, ``phrase``, ``size`` in
    words, ``f``), and the words of each language (``lang``, ``n``)."""
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(column(docs, lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(column(docs, text_col), F.lit("")).cast("binary").alias("text"))
    words = stored(slim.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    pairs = stored(slim.mapInArrow(count_pairs, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "pairs")
    often = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    bit = F.col("bucket").bitwiseAND((1 << MAP_BITS) - 1)
    for r in pairs.groupBy(F.shiftright(bit, 15).alias("part")).agg(F.bitmap_construct_agg(bit.bitwiseAND(32767)).alias("bits")).collect():
        often[r.part << 12:(r.part + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    total = pairs.agg(F.sum("n")).first()[0] or 0
    hot = np.sort(np.array([r.bucket for r in pairs.where(F.col("n") > max(HOT, total >> 20)).select("bucket").collect()], np.int64))
    told, routes = spark.sparkContext.broadcast((often, hot)), ROUTES * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, 1, SLICE):
            yield pointers(part, *told.value, longest, routes)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sort_routes(batches, least, longest)

    suffixes = slim.mapInArrow(cut, "route long, spread boolean, lang string, suffixes array<string>, n array<long>").repartition("route").sortWithinPartitions("route")
    found = suffixes.mapInArrow(sort, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    single = words.where(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f")
    sizes = F.size(F.split("phrase", " ")).alias("size")
    return stored(single.unionAll(found.select("lang", "phrase", sizes, "f")), "phrases"), words.groupBy("lang").agg(F.sum("f").alias("n"))


def cut_score() -> Column:
    """floor(1000 a n / (l r)), exact for counts below 10^15: the products have up to 38 digits."""
    return F.expr("(1000 * CAST(a AS DECIMAL(15,0)) * CAST(n AS DECIMAL(18,0))) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a`` (its count), ``l``, ``r`` (counts of the two parts of
    its weakest cut), ``n`` (words of the language), ``score`` = floor(1000 a n / (l r)) at that cut.

    Phrases of two to ``longest`` words with a >= ``least`` compete; one whose words stand inside a longer phrase of at least ``share``
    percent of its count does not. Ties go to the larger count, then to the smaller phrase by bytes. Null texts are empty, a null
    language is `und`; repeated rows count each time; an empty table gives no rows; only the two columns are read.
    """
    known, totals = counts(docs, lang_col, text_col, longest, least)
    words = F.split("phrase", " ")
    long = known.where("size > 1")
    cuts = long.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), words.alias("w"), "size")
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    part = known.select("lang", "phrase", "f")
    cuts = (cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            .join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(totals, "lang"))
    best = cuts.withColumn("score", cut_score()).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda s: F.array_join(F.slice(F.col("w"), s, m), " "))))
    inside = (long.where("size > 2").withColumn("w", words).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("around")))
    left = best.join(inside, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < share * F.col("a")))
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Win.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return (few.withColumn("rank", F.row_number().over(Win.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
