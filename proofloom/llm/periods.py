"""Periodic runs of words by recursive frequency splitting: words too rare for a run split their segment until nothing changes, and
the segments left are scanned for lags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.llm import words as W
from proofloom.llm.common import column

#: Words of the shortest run, and periods that a run has at least.
LEAST, TIMES = 24, 3
#: U+0020 and U+0009 to U+000D.
SPACES = W.separators(b" \t\n\v\f\r")


def segments(codes: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that may be part of a run, ascending, and the segment of each.

    All words of a run stand in it at least ``times`` times. So a word with fewer occurrences in its segment splits it, and
    segments of fewer than ``least`` words go. The parts are counted again until no word goes. Texts are segments to begin with.
    """
    place, segment = np.arange(len(codes)), text
    while len(place):
        key = segment * (int(codes.max()) + 1) + codes[place]
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.diff(key[order], prepend=-1))
        count = np.empty(len(key), np.int64)
        count[order] = np.repeat(np.diff(np.append(new, len(key))), np.diff(np.append(new, len(key))))
        stays = count >= times
        kept, parent = place[stays], segment[stays]
        fresh = np.ones(len(kept), bool)
        fresh[1:] = (kept[1:] != kept[:-1] + 1) | (parent[1:] != parent[:-1])
        part = np.cumsum(fresh) - 1
        long = (np.bincount(part) >= least)[part] if len(part) else np.zeros(0, bool)
        if stays.all() and long.all():
            break
        place, segment = kept[long], part[long]
    return place, segment


def lag_scan(codes: np.ndarray, place: np.ndarray, segment: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs in some segments, by start, then period.

    Lags above K/2 and up to K, K = 1, 2, 4, ..., are scanned together by the groups of K words that begin at each place: inside a
    run, which has three periods, the next equal group stands exactly one period on, and a stretch of places with the same lag
    is the whole run. Groups that stand once in their segment are part of no longer period and go before K doubles.
    """
    found: list[np.ndarray] = []
    limit = np.zeros(len(codes) + 1, np.int64)  # where the segment of a place ends
    if len(place):
        last = np.flatnonzero(np.append(np.diff(segment) != 0, True))
        sizes = np.diff(np.append(-1, last))
        limit[place] = np.repeat(place[last] + 1, sizes)
        key, longest, size, at = segment * (int(codes.max()) + 1) + codes[place], int(sizes.max()), 1, place
    while len(place) and len(at) and size < 2 * (longest // times) + 1:
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        lag = np.zeros(len(at), np.int64)
        lag[order[:-1][same]] = (at[order[1:]] - at[order[:-1]])[same]
        near = np.flatnonzero((2 * lag > size) & (lag <= size))
        if len(near):
            begin, step = at[near], lag[near]
            head = np.flatnonzero(np.append(True, (np.diff(begin) != 1) | (np.diff(step) != 0)))
            tail = np.append(head[1:], len(begin)) - 1
            length = begin[tail] - begin[head] + step[head] + size
            runs = length >= np.maximum(least, times * step[head])
            found.append(np.stack([begin[head], length, step[head]], 1)[runs])
        # names of the groups that stand more than once, then of pairs of them
        name = np.empty(len(at), np.int64)
        name[order] = np.cumsum(np.append(True, ~same)) - 1
        often = np.bincount(name) > 1
        known = np.full(len(codes) + 1, -1, np.int64)
        alive = often[name]
        at, name = at[alive], name[alive]
        known[at] = name
        second = known[np.minimum(at + size, len(codes))]
        size *= 2
        whole = (second >= 0) & (at + size <= limit[at])
        at, key = at[whole], name[whole] * len(often) + second[whole]
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _found(batch: pa.RecordBatch, least: int, times: int) -> pa.RecordBatch:
    words = W.cut(batch.column(1), SPACES)
    n, begins = len(words.codes), words.begins
    start, length, period = lag_scan(words.codes, *segments(words.codes, words.text, least, times), least, times)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.cumsum(edge)[:n] == 0
    owner = np.searchsorted(begins, start, "right") - 1
    runs = pa.StructArray.from_arrays([pa.array(start - begins[owner]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    left = np.concatenate(([0], np.cumsum(kept)))[begins]
    texts = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.values.take(pa.array(words.codes[kept])))
    return pa.RecordBatch.from_arrays([
        batch.column(0), pa.array(np.diff(begins)), pa.ListArray.from_arrays(pa.array(np.searchsorted(start, begins).astype(np.int32)), runs),
        pc.binary_join(texts, b" ").cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def runs(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (structs of ``start``, ``length`` and ``period`` in words, by start, then period) and
    ``collapsed`` (the words that are in no run after its first period, joined by a space) of every row of ``docs``.

    A run is a stretch of consecutive words with a smallest period q, of at least ``least`` words and ``times`` periods (three or
    more), that no neighbouring word extends. Null and empty texts have no words and no runs; repeated rows are rows of their own;
    an empty table gives none; only the id and ``text`` (default: the column ``text``) are read. Rows are independent, so there is
    no shuffle; some megabytes of text are worked on at once, a longer text alone.
    """
    if times < 3:
        raise ValueError("a run has three periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, 1):
            yield _found(part, least, times)

    text = column(docs, "text") if text is None else text
    slim = docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(found: Column) -> Column:
    """The run with the greatest length in periods, compared exactly; ties to the smallest start, then period. No runs: null."""
    def order(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(x > y, -1).when(x < y, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))

    return F.get(F.array_sort(found, order), F.lit(0))


def listed(found: Column) -> Column:
    """All runs as lines ``start,length,period``."""
    return F.array_join(F.transform(found, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
