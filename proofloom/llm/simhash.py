"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming links, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from proofloom.llm.common import column, components, small, stored, unused

BITS = 64
SEED = 42
#: Shingles hashed at once inside a document.
STEP = 1 << 15
#: Up to so many fingerprints a block is joined with itself; beyond, its pairs are searched in square pieces of CHUNK rows.
COLD, CHUNK = 32, 4096
#: Bands of the shingle sets' minima and minima in each: a pair of Jaccard similarity s meets with probability 1 - (1 - s**4)**12.
BANDS, DEPTH = 12, 4
MIX = np.random.default_rng(SEED).integers(0, 2**64, BANDS * DEPTH, np.uint64) | np.uint64(1)


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a text in UTF-8, in steps; nothing if it has no words."""
    words = text.lower().split()  # bytes: A-Z only, and U+0020, U+0009 to U+000D
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), (ends[shingle - 1:] if len(words) >= shingle else ends[-1:]).tolist()
    for k in range(0, n, STEP):
        yield np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[k:k + STEP], last[k:k + STEP])], "<u8")


def simhash(steps: Iterable[np.ndarray]) -> int:
    """Signed 64 bits: a bit is set if set in over half of all hashes; no hashes: 0."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in steps:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of a text in UTF-8: bit set if set in over half the hashed word shingles; no words: 0."""
    return simhash(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``doc_id``, ``key`` (hash of the text) and ``fp`` (signed 64 bits) of every row; a null text has no words. Other columns are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_py() for x in batch.column(2))
            fps = [0 if x is None else fingerprint(x, shingle) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "key", "fp"])

    text = column(docs, text_col)
    slim = docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, key long, fp long")


def block_masks(bits: int, distinct: int) -> list[int]:
    """Masks of the pigeonhole blocks: of ``bits + r`` pieces of the fingerprint, ``r`` stay equal in any close pair.

    More pieces make longer and more selective keys, but more of them; r follows the number of fingerprints so that a key meets
    about one random partner. Exact for every r.
    """
    cost = {r: comb(bits + r, r) * (1 + distinct / 2 ** (BITS * r / (bits + r))) for r in range(1, 6)}
    r = min(cost, key=cost.get)
    edges = [BITS * k // (bits + r) for k in range(bits + r + 1)]
    pieces = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    return [signed(sum(c)) for c in combinations(pieces, r)]


def forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all of ``fps`` (distinct, unsigned) that chains of at most ``bits`` differing bits connect.

    Breadth first: every fingerprint is compared once with those not reached yet, so a dense group shrinks at once and at most
    one link per fingerprint comes out.
    """
    rest, a, b = fps, [], []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = []
            for k in range(0, len(front), 256):
                near = np.bitwise_count(front[k:k + 256, None] ^ rest[None, :]) <= bits
                hit = near.any(axis=0)
                if hit.any():
                    a.append(front[k + near[:, hit].argmax(axis=0)])
                    b.append(rest[hit])
                    reached.append(rest[hit])
                    rest = rest[~hit]
            front = np.concatenate(reached) if reached else rest[:0]
    none = fps[:0]
    return (np.concatenate(a) if a else none), (np.concatenate(b) if b else none)


def links(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """Links ``a``, ``b`` between the distinct values of ``fp`` that connect exactly the pairs within ``bits`` bits.

    Each fingerprint goes to its pigeonhole blocks. Blocks of up to COLD fingerprints are joined with themselves and verified.
    Larger ones (large groups of near copies) are cut by a hash into chunks of about CHUNK rows, and each pair of chunks is
    searched in a task of its own that returns a spanning forest, so neither rows nor memory grow with the square of a group.
    """
    masks = block_masks(bits, distinct.count())
    keys = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).cast("int").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])).alias("x")).select("fp", "x.c", "x.key")
    shared = keys.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = stored(keys.join(shared, ["c", "key"]), "blocks")
    cold = blocks.where(F.col("n") <= COLD)
    pairs = (cold.select("c", "key", F.col("fp").alias("a")).join(cold.select("c", "key", F.col("fp").alias("b")), ["c", "key"])
             .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b"))
    hot = (blocks.where(F.col("n") > COLD).withColumn("parts", F.ceil(F.col("n") / CHUNK))
           .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
           .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
           .select("c", "key", "fp", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(np.unique(pdf["fp"].to_numpy(np.int64).view(np.uint64)), bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return pairs.unionAll(hot.groupBy("c", "key", "lo", "hi").applyInPandas(search, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """``doc_id``, ``key``, ``fp``, ``root`` (smallest fingerprint of the component) and ``component_id`` of every row.

    A-Z are lower-cased; words are split at U+0020 and U+0009 to U+000D; each run of ``shingle`` words (all words, if fewer) is
    hashed with XXH64. Fingerprints that differ in at most ``bits`` bits are linked; ``component_id`` is the smallest id
    reachable over links.

    Null and empty texts and texts of spaces have fingerprint 0 and are linked like any other. Repeated rows share their
    component; a null id stays null and counts only where its component has no other id. Very long texts are hashed in steps.
    An empty table gives an empty result. Other columns are ignored, whatever they are named.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, bits)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")  # stored, so the join can split a large component
    return fps.join(rooted.join(ids, "root"), "fp").select("doc_id", "key", "fp", "root", "component_id")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    parts = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def band_keys(grams: np.ndarray, bands: int = BANDS) -> list[int]:
    """One key per band of minima; none for an empty set."""
    if not len(grams) or not bands:
        return []
    mix = MIX[:bands * DEPTH]
    least = np.full(len(mix), 2**64 - 1, np.uint64)
    for k in range(0, len(grams), 4096):
        mixed = grams[k:k + 4096, None] * mix
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(32)).min(axis=0))
    return [xxh64_intdigest(least[k * DEPTH:(k + 1) * DEPTH].tobytes(), k) for k in range(bands)]


def similar_forest(rest: list[np.ndarray], others: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Links (place in ``rest``, place in ``others``) that connect every similar pair across the two lists of sorted sets."""
    grams = np.concatenate([*others, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(others)), [len(g) for g in others])
    order = np.argsort(grams, kind="stable")
    grams, owner, sizes = grams[order], owner[order], np.array([len(g) for g in others])
    root = np.arange(len(others))  # components among the others, by what the rest has linked
    for i, g in enumerate(rest):
        lo, hi = np.searchsorted(grams, g), np.searchsorted(grams, g, "right")
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange((hi - lo).sum())
        both = np.bincount(owner[at], minlength=len(others))
        near = np.flatnonzero(both >= similarity * (sizes + len(g) - both) - 1e-9)
        if len(near):
            found, first = np.unique(root[near], return_index=True)
            yield from ((i, int(near[k])) for k in first)
            root[np.isin(root, found)] = found[0]


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bits: int = 4,
            bands: int = BANDS) -> DataFrame:
    """``doc_id``, ``key``, ``root`` of every row: rows are linked if their sets of word shingles have at least this Jaccard similarity.

    Candidates are sets whose SimHashes differ in at most ``bits`` bits, met in pigeonhole blocks, and, as a bound on bits that
    blocks can serve is too narrow for 0.8, sets that share one of ``bands`` bands of minima. Every link is verified on the whole
    sets; texts and sets of other rows are not shuffled. Pairs of up to COLD sets of a block or band are compared directly. In a
    larger one each set is compared with one centre; only sets that are not similar to it are compared with all of the block, in
    pieces of CHUNK, so a large group of near copies costs one comparison per set and block.
    """
    text = column(docs, text_col)
    slim = docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))
    signed = lambda xs: np.array(xs, np.uint64).view(np.int64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, fps, minima = [], [], []
            for x in batch.column(2):
                grams = shingle_set(x.as_py() or b"", shingle)
                sids.append(xxh64_intdigest(grams.tobytes(), SEED))
                fps.append(simhash(grams[k:k + STEP] for k in range(0, len(grams), STEP)) if len(grams) else None)
                minima.append(signed(band_keys(grams, bands)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signed(sids), pa.int64()), pa.array(fps, pa.int64()),
                                              pa.array(minima, pa.list_(pa.int64()))], ["doc_id", "key", "sid", "fp", "bands"])

    base = stored(slim.mapInArrow(keys, "doc_id long, key long, sid long, fp long, bands array<long>"), "bands")
    sets = stored(base.groupBy("sid").agg(F.min(F.struct("doc_id", "key", "fp", "bands")).alias("one")).where("one.fp IS NOT NULL")
                  .select("sid", "one.fp", "one.bands"), "sets")
    # places from ``bands`` on are pigeonhole blocks of the fingerprint
    blocked = F.concat("bands", F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(bits, sets.count())]))
    each = stored(sets.select("sid", "fp", F.posexplode(blocked).alias("c", "band")), "each")
    shared = each.groupBy("c", "band").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("sid", "c").alias("h"), "sid")).alias("centre")).where("n > 1")
    blocks = stored(each.join(shared.select("c", "band", "n", F.col("centre.sid").alias("centre")), ["c", "band"]), "blocks")
    cold = blocks.where(F.col("n") <= COLD)
    close = (F.col("c") < bands) | (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= bits)
    pairs = (cold.select("c", "band", F.col("sid").alias("a"), F.col("fp").alias("fa"))
             .join(cold.select("c", "band", F.col("sid").alias("b"), F.col("fp").alias("fb")), ["c", "band"])
             .where((F.col("a") < F.col("b")) & close).select("a", "b").distinct())
    hot = blocks.where((F.col("n") > COLD) & (F.col("sid") != F.col("centre"))).select(F.col("sid").alias("a"), F.col("centre").alias("b")).distinct()
    pairs = stored(pairs.unionAll(hot), "pairs")

    # the whole sets of the candidates only, each read from one row that has it
    needed = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    wanted = base.groupBy("sid").agg(F.min(F.struct("doc_id", "key")).alias("one")).join(needed, "sid")
    wanted = stored(wanted.select("sid", F.col("one.doc_id").alias("__id"), F.col("one.key").alias("__key")), "wanted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [shingle_set(x.as_py(), shingle).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.int64()))], ["sid", "grams"])

    of = slim.join(small(wanted), slim["doc_id"].eqNullSafe(wanted["__id"]) & (slim["key"] == wanted["__key"])).select("sid", "text")
    grams = stored(of.mapInArrow(read, "sid long, grams array<long>").dropDuplicates(["sid"]), "grams")
    far = pairs.join(grams.select(F.col("sid").alias("b"), F.col("grams").alias("gb")), "b")
    both = far.join(grams.select(F.col("sid").alias("a"), F.col("grams").alias("ga")), "a")
    common = F.size(F.array_intersect("ga", "gb"))
    links = stored(both.where(common >= similarity * (F.size("ga") + F.size("gb") - common) - 1e-9).select("a", "b"), "links")

    linked = links.select(F.col("a").alias("sid"), F.col("b").alias("centre")).withColumn("linked", F.lit(True))
    large = stored(blocks.where(F.col("n") > COLD).join(linked, ["sid", "centre"], "left")
                   .withColumn("rest", F.col("linked").isNull() & (F.col("sid") != F.col("centre"))).drop("linked", "centre"), "large")
    left = stored(large.where("rest").groupBy("c", "band").agg(F.count(F.lit(1)).alias("m")), "left")
    if left.isEmpty():
        every = links
    else:
        open_ = (large.join(left, ["c", "band"]).withColumns({"rests": F.ceil(F.col("m") / CHUNK), "parts": F.ceil(F.col("n") / CHUNK)})
                 .withColumns({"p": F.pmod(F.xxhash64("sid"), "parts"), "r": F.pmod(F.xxhash64("sid"), "rests")}))
        as_other = open_.select("c", "band", "sid", F.lit(False).alias("rest"), "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)).alias("r"))
        as_rest = open_.where("rest").select("c", "band", "sid", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"), "r")
        pieces = stored(as_other.unionAll(as_rest.select(*as_other.columns)), "pieces").join(grams, "sid")

        def search(pdf: pd.DataFrame) -> pd.DataFrame:
            rest, others = pdf[pdf["rest"]], pdf[~pdf["rest"]]
            as_sets = lambda x: [np.asarray(g, np.int64).view(np.uint64) for g in x["grams"]]
            found = [(rest["sid"].iat[i], others["sid"].iat[j]) for i, j in similar_forest(as_sets(rest), as_sets(others), similarity)]
            return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

        every = links.unionAll(pieces.groupBy("c", "band", "p", "r").applyInPandas(search, "a long, b long").where("a != b"))
    roots = components(every).withColumnRenamed("node", "sid")
    return base.join(roots, "sid", "left").select("doc_id", "key", F.coalesce("root", "sid").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, **kwargs) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id stays, columns unchanged.

    Rows are linked by SimHash, or, if ``similarity`` is given, by SimHash and bands of minima, verified by the Jaccard similarity
    of their shingles. A null id comes after all others. Rows that repeat both id and text count as one row and stay once.
    """
    found = near_duplicates(docs, id_col, text_col, **kwargs) if similarity is None else similar(docs, id_col, text_col, similarity=similarity, **kwargs)
    found = stored(found, "near")
    # a stored side is dealt anew for the join, so Spark can split the rows of a large component
    best = stored(found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("best")), "best")
    gone = stored(found.join(best, "root").where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))))
                  .select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct(), "gone")
    key = F.xxhash64(column(docs, text_col))
    left = docs.join(small(gone), column(docs, id_col).cast("long").eqNullSafe(gone["__id"]) & (key == gone["__key"]), "left_anti")
    if found.groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        return left
    mark = unused(docs, "key")
    return left.withColumn(mark, key).dropDuplicates([id_col, mark]).drop(mark)
