"""Exact top-k search by inner product with a pivot-distance index.

Vectors get one more component that lifts all of them to the same norm, so the largest inner product is the smallest Euclidean
distance (the query's extra component is 0). Each vector is keyed by its nearest pivot and its distance to it; the distances of
a pivot are cut into sorted annuli. A query first searches the annulus nearest to it, then every annulus that the triangle
inequality does not rule out by the k-th score found so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from proofloom.llm.common import column, stored

#: Pivots, annuli per pivot (so the directory has at most their product of rows), vectors per block, queries per batch.
PIVOTS, ANNULI, BLOCK, BATCH = 64, 16, 8192, 2048
#: Rows that a batch of queries may ask for at once, each with the vector of its query.
SENT_ROWS = 65_536
#: Relative slack of distances in double precision.
SLACK = 1e-9


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id`` and ``v`` (floor of scale times each component, as longs), once per pair; vectors that are null or hold null,
    NaN or infinite components are left out."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(column(vectors, id_col).cast("long").alias("vec_id"), column(vectors, vec_col).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v")).distinct()


def _matrix(rows, dims: int) -> np.ndarray:
    """Vectors as rows, short ones filled with zeros; whole numbers in doubles, which hold products and sums exactly up to 2**53."""
    out = np.zeros((len(rows), dims))
    for k, v in enumerate(rows):
        out[k, :len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 2**53 in Python's integers."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return a @ b.T
    return np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a], dtype=object)


def _slices(pdfs: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The same rows, at most ``rows`` (one at least) at once."""
    for pdf in pdfs:
        for lo in range(0, len(pdf), max(1, rows)):
            yield pdf.iloc[lo:lo + max(1, rows)]


def index(quant: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, float, int, pd.DataFrame]:
    """The stored index (pivot, r, annulus, ids, v), pivots, largest squared norm, dimensions, and the directory of annuli.

    Equal vectors are one entry with its k + 1 smallest ids: no other copy can be among the k best, whose ties go to smaller
    ids. That limit is applied before the shuffle, so a vector that a third of all rows repeat is no hot group.
    """
    ranked = quant.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    entries = stored(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    top, dims = entries.agg(F.max(norm), F.max(F.size("v"))).first()
    top, dims = float(top or 0), int(dims or 0)
    pivots = _matrix([r.v for r in entries.select("v").orderBy(F.xxhash64("v"), "v").limit(PIVOTS).collect()], dims)
    lift = np.sqrt(np.maximum(0, top - (pivots**2).sum(1)))

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(list(pdf["v"]), dims)
            square = 2 * top - 2 * (x @ pivots.T) - 2 * np.sqrt(np.maximum(0, top - (x**2).sum(1)))[:, None] * lift[None, :]
            near = square.argmin(1)
            yield pdf.assign(pivot=near.astype(np.int32), r=np.sqrt(np.maximum(0, square[np.arange(len(x)), near])))

    keyed = stored(entries.mapInPandas(key, "v array<long>, ids array<long>, pivot int, r double"), "keyed")
    cuts = keyed.groupBy("pivot").agg(F.percentile_approx("r", [j / ANNULI for j in range(1, ANNULI)]).alias("cuts"))
    ringed = stored(keyed.join(F.broadcast(cuts), "pivot").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("r")))).drop("cuts"), "ringed")
    directory = ringed.groupBy("pivot", "ring").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("pivot", "ring").toPandas()
    return ringed, pivots, top, dims, directory


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The ``k`` best of all other rows for every row whose ``vec_id`` meets ``is_query``: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``vec_id``. Score: inner product of the whole-number vectors; ties go to the smaller vec_id;
    fewer than ``k`` other rows: all of them. Rows with a null id, and vectors that are null or hold null or non-finite
    components, take no part. A shorter vector counts as filled with zeros. Rows that repeat id and vector count once; an id
    with several vectors never answers itself, and each pair of ids has its best score. An empty table gives an empty result.
    """
    quant = stored(quantised(vectors, id_col, vec_col, scale), "quantised")
    ringed, pivots, top, dims, directory = index(quant, k)
    queries = stored(quant.where(is_query), "queries")
    batches = max(1, -(-queries.count() // BATCH))
    rings = directory[["pivot", "low", "high", "n"]].to_numpy()
    numbers = directory[["pivot", "ring"]].to_numpy(np.int64)
    parts = np.maximum(1, -(-rings[:, 3].astype(np.int64) // BLOCK))
    step = SENT_ROWS // max(1, int(parts.sum()))  # a query asks for all parts at most
    schema = "query_id long, v array<long>, pivot int, ring int, part int, batch int"

    def bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least distance from each query to each annulus, by the triangle inequality, and squared norm plus top."""
        base = (x**2).sum(1) + top
        away = np.sqrt(np.maximum(0, base[:, None] - 2 * (x @ pivots.T)))[:, rings[:, 0].astype(int)]
        return np.maximum(0, np.maximum(away - rings[None, :, 2], rings[None, :, 1] - away)), base

    def send(pdf: pd.DataFrame, chosen: np.ndarray) -> pd.DataFrame:
        q, a = np.nonzero(chosen)
        rows = pd.DataFrame({"query_id": pdf["vec_id"].to_numpy()[q], "v": pd.Series([pdf["v"].iloc[i] for i in q], dtype=object), "pivot": numbers[a, 0], "ring": numbers[a, 1], "part": parts[a]})
        rows = rows.loc[rows.index.repeat(rows["part"])]
        rows["part"] = rows.groupby(level=0).cumcount()
        return rows.assign(batch=pd.util.hash_array(rows["query_id"].to_numpy()) % batches)

    def first_ring(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(pdfs, step):
            least, _ = bounds(_matrix(list(pdf["v"]), dims))
            yield send(pdf, np.arange(len(rings))[None, :] == least.argmin(1)[:, None])

    def other_rings(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(pdfs, step):
            least, base = bounds(_matrix(list(pdf["v"]), dims))
            reach = np.sqrt(np.maximum(0, base - 2 * pdf["kth"].to_numpy(float)))  # no k-th score yet: infinite
            within = least <= (reach * (1 + SLACK) + SLACK * np.sqrt(base))[:, None]
            yield send(pdf, within & (np.arange(len(rings))[None, :] != least.argmin(1)[:, None]))

    if not len(directory):
        return quant.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sized = quant.sparkSession.createDataFrame([(int(p), int(r), int(n)) for (p, r), n in zip(numbers, parts)], "pivot int, ring int, parts int")
    cut = ringed.join(F.broadcast(sized), ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).drop("parts")
    where = ["pivot", "ring", "part", "batch"]

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(asked) and len(held):
            held = held.iloc[np.argsort([ids[0] for ids in held["ids"]], kind="stable")]
            ids, matrix = list(held["ids"]), _matrix(list(held["v"]), dims)
            for lo in range(0, len(asked), 256):
                part = asked.iloc[lo:lo + 256]
                scores = _products(_matrix(list(part["v"]), dims), matrix)
                n = min(k + 1, len(held))
                for query, row in zip(part["query_id"], scores):
                    limit = np.partition(row, len(row) - n)[len(row) - n]
                    chosen = [*np.flatnonzero(row > limit), *np.flatnonzero(row == limit)[:k + 1]]
                    best = sorted((-int(row[j]), int(i)) for j in chosen for i in ids[j] if i != query)[:k]
                    out += [(query, i, max(-2**63, min(2**63 - 1, -s))) for s, i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    def answers(asked: DataFrame) -> DataFrame:
        """Scores of the asked parts; a part is sent only to the batches of queries that ask for it."""
        asked = stored(asked, "asked")
        searched = cut.join(stored(asked.select(*where).distinct(), "wanted"), ["pivot", "ring", "part"])
        return asked.groupBy(*where).cogroup(searched.groupBy(*where)).applyInPandas(search, "query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    early = stored(answers(queries.mapInPandas(first_ring, schema)), "early")
    kth = best(early).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("kth"))
    open_queries = queries.join(kth, queries["vec_id"] == kth["query_id"], "left").select("vec_id", "v", F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))).alias("kth"))
    late = answers(open_queries.mapInPandas(other_rings, schema))
    return best(early.unionAll(late)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
