"""Toxicity by nearest labelled examples: exact TF-IDF cosine through a block-max inverted index, distance-weighted calibrated votes."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.llm.common import column, small, stored

WORDS = re.compile(r"[^\W_]+")
#: Beside whole words, their first letters are terms, so that inflected forms meet.
PREFIXES = (4, 5, 6)
#: Labelled examples taken per class (a bounded sample in hash order), most terms of the vectors, least chi-square of a term, and
#: how many times likelier it is in toxic examples: terms that clean ones use as often, or that only mark a large group of
#: clean copies, tell nothing of toxicity and would link most texts.
EXAMPLES, TERMS, LEAST_CHI2, LEAST_RATIO = 3000, 256, 30.0, 4.0
#: Neighbours that vote, entries per block of the index, and results kept by a task for vectors it meets again.
NEIGHBOURS, BLOCK, CACHE = 16, 64, 50_000
#: Distance at which a vote has fallen to e**-0.5 of a vote at distance 0, and the weight of the prior in votes at distance 0.
NEAR, PRIOR = 0.4, 0.5


def words_of(text: str) -> Counter:
    return Counter(WORDS.findall(text.lower()))


def terms_of(words: Counter) -> Counter:
    """Terms and counts: words as they are, prefixes marked by ``^``."""
    found = Counter(words)
    for w, n in words.items():
        for k in PREFIXES:
            if len(w) > k:
                found["^" + w[:k]] += n
    return found


@dataclass
class Vocabulary:
    """The terms of the vectors, numbered; ``read`` counts them in a text."""

    terms: list[str]
    words: dict[str, int] = field(init=False)
    prefixes: list[tuple[int, dict[str, int]]] = field(init=False)

    def __post_init__(self) -> None:
        self.words = {t: k for k, t in enumerate(self.terms) if t[0] != "^"}
        self.prefixes = [(n, d) for n in PREFIXES if (d := {t[1:]: k for k, t in enumerate(self.terms) if t[0] == "^" and len(t) == n + 1})]

    def read(self, text: str) -> list[tuple[int, int]]:
        found: Counter = Counter()
        for w, n in words_of(text).items():
            if w in self.words:
                found[self.words[w]] += n
            for k, known in self.prefixes:
                if w[:k] in known and len(w) > k:
                    found[known[w[:k]]] += n
        return sorted(found.items())


class BlockMaxIndex:
    """Labelled unit vectors by term, in blocks with the largest weight of each term; ``top`` gives the exact best cosines."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int) -> None:
        self.blocks = -(-len(vectors) // BLOCK)
        lists: list[list[tuple[int, float]]] = [[] for _ in range(n_terms)]
        for k, v in enumerate(vectors):
            for t, x in v.items():
                lists[t].append((k, x))
        self.ids = [np.array([k for k, _ in x], np.int64) for x in lists]
        self.weights = [np.array([w for _, w in x]) for x in lists]
        self.starts = [np.searchsorted(ids, np.arange(self.blocks + 1) * BLOCK) for ids in self.ids]
        self.most = np.zeros((n_terms, self.blocks))
        for t, ids in enumerate(self.ids):
            np.maximum.at(self.most[t], ids // BLOCK, self.weights[t])

    def top(self, vector: dict[int, float], k: int) -> list[tuple[float, int]]:
        """(cosine, entry) of the k best entries with a cosine above 0, best first, ties by entry."""
        if not vector:
            return []
        bound = sum(x * self.most[t] for t, x in vector.items())
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) == k and bound[b] < -best[-1][0] - 1e-12:
                break  # no entry of this or any later block can come in
            scores = np.zeros(BLOCK)
            for t, x in vector.items():
                lo, hi = self.starts[t][b], self.starts[t][b + 1]
                scores[self.ids[t][lo:hi] - b * BLOCK] += x * self.weights[t][lo:hi]
            own = [(-round(float(scores[j]), 12), int(b) * BLOCK + int(j)) for j in np.flatnonzero(scores > 0)]
            best = sorted(best + own)[:k]
        return [(-s, j) for s, j in best]


@dataclass
class Model:
    vocabulary: Vocabulary
    idf: list[float]
    index: BlockMaxIndex
    clean: np.ndarray  # weight of clean and toxic examples with the vector of an entry
    toxic: np.ndarray
    ids: list[int | None]  # an example of each entry
    empty: tuple[float, float]  # the same for examples without any term
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def vector(self, counts: list[tuple[int, int]]) -> dict[int, float]:
        raw = {t: (1 + math.log(n)) * self.idf[t] for t, n in counts}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()} if norm else {}

    def vote(self, near: list[tuple[float, int]], less: tuple[int, float, float] | None = None) -> float:
        """Share of toxic among neighbours, weighted by a normal curve over their distance, and the prior, which outweighs
        neighbours that are all far; ``less``: an example taken out of its entry."""
        toxic, clean = self.prior * PRIOR, (1 - self.prior) * PRIOR
        for cosine, k in near:
            w = math.exp((cosine - 1) / NEAR**2)  # the squared distance of unit vectors is 2 - 2 cosine
            gone = less[1:] if less and less[0] == k else (0.0, 0.0)
            clean += w * (self.clean[k] - gone[0])
            toxic += w * (self.toxic[k] - gone[1])
        if not near:
            clean, toxic = clean + self.empty[0], toxic + self.empty[1]
        return toxic / (toxic + clean)

    def score(self, counts: list[tuple[int, int]]) -> tuple[float, list[tuple[float, int]]]:
        near = self.index.top(self.vector(counts), NEIGHBOURS)
        return self.calibrated(self.vote(near)), near

    def calibrated(self, p: float) -> float:
        p = min(max(p, 1e-6), 1 - 1e-6)
        return 1 / (1 + math.exp(-(self.slope * math.log(p / (1 - p)) + self.shift)))


def platt(votes: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit on the logit of votes that left the example out; a ridge holds it near 1 and 0."""
    x = np.log(np.clip(votes, 1e-6, 1 - 1e-6) / np.clip(1 - votes, 1e-6, 1))
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r = weight * (p - truth)
        s = weight * p * (1 - p)
        grad = np.array([(r * x).sum() + (a - 1), r.sum() + b])
        hess = np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum() + 1]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 0.1)), float(b)


def fit(examples: list[tuple[int | None, int, list[tuple[int, int]]]], vocabulary: Vocabulary, idf: list[float], rates: tuple[float, float]) -> Model:
    """A model from (id, label, term counts); ``rates``: how many labelled documents an example of each class stands for."""
    shell = Model(vocabulary, idf, BlockMaxIndex([], len(idf)), np.zeros(0), np.zeros(0), [], (0.0, 0.0), 0.0)
    entries: dict[tuple, list] = {}
    empty = [0.0, 0.0]
    placed = []
    for doc, label, counts in sorted(examples, key=lambda e: (e[0] is None, e[0] or 0, e[1], e[2])):
        vector = shell.vector(counts)
        if not vector:
            empty[label] += rates[label]
            continue
        entry = entries.setdefault(tuple(sorted((t, round(x, 9)) for t, x in vector.items())), [vector, [0.0, 0.0], doc, len(entries)])
        entry[1][label] += rates[label]
        placed.append((entry[3], label, vector))
    found = list(entries.values())
    weights = np.array([e[1] for e in found]).reshape(-1, 2)
    total = [sum(rates[e[1]] for e in examples if e[1] == c) for c in (0, 1)]
    model = Model(vocabulary, idf, BlockMaxIndex([e[0] for e in found], len(idf)), weights[:, 0], weights[:, 1], [e[2] for e in found], tuple(empty),
                  (total[1] + 1) / (sum(total) + 2))
    if placed:
        votes = np.array([model.vote(model.index.top(v, NEIGHBOURS), (k, rates[0] * (c == 0), rates[1] * (c == 1))) for k, c, v in placed])
        truth = np.array([float(c) for _, c, _ in placed])
        model.slope, model.shift = platt(votes, truth, np.array([rates[c] for _, c, _ in placed]) / max(rates))
    return model


def _counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id``, ``key``, ``terms``, ``counts`` of every row: one pass over the whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vocabulary.read(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[t for t, _ in f] for f in found], pa.list_(pa.int32())),
                                              pa.array([[n for _, n in f] for f in found], pa.list_(pa.int32()))], ["doc_id", "key", "terms", "counts"])

    return docs.mapInArrow(run, "doc_id long, key long, terms array<int>, counts array<int>")


def _terms(sample: DataFrame) -> DataFrame:
    """``label``, ``term`` once per example."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                terms = list(terms_of(words_of(text.as_py() or "")))
                for k in range(0, len(terms), 100_000):
                    part = terms[k:k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(part), pa.int32()), pa.array(part, pa.string())], ["label", "term"])

    return sample.mapInArrow(run, "label int, term string")


def learnable(doc_id: Column, remainder: int, modulus: int) -> Column:
    """Whether labels of a document may be learned: crc32 of its id as text leaves another remainder."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus != remainder


def train(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, id_col: str = "doc_id", text_col: str = "text",
          examples: int = EXAMPLES) -> tuple[Model, DataFrame]:
    """The model, and the stored term counts of all rows of ``docs`` that it was fitted with.

    ``usable`` is a condition on ``labels.doc_id``. Of each class the first ``examples`` labelled ids in hash order are taken;
    terms are chosen by chi-square among them, and document frequencies are counted over all documents. Ids with both labels
    count as toxic; labels other than 0 and 1 are ignored.
    """
    slim = docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.xxhash64(column(docs, text_col)).alias("key"), column(docs, text_col).alias("text"))
    known = (labels.where(usable).select(column(labels, "doc_id").cast("long").alias("id"), column(labels, label_col).cast("int").alias("label"))
             .where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label")))
    known = stored(known, "known")
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = [known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(examples) for c in (0, 1)]
    chosen = stored(chosen[0].unionAll(chosen[1]), "chosen")
    sample = slim.join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    sample = stored(sample.dropDuplicates(["id", "key"]).limit(4 * examples).select("label", "text"), "sample")  # repeated ids cannot make it larger
    taken = {c: max(1, min(examples, sizes.get(c, 0))) for c in (0, 1)}
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0) + 0.5, n.get(1, 0) + 0.5
    table = _terms(sample).groupBy("term").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("b"))
    a, b = F.col("a"), F.col("b")
    chi2 = (n0 + n1) * F.pow(a * (n0 - b) - b * (n1 - a), 2) / (n0 * n1 * (a + b) * (n0 + n1 - a - b) + 1e-9)
    ratio = ((a + 0.5) / n1) / ((b + 0.5) / n0)
    told = (F.col("chi2") >= LEAST_CHI2) & (ratio >= LEAST_RATIO)
    vocabulary = Vocabulary([r.term for r in table.withColumn("chi2", F.round(chi2, 6)).where(told).orderBy(F.desc("chi2"), "term").limit(TERMS).collect()])
    counted = stored(_counts(slim, vocabulary), "counts")
    total = counted.count()
    held = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    idf = [math.log((1 + total) / (1 + held.get(k, 0))) + 1 for k in range(len(vocabulary.terms))]
    rows = counted.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).dropDuplicates(["id", "key"]).limit(4 * examples).collect()
    rates = (sizes.get(0, 0) / taken[0], sizes.get(1, 0) / taken[1])
    return fit([(r.doc_id, r.label, list(zip(r.terms, r["counts"]))) for r in rows], vocabulary, idf, rates), counted


def scores(model: Model, counted: DataFrame) -> DataFrame:
    """``doc_id``, ``key``, ``score``, ``evidence`` (the nearest examples: id, cosine, share of toxic) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple] = {}
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.float64())]))
        for batch in batches:
            out = []
            for terms, counts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                key = tuple(zip(terms, counts))
                if key not in seen:
                    if len(seen) >= CACHE:
                        seen.clear()
                    p, near = model.score(list(key))
                    seen[key] = p, [{"doc_id": model.ids[k], "cosine": c, "toxic": model.toxic[k] / (model.toxic[k] + model.clean[k])} for c, k in near[:3]]
                out.append(seen[key])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p for p, _ in out], pa.float64()), pa.array([e for _, e in out], kind)],
                                             ["doc_id", "key", "score", "evidence"])

    return counted.mapInArrow(run, "doc_id long, key long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:double>>")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", usable: Column | None = None, **kwargs) -> DataFrame:
    """``doc_id``, ``key``, ``score`` (0 to 1, higher: toxic likelier) and ``evidence`` of every row of ``docs``.

    Null and empty texts have no terms and get the rate of labelled texts without terms; ties between neighbours go to the
    example with the smaller id; repeated rows get equal scores; without labels every score is 0.5; an empty table gives no
    rows. Only ids and texts are read from ``docs``.
    """
    model, counted = train(docs, labels, label_col, F.lit(True) if usable is None else usable, **kwargs)
    return scores(model, counted)


def keep_clean(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", usable: Column | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, columns unchanged."""
    found = classify(docs, labels, label_col, usable, id_col=id_col, text_col=text_col, **kwargs)
    bad = stored(found.where(F.col("score") >= threshold).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct(), "toxic")
    same = column(docs, id_col).cast("long").eqNullSafe(bad["__id"]) & (F.xxhash64(column(docs, text_col)) == bad["__key"])
    return docs.join(small(bad), same, "left_anti")
