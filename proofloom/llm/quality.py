"""Quality by a byte-level convolutional network in numpy: filters over overlapping chunks of the whole document, max-pooled and combined."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.llm.common import column, stored

#: Bytes a filter sees, filters, units that combine the filters of a chunk.
WIDTH, FILTERS, UNITS = 6, 32, 16
#: A chunk is four steps of 64 positions and begins every three: 256 positions, 64 shared with the next.
STEP, CHUNK_STEPS, STRIDE_STEPS = 64, 4, 3
CHUNK, STRIDE = STEP * CHUNK_STEPS, STEP * STRIDE_STEPS
#: Positions computed at once; a multiple of STEP.
BLOCK = 16384
#: Training: labelled documents per class (a bounded sample in hash order) of at most so many bytes each, chunks drawn per
#: document and round, rounds, documents per step, and the seed.
EXAMPLES, EXAMPLE_BYTES, DRAWN, ROUNDS, BATCH, SEED = 2000, 65536, 8, 12, 32, 17
#: Chance that a training document is cut to a short piece.
SHORT = 0.3


@dataclass
class Network:
    """table: (WIDTH, 256, FILTERS) filters as byte tables; chunk units; document weights over mean and max of the units."""

    table: np.ndarray
    bias: np.ndarray
    mix: np.ndarray  # (FILTERS + 1, UNITS): pooled filters and the filled share of the chunk
    mix_bias: np.ndarray
    out: np.ndarray  # (2 * UNITS,)
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        f = np.float32
        return cls((rng.normal(size=(WIDTH, 256, FILTERS)) * 0.5).astype(f), np.zeros(FILTERS, f), (rng.normal(size=(FILTERS + 1, UNITS)) * 0.2).astype(f),
                   np.full(UNITS, 0.1, f), (rng.normal(size=2 * UNITS) * 0.2).astype(f), np.zeros(1, f))

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.mix, self.mix_bias, self.out, self.out_bias]

    def convolved(self, data: np.ndarray, n: int) -> np.ndarray:
        """Filter values at the first n positions of the last axis; data has WIDTH - 1 bytes more."""
        acc = self.table[0][data[..., :n]]
        for j in range(1, WIDTH):
            acc += self.table[j][data[..., j:n + j]]
        return acc

    def pooled(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled filters of all chunks of a whole document, and how far each chunk is filled."""
        n = len(text)
        if not n:
            return np.zeros((1, FILTERS), np.float32), np.zeros(1, np.float32)
        data = np.frombuffer(text + b"\0" * (WIDTH - 1), np.uint8)
        steps = np.concatenate([np.maximum.reduceat(self.convolved(data[k:k + BLOCK + WIDTH - 1], min(BLOCK, n - k)), np.arange(0, min(BLOCK, n - k), STEP), axis=0)
                                for k in range(0, n, BLOCK)])
        starts = np.arange(0, max(1, len(steps) - (CHUNK_STEPS - STRIDE_STEPS)), STRIDE_STEPS)
        top = steps[starts]
        for k in range(1, CHUNK_STEPS):
            top = np.maximum(top, steps[np.minimum(starts + k, len(steps) - 1)])
        return np.maximum(top + self.bias, 0), np.minimum((n - starts * STEP) / CHUNK, 1).astype(np.float32)

    def units(self, pooled: np.ndarray, filled: np.ndarray) -> np.ndarray:
        return np.maximum(np.concatenate([pooled, filled[:, None]], 1) @ self.mix + self.mix_bias, 0)

    def score(self, text: bytes) -> float:
        """Probability of label 1."""
        u = self.units(*self.pooled(text))
        z = float(np.concatenate([u.mean(0), u.max(0)]) @ self.out + self.out_bias[0])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _drawn(text: bytes, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Some chunks of a document as rows of bytes, and their filled positions."""
    steps = -(-len(text) // STEP)
    starts = np.arange(0, max(1, steps - (CHUNK_STEPS - STRIDE_STEPS)), STRIDE_STEPS) * STEP
    if len(starts) > DRAWN:
        starts = np.sort(rng.choice(starts, DRAWN, replace=False))
    data = np.frombuffer(text + b"\0" * (CHUNK + WIDTH), np.uint8)
    return data[starts[:, None] + np.arange(CHUNK + WIDTH - 1)[None, :]], np.minimum(len(text) - starts, CHUNK)


def _cut(text: bytes, rng: np.random.Generator) -> bytes:
    """The document, or with the chance SHORT a piece of it of 10 to 200 bytes."""
    if rng.random() >= SHORT:
        return text
    size = int(rng.integers(10, 200))
    begin = int(rng.integers(0, max(1, len(text) - size)))
    return text[begin:begin + size]


def train(texts: list[bytes], labels: list[int], odds: float = 1.0) -> Network:
    """A network fitted by Adam on the given documents; the same input gives the same network.

    Classes weigh the same; ``odds``, of label 1 in all labelled documents, then moves the scores. In each round some documents
    are cut to a short piece, so that short texts are known too.

    The largest value of a filter in a chunk alone carries its gradient, so a step touches few table rows.
    """
    rng = np.random.default_rng(SEED)
    net = Network.fresh(rng)
    truth = np.array(labels, np.float32)
    weight = np.where(truth == 1, 0.5 / max(1, (truth == 1).sum()), 0.5 / max(1, (truth == 0).sum())) * len(truth)
    mean, square, t = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for r in range(ROUNDS if 0 < truth.sum() < len(truth) else 0):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            docs = order[lo:lo + BATCH]
            drawn = [_drawn(_cut(texts[d], rng), rng) for d in docs]
            data, size = np.concatenate([d for d, _ in drawn]), np.concatenate([s for _, s in drawn])
            owner = np.repeat(np.arange(len(docs)), [len(s) for _, s in drawn])
            acc = net.convolved(data, CHUNK)
            acc[np.arange(CHUNK)[None, :] >= size[:, None]] = -1e9
            place = acc.argmax(1)  # (chunks, FILTERS)
            pooled = np.maximum(np.take_along_axis(acc, place[:, None, :], 1)[:, 0] + net.bias, 0)
            inputs = np.concatenate([pooled, (size / CHUNK).astype(np.float32)[:, None]], 1)
            units = np.maximum(inputs @ net.mix + net.mix_bias, 0)
            begins = np.flatnonzero(np.diff(owner, prepend=-1))
            count = np.diff(np.append(begins, len(owner)))
            most = np.maximum.reduceat(units, begins, axis=0)
            doc = np.concatenate([np.add.reduceat(units, begins, axis=0) / count[:, None], most], 1)
            p = 1 / (1 + np.exp(-np.clip(doc @ net.out + net.out_bias, -30, 30)))
            g = ((p - truth[docs]) * weight[docs] / len(docs)).astype(np.float32)
            g_doc = g[:, None] * net.out[None, :]
            is_most = (units == most[owner]) & (units > 0)
            share = np.add.reduceat(is_most, begins, axis=0, dtype=np.float32)
            g_units = (g_doc[:, :UNITS] / count[:, None])[owner] + is_most * (g_doc[:, UNITS:] / np.maximum(share, 1))[owner]
            g_units *= units > 0
            g_pooled = (g_units @ net.mix.T)[:, :FILTERS] * (pooled > 0)
            g_table = np.zeros_like(net.table)
            rows, filters = np.nonzero(g_pooled)
            at = place[rows, filters]
            for j in range(WIDTH):
                np.add.at(g_table[j], (data[rows, at + j], filters), g_pooled[rows, filters])
            grads = [g_table, g_pooled.sum(0), inputs.T @ g_units, g_units.sum(0), doc.T @ g, np.array([g.sum()], np.float32)]
            t += 1
            rate = 0.01 * (1 - r / ROUNDS)
            for part, grad, m, s in zip(net.parts(), grads, mean, square):
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                part -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    net.out_bias += np.float32(np.log(odds))
    return net


def fit(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES) -> Network:
    """A network learned from up to ``examples`` labelled documents of each class, the first in hash order of their ids, and
    only those of at most EXAMPLE_BYTES bytes. ``usable``: a condition on ``labels.doc_id``. Ids with both labels count as 0."""
    known = (labels.where(usable).select(column(labels, "doc_id").cast("long").alias("id"), column(labels, label_col).cast("int").alias("label"))
             .where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.min("label").alias("label")))
    known = stored(known, "known")
    slim = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text")).where(F.octet_length("text") <= EXAMPLE_BYTES)
    held = slim.select("doc_id").join(known, F.col("doc_id") == F.col("id"), "left_semi").distinct()
    known = stored(known.join(held, F.col("id") == F.col("doc_id"), "left_semi"), "usable")
    chosen = [known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(examples) for c in (0, 1)]
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    rows = slim.join(F.broadcast(chosen[0].unionAll(chosen[1])), F.col("doc_id") == F.col("id")).groupBy("id").agg(F.min(F.struct("label", "text")).alias("x")).select("id", "x.*")
    found = sorted(rows.collect(), key=lambda r: r.id)
    return train([r.text.encode() for r in found], [r.label for r in found], (sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1))


def scores(net: Network, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` of every row: the whole text, chunk by chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [net.score(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", usable: Column | None = None, **kwargs) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: label 1 likelier) of every row of ``docs``.

    Null and empty texts have one empty chunk; repeated rows get equal scores; without labels of both classes the network stays
    as it was made and its scores mean nothing; an empty table gives no rows. Only ids and texts are read from ``docs``.
    """
    net = fit(docs, labels, label_col, F.lit(True) if usable is None else usable, **kwargs)
    names = {k: v for k, v in kwargs.items() if k in ("id_col", "text_col")}
    return scores(net, docs, **names)
