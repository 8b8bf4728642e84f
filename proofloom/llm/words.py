"""Words of many texts at once: Arrow columns of UTF-8 are cut at ASCII separators with numpy and come back as small integers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text cut at once; a longer text is a slice of its own.
SLICE = 4 << 20


def separators(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """What each byte is: 0 part of a word, 1 a gap between words, 2 a gap that also ends a piece."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(gaps)] = 1
    kinds[list(breaks)] = 2
    return kinds


#: A-Z become a-z, all other bytes stay.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


@dataclass
class Words:
    """codes: a number per word, the same for equal words; values: the word of each number (binary); first: words that begin a
    piece; begins: place of the first word of each text, and the number of words at the end."""

    codes: np.ndarray
    values: pa.Array
    first: np.ndarray
    begins: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """Which text each word is of."""
        return np.repeat(np.arange(len(self.begins) - 1), np.diff(self.begins))


def cut(texts: pa.Array, kinds: np.ndarray, lower: bool = False) -> Words:
    """The words of some texts (binary, nulls empty)."""
    _, offsets, raw = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(raw, np.uint8, bounds[-1] - bounds[0], bounds[0]) if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds -= bounds[0]
    if lower:
        data = LOWERED[data]
    kind = kinds[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind == 0
    edge = np.zeros(len(data) + 1, bool)  # a text begins or ends here
    edge[bounds] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    both = np.empty(2 * len(starts) + 1, np.int32)
    both[:-1:2], both[1::2], both[-1] = starts, ends, len(data)
    spans = pa.Array.from_buffers(pa.binary(), 2 * len(starts), [None, pa.py_buffer(both), pa.py_buffer(data)])
    coded = spans.take(pa.array(np.arange(0, 2 * len(starts), 2))).dictionary_encode()
    begins = np.searchsorted(starts, bounds)
    first = np.zeros(len(starts) + 1, bool)
    first[begins] = True
    breaks = np.flatnonzero(kind == 2)
    if len(breaks):
        first[np.searchsorted(starts, breaks)] = True
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, first[:-1], begins)


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` (binary) of each has about ``size`` bytes; a longer text stands alone."""
    for batch in batches:
        texts = batch.column(column)
        bounds = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(bounds, int(bounds[a]) + size, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b
