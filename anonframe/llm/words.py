"""Vectorised words of whole texts: positions and 64-bit hashes from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Multiplier of the running polynomial, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are hashed at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20

U64 = np.uint64
_SEEDED = np.random.RandomState(20240229)
BYTE_VALUES = _SEEDED.randint(1, 1 << 62, 256).astype(U64) * U64(2) + U64(1)
PLACE_VALUES = _SEEDED.randint(1, 1 << 62, 64).astype(U64) * U64(2) + U64(1)

_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            p = np.full(n, U64(base))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_table(separators, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is it in a word, the byte's value with A-Z folded)."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    values = BYTE_VALUES.copy()
    if lower:
        values[65:91] = values[97:123]
        inside[65:91] = inside[97:123]
    return inside, values


SPACES = [0x20, *range(0x09, 0x0E)]
#: Words between spaces, as they are / with A-Z folded; words of letters, digits and all of non-ASCII, folded.
PLAIN = byte_table(SPACES, lower=False)
FOLDED = byte_table(SPACES, lower=True)
ALNUM = byte_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)], lower=True)


class Words:
    """The words of a slice of texts: ``start``, ``end`` (bytes in ``raw``), ``hash``, ``doc``; document d has words ``first[d]:first[d+1]``."""

    def __init__(self, texts: pa.Array, kind: tuple[np.ndarray, np.ndarray]):
        inside, values = kind
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        self.raw, self.bounds = raw, bounds
        size = len(raw)
        w = inside[raw]
        before = np.empty(size, bool)
        after = np.empty(size, bool)
        if size:
            before[0], before[1:] = False, w[:-1]
            after[-1], after[:-1] = False, w[1:]
            before[bounds[:-1][bounds[:-1] < size]] = False
            ends = bounds[1:] - 1
            after[ends[ends >= 0]] = False
        self.start = np.flatnonzero(w & ~before)
        self.end = np.flatnonzero(w & ~after) + 1
        up, down = powers(size + 1)
        total = np.zeros(size + 1, U64)
        np.cumsum(values[raw] * up[:size], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        self.doc = np.searchsorted(bounds, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(n + 1))
        self.count = np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid) of the k words from each word on; not valid where the document ends sooner."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, U64), np.zeros(0, bool)
        h = np.zeros(m, U64)
        for j in range(k):
            h += self.hash[j : j + m] * PLACE_VALUES[j]
        return mix(h), self.doc[:m] == self.doc[k - 1 :]

    def whole(self, d: int) -> int:
        """Hash of the whole word sequence of a document of fewer than 64 words, as ``grams`` of its length gives it."""
        a, b = self.first[d], self.first[d + 1]
        h = np.zeros(1, U64)
        for j in range(b - a):
            h += self.hash[a + j] * PLACE_VALUES[j]
        return mix(h)[0]

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()


def slices(batches: Iterator[pa.RecordBatch], text_col: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``size`` bytes of text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False), np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow lists of ``counts`` items each, from ``values`` in order."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
