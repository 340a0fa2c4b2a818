"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column.

A chunk is a run of whole texts of about CHUNK bytes. All arrays hold a chunk, so memory does
not grow with the batch; one text longer than a chunk makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of a chunk, about: its arrays stay near the processor's caches.
CHUNK = 1 << 18
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
NEWLINE = 10


def _mixed(n: int, salt: int) -> np.ndarray:
    """n fixed 64-bit numbers that look random (splitmix64)."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt)) * MULTIPLIER
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


SOLID = np.ones(256, bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False
VALUE = _mixed(256, 7)
#: The same for A to Z as for a to z.
FOLDED = VALUE.copy()
FOLDED[65:91] = VALUE[97:123]

_power = np.array([1], np.uint64)
_inverse = np.array([1], np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and of its inverse."""
    global _power, _inverse
    if len(_power) < n:
        n = max(n, 2 * CHUNK)
        base, back = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 2**64)
        for name, b in (("_power", base), ("_inverse", back)):
            row = np.full(n, b, np.uint64)
            row[0] = 1
            globals()[name] = np.multiply.accumulate(row)
    return _power[:n], _inverse[:n]


@dataclass
class Words:
    """Words of a chunk in order."""

    raw: np.ndarray  # bytes
    texts: np.ndarray  # where each text starts in raw, and the end
    start: np.ndarray  # of each word in raw
    end: np.ndarray
    text: np.ndarray  # number of each word's text in the chunk
    hash: np.ndarray  # of each word, 64 bits

    def line(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word's line in the chunk, and of each text's first line; the lines of all texts are numbered on."""
        breaks = np.flatnonzero(self.raw == NEWLINE)
        number = np.repeat(np.arange(len(breaks) + 1), np.diff(np.r_[0, np.searchsorted(self.start, breaks), len(self.start)]))
        return number + self.text, np.searchsorted(breaks, self.texts[:-1]) + np.arange(len(self.texts) - 1)


def span(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts in them. Null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(column: pa.Array, size: int = CHUNK, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first row, row after the last, bytes and starts (from 0) of runs of at most so many rows."""
    data, at = span(column)
    a, n = 0, len(at) - 1
    while a < n:
        b = min(max(a + 1, int(np.searchsorted(at, at[a] + size, "right")) - 1), a + rows)
        yield a, b, data[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


def words(raw: np.ndarray, texts: np.ndarray, fold: bool = False) -> Words:
    """Splits at ASCII white space and at the bounds of texts; fold: A to Z hash as a to z."""
    n = len(raw)
    solid = np.zeros(n + 2, bool)
    # As SOLID has it, by comparisons, which are quicker.
    np.greater(raw - np.uint8(0x09), 0x0D - 0x09, out=solid[1:-1])
    solid[1:-1] &= raw != 0x20
    # A word starts and ends where white space and other bytes change places, or where two texts meet.
    bounds = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = bounds[0::2], bounds[1::2]
    met = texts[1:-1]
    met = met[solid[met] & solid[met + 1] & np.r_[True, met[1:] != met[:-1]]] if len(met) else met
    if len(met):
        start, end = np.insert(start, np.searchsorted(start, met), met), np.insert(end, np.searchsorted(end, met), met)
    power, inverse = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    value = np.take(FOLDED if fold else VALUE, raw, out=np.empty(n, np.uint64), mode="clip")
    value *= power[:n]
    np.cumsum(value, out=total[1:])
    hashes = mix((total[end] - total[start]) * inverse[start])
    owner = np.repeat(np.arange(len(texts) - 1), np.diff(np.searchsorted(start, texts)))
    return Words(raw, texts, start, end, owner, hashes)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every run of k words within a text. A text of 1 to k - 1 words has one shorter run."""
    n = len(w.hash)
    counts = np.bincount(w.text, minlength=len(w.texts) - 1)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    runs = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k):
        runs = runs * np.uint64(0xD1342543DE82EF95) + w.hash[i : n - k + 1 + i] if len(runs) else runs
    inside = w.text[: len(runs)] == w.text[k - 1 :] if len(runs) else np.zeros(0, bool)
    out, owner = mix(runs[inside]), w.text[: len(runs)][inside]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        at = np.searchsorted(w.text, short)
        extra = []
        for t, a in zip(short.tolist(), at.tolist()):
            h = np.uint64(counts[t])
            for x in w.hash[a : a + counts[t]]:
                h = np.uint64((int(h) * 0xD1342543DE82EF95 + int(x)) % 2**64)
            extra.append(h)
        out, owner = np.r_[out, mix(np.array(extra, np.uint64))], np.r_[owner, short]
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner
