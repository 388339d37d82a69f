"""Vectorised words and hashes of whole texts, shared by the operators of this package.

A word is a maximal run of bytes outside the ASCII white space 0x20, 0x09-0x0D. Because those
bytes never occur inside a multi-byte UTF-8 character, words can be found on the encoded bytes.
A null text has no words. Batches are cut into slices of a few megabytes between texts, so that
memory follows the slice and the longest single text, never the table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def give_back() -> None:
    """Hands freed memory back to the system. A worker outlives its task, and what large temporary arrays
    leave in the allocator would otherwise count against the executor until it ends."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


# One random-looking value per byte, and one odd multiplier per position of a window.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
PLACE = mix(np.arange(1, 65, dtype=U) * U(0xA0761D6478BD642F)) | U(1)

_powers = np.ones(1, U)
_inverse = np.ones(1, U)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        up, down = np.full(size, _BASE, U), np.full(size, _BASE_INVERSE, U)
        up[0] = down[0] = 1
        _powers, _inverse = np.multiply.accumulate(up), np.multiply.accumulate(down)


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums with a leading zero."""
    out = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=out[1:])
    return out


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` reads the hash of any byte span."""
    _grow(len(data))
    return sums(BYTE_VALUE[data] * _powers[: len(data)])


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * _inverse[start])


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values without repeats. Sorting machine integers is faster than hashing them."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then those of the next."""
    total = int(counts.sum())
    before = np.repeat(sums(counts)[:-1], counts)
    return np.repeat(starts, counts) + (np.arange(total, dtype=np.int64) - before)


class Slice:
    """Some consecutive texts: their bytes and where each text begins."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def find_words(self, kinds: np.ndarray = ~SPACE) -> None:
        """Sets ``starts``, ``ends`` (bytes) and ``bounds`` (first word of each text, and the end).

        ``kinds`` tells for every byte whether it belongs to a word.
        """
        inside = kinds[self.data]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(inside):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            edges = self.offsets[1:-1]
            before[edges[edges < len(inside)]] = False
            after[edges[edges > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def word_hashes(self, lower: bool = True) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        return span_hash(prefix_hash(data), self.starts, self.ends)

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode()


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a column in slices of at most ``max_bytes``, one text at least."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, where, body = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Slice(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows, text by text, and how many each text has.

    A text with fewer words, but not none, has one window: all its words.
    """
    n = np.diff(bounds)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    full = np.zeros(max(0, len(hashes) - width + 1), U)
    for j in range(width):
        full += hashes[j : j + len(full)] * PLACE[j]
    where = ragged(bounds[:-1], counts)
    out = np.zeros(len(where), U)
    short = np.repeat(n < width, counts)
    out[~short] = full[where[~short]]
    for t in np.flatnonzero((n < width) & (n > 0)):
        a = bounds[t]
        at = np.searchsorted(where, a)
        out[at : at + 1] = (hashes[a : bounds[t + 1]] * PLACE[: n[t]]).sum()
        out[at : at + 1] += PLACE[63:64] * n[t].astype(U)
    return mix(out), counts


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, for batches in which equal keys lie together."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if kept and kept[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            kept.append(batch.slice(a, b - a))
            if b < len(keys):
                yield pa.Table.from_batches(kept)
                kept = []
    if kept:
        yield pa.Table.from_batches(kept)
