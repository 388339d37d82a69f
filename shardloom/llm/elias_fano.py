"""Elias-Fano sequences and the files of memory-mapped levels that hold them.

A sequence of non-decreasing integers keeps the low bits of each value in a packed array and the high
bits as a bit vector in which value ``i`` with high part ``h`` sets bit ``h + i``. Every 32nd one and zero
is remembered. Between the nearest remembered one and the nearest remembered zero before a bit lie fewer than
32 ones and 32 zeros, so a value, or the few values that share a high part, is found by looking at two or three
words, however unequal the steps are. All look-ups take arrays and run in numpy.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow.fs as pafs

from .words import U

EVERY = 32
_ONE, _TWO, _FOUR = U(0x5555555555555555), U(0x3333333333333333), U(0x0F0F0F0F0F0F0F0F)
_EACH, _TOP = U(0x0101010101010101), U(0x8080808080808080)
# Place of the k-th set bit of a byte, at 8 * byte + k.
_IN_BYTE = np.zeros(256 * 8, np.uint8)
for _byte in range(256):
    for _k, _place in enumerate(i for i in range(8) if _byte >> i & 1):
        _IN_BYTE[8 * _byte + _k] = _place


def _nth(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the ``k``-th set bit of each word, counted from 0; the word has more than ``k``."""
    s = x - ((x >> U(1)) & _ONE)
    s = (s & _TWO) + ((s >> U(2)) & _TWO)
    s = ((s + (s >> U(4))) & _FOUR) * _EACH  # in each byte the set bits up to its end
    k = k.astype(U)
    shift = np.bitwise_count((((k * _EACH) | _TOP) - s) & _TOP).astype(U) << U(3)
    k -= ((s << U(8)) >> shift) & U(255)
    return (shift + _IN_BYTE[((((x >> shift) & U(255)) << U(3)) | k).astype(np.int64)]).astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(values) * width // 64 + 2, U)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(U)
        np.bitwise_or.at(out, word, values << shift)
        over = shift + U(width) > U(64)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (U(64) - shift[over]))
    return out


def build(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a sequence of non-decreasing unsigned integers."""
    values = np.asarray(values, U)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    high = (values >> U(low)).astype(np.int64)
    bits = np.zeros((int(high[-1]) if n else 0) + n + 2, bool)
    bits[high + np.arange(n)] = True
    ones, zeros = np.flatnonzero(bits)[::EVERY], np.flatnonzero(~bits)[::EVERY]
    packed = np.packbits(bits, bitorder="little")
    words = np.zeros(len(packed) // 8 + 2, U)
    words.view(np.uint8)[: len(packed)] = packed
    place = np.uint32 if len(bits) < 1 << 32 else U
    return {
        "shape": np.array([n, low, top], U), "low": _pack(values & U((1 << low) - 1), low),
        "high": words, "ones": ones.astype(place), "zeros": zeros.astype(place),
    }


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.width, self.top = (int(x) for x in arrays["shape"])
        self.low, self.high = arrays["low"], arrays["high"]
        self.samples = {1: arrays["ones"], 0: arrays["zeros"]}

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Places of the ``k``-th ones or zeros, counted from 0."""
        start = self.samples[bit][k // EVERY].astype(np.int64)
        left = k % EVERY
        word = start >> 6
        flip = U(0) if bit else ~U(0)
        now = (self.high[word] ^ flip) & (~U(0) << (start & 63).astype(U))
        go, walked = np.arange(len(k)), 0
        while True:
            count = np.bitwise_count(now[go] if walked else now)
            more = np.flatnonzero((left[go] if walked else left) >= count)
            if not len(more):
                break
            go, count = go[more], count[more]
            if walked == 3:  # far from the remembered bit: there is a remembered one of the other kind nearer
                at, before = self._nearer(k[go], bit)
                jump = np.flatnonzero((at >> 6) > word[go])
                there, at = go[jump], at[jump]
                word[there], left[there] = at >> 6, k[there] - before[jump]
                now[there] = (self.high[at >> 6] ^ flip) & (~U(0) << (at & 63).astype(U))
                stay = np.ones(len(go), bool)
                stay[jump] = False
                step, count = go[stay], count[stay]
            else:
                step = go
            left[step] -= count
            word[step] += 1
            now[step] = self.high[word[step]] ^ flip
            walked += 1
        return (word << 6) + _nth(now, left)

    def _nearer(self, k: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of the last remembered bit of the other kind with at most ``k`` of this kind before it, and how
        many those are; 0 and 0 where there is none."""
        other = self.samples[1 - bit]
        a, b = np.zeros(len(k), np.int64), np.full(len(k), len(other))
        live = np.arange(len(k))
        while len(live):
            mid = (a[live] + b[live]) >> 1
            fits = other[mid].astype(np.int64) - EVERY * mid <= k[live]
            a[live[fits]] = mid[fits] + 1
            b[live[~fits]] = mid[~fits]
            live = live[a[live] < b[live]]
        at = np.where(a > 0, other[np.maximum(a - 1, 0)].astype(np.int64), 0)
        return at, np.where(a > 0, at - EVERY * (a - 1), 0)

    def _equal(self, at: np.ndarray, bit: int) -> np.ndarray:
        """How many bits from the places ``at`` on are ``bit``; 64 stands for 64 or more."""
        word, shift = at >> 6, (at & 63).astype(U)
        now = (self.high[word] >> shift) | ((self.high[word + 1] << U(1)) << (U(63) - shift))
        if bit:
            now = ~now
        return np.bitwise_count((now & (~now + U(1))) - U(1)).astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(U)
        upper = (self.low[word + 1] << U(1)) << (U(63) - shift)
        return ((self.low[word] >> shift) | upper) & U((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i``."""
        i = np.asarray(i, np.int64)
        return ((self._select(i, 1) - i).astype(U) << U(self.width)) | self._low(i)

    def pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at the places ``i`` and at the places after them."""
        i = np.asarray(i, np.int64)
        first = self._select(i, 1)
        gap = self._equal(first + 1, 0)
        second = first + 1 + gap
        far = np.flatnonzero(gap == 64)
        if len(far):
            second[far] = self._select(i[far] + 1, 1)
        return tuple(
            ((at - j).astype(U) << U(self.width)) | self._low(j) for at, j in ((first, i), (second, i + 1))
        )

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places of the values ``x``, -1 where a value does not occur."""
        out = np.full(len(x), -1, np.int64)
        ok = np.flatnonzero(x <= U(self.top)) if self.n else np.zeros(0, np.int64)
        if not len(ok):
            return out
        x = x[ok]
        high = (x >> U(self.width)).astype(np.int64)
        # Values with this high part stand between two zeros of the bit vector.
        zero = np.where(high > 0, self._select(np.maximum(high - 1, 0), 0), -1)
        lo = zero - high + 1
        count = self._equal(zero + 1, 1)
        hi = lo + count
        far = np.flatnonzero(count == 64)
        if len(far):
            hi[far] = self._select(high[far], 0) - high[far]
        want = x & U((1 << self.width) - 1)
        a, b = lo.copy(), hi.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            less = self._low(mid) < want[live]
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]
            live = live[a[live] < b[live]]
        hit = a < hi
        hit[hit] = self._low(a[hit]) == want[hit]
        out[ok[hit]] = a[hit]
        return out


def write_arrays(store: pafs.FileSystem, path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line of JSON that says where each array lies, then the arrays, 64-byte aligned."""
    at, index = 0, {}
    for name, x in arrays.items():
        index[name] = (at, len(x), x.dtype.str)
        at += -(-x.nbytes // 64) * 64
    head = json.dumps(index).encode()
    room = -(-(len(head) + 1) // 64) * 64
    with store.open_output_stream(path) as out:
        out.write(head + b" " * (room - len(head) - 1) + b"\n")
        for x in arrays.values():
            out.write(memoryview(np.ascontiguousarray(x)).cast("B") if len(x) else b"")
            out.write(b"\0" * (-x.nbytes % 64))


def map_arrays(store: pafs.FileSystem, path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped where the store is mounted, else read."""
    if isinstance(store, pafs.LocalFileSystem):
        body = np.memmap(path, np.uint8, "r").view(np.ndarray)  # every look-up of a memmap would pass through Python
    else:
        with store.open_input_file(path) as file:
            body = np.frombuffer(file.read(), np.uint8)
    end = 64
    while body[end - 1] != 10:
        end += 64
    index = json.loads(body[:end].tobytes())
    return {
        name: body[end + at : end + at + n * np.dtype(kind).itemsize].view(kind)
        for name, (at, n, kind) in index.items()
    }
