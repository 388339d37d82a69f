"""Seeded random columns that any engine with md5 can reproduce.

Every draw is a function of the row's own key and a seed, never of the
partition it happens to sit in, so a recomputed task repeats its draw.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column, seed) -> Column:
    """md5 of the key parts and the seed, joined by a bar."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))


def _hex_to_long(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def order_key(*parts: Column, seed) -> Column:
    """60-bit integer to order rows by in a seeded random permutation."""
    return _hex_to_long(F.substring(digest(*parts, seed=seed), 1, 15))


def uniform(*parts: Column, seed) -> Column:
    """Uniform draw in [0, 1)."""
    return _hex_to_long(F.substring(digest(*parts, seed=seed), 1, 8)) / F.lit(4294967296.0)


def hash32(*parts: Column, seed) -> Column:
    """32-bit integer of the key parts and the seed."""
    return _hex_to_long(F.substring(digest(*parts, seed=seed), 1, 8))


# Rounds of the network.
FEISTEL_ROUNDS = 4


def permuted(place: Column, n: int, *key: Column, seed) -> Column:
    """Where a keyed permutation of 0..n-1 sends ``place``: one permutation for each key.

    A Feistel network over a x b, the nearest rectangle that holds n: each round shifts one coordinate by a
    hash of the other, which can be undone, so no two places meet. A place outside 0..n-1 is sent on until it
    is inside; at most a x b - n places are outside.

    A round hashes a key and a coordinate, of which there are about the root of n for each key. So a batch
    of rows makes one md5 for each pair of them that it meets, and the places themselves are sent in arrays:
    hand in the rows of a key together.
    """
    if n < 1:
        raise ValueError("nothing to permute")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    rounds, tail = FEISTEL_ROUNDS, f"|{seed}".encode()

    def moved(heads: list[bytes], which: np.ndarray, i: int, own: np.ndarray, width: int) -> np.ndarray:
        pairs, at = np.unique(which * width + own, return_inverse=True)
        hashes = [
            hashlib.md5(b"%b%d|%d%b" % (heads[k], i, x, tail)).digest()[:4]
            for k, x in zip((pairs // width).tolist(), (pairs % width).tolist(), strict=True)
        ]
        return np.frombuffer(b"".join(hashes), ">u4").astype(np.int64)[at]

    def send(heads: list[bytes], which: np.ndarray, x: np.ndarray) -> np.ndarray:
        l, r = x // b, x % b
        for i in range(rounds):
            if i % 2 == 0:
                l = (l + moved(heads, which, i, r, b)) % a
            else:
                r = (r + moved(heads, which, i, l, a)) % b
        return l * b + r

    def run(places: pa.Array, keys: pa.Array) -> pa.Array:
        words = keys.dictionary_encode()
        heads = [w.encode() for w in words.dictionary.to_pylist()]
        which = words.indices.to_numpy().astype(np.int64)
        none = places.is_null().to_numpy(zero_copy_only=False)
        x = places.fill_null(0).to_numpy()
        x = send(heads, which, x)
        while len(out := np.flatnonzero(x >= n)):
            x[out] = send(heads, which[out], x[out])
        return pa.array(x, pa.int64(), mask=none)

    # A null part is left out, and so is its bar.
    head = F.concat_ws("|", *[k.cast("string") for k in key], F.lit(""))
    return F.arrow_udf(run, "bigint")(place.cast("bigint"), head)


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once inside a lambda and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normals(length: Column, *parts: Column, seed) -> Column:
    """Array of standard normals, one md5 per pair (Box-Muller)."""

    def pair(i: Column) -> Column:
        def from_digest(d: Column) -> Column:
            u1 = (_hex_to_long(F.substring(d, 1, 8)) + 1) / F.lit(4294967297.0)
            u2 = _hex_to_long(F.substring(d, 9, 8)) / F.lit(4294967296.0)
            polar = F.struct(
                F.sqrt(F.lit(-2.0) * F.log(u1)).alias("r"),
                (F.lit(2 * math.pi) * u2).alias("a"),
            )
            return _bind(
                polar,
                lambda p: F.array(
                    p.getField("r") * F.cos(p.getField("a")),
                    p.getField("r") * F.sin(p.getField("a")),
                ),
            )

        return _bind(digest(*parts, i, seed=seed), from_digest)

    pairs = F.transform(F.sequence(F.lit(0), F.ceil(length / 2).cast("int") - 1), pair)
    return F.when(length > 0, F.slice(F.flatten(pairs), F.lit(1), length)).otherwise(
        F.array().cast("array<double>")
    )


def shuffled(n: int, seed) -> list[int]:
    """Seeded permutation of ``range(n)`` for small driver-side lists."""
    return sorted(
        range(n), key=lambda i: (hashlib.md5(f"{i}|{seed}".encode()).hexdigest()[:15], i)
    )
