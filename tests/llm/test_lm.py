"""Scoring and counting of the language model: no long walks, no bytes that say nothing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from shardloom.llm import elias_fano, lm
from shardloom.llm.words import slices


def prose(seed: int, n: int) -> str:
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).zipf(1.3, n) % 5000)


def steps(sizes) -> np.ndarray:
    return np.cumsum(np.asarray(sizes, np.uint64), dtype=np.uint64)


UNEQUAL = {
    "one long step": steps([1] * 50_015 + [1 << 26] + [1] * 50_000),
    "many long steps": steps(([3] * 4015 + [2_000_000] + [3] * 20) * 25),
    "equal values": steps([0] * 100_015 + [5] + [0] * 100_000),
    "long step last": steps([0] * 2000 + [2] * 100_015 + [1 << 26]),
}


@pytest.mark.parametrize("name", UNEQUAL)
def test_unequal_steps_are_not_walked(name, monkeypatch):
    """The pointers past a frequent word make long runs in the bit vector; a look-up reads a few words of it."""
    v = UNEQUAL[name]
    arrays = elias_fano.build(v)
    seq, calls, count = elias_fano.EliasFano(arrays), [], np.bitwise_count
    assert len(arrays["high"]) > 1000
    monkeypatch.setattr(np, "bitwise_count", lambda x: calls.append(len(x)) or count(x))
    places = np.arange(len(v))
    assert (seq.get(places) == v).all()
    first, second = seq.pairs(places[:-1])
    assert (first == v[:-1]).all() and (second == v[1:]).all()
    once = np.unique(v)
    assert (v[seq.find(once)] == once).all()
    assert (seq.find(np.setdiff1d(once + np.uint64(1), once)) == -1).all()
    assert len(calls) < 100


def test_remembered_places_take_four_bytes():
    arrays = elias_fano.build(steps([7] * 4000))
    assert arrays["ones"].dtype.itemsize == arrays["zeros"].dtype.itemsize == 4


def test_word_counts_travel_thin(spark):
    """Hashes of words are sent as differences: fewer bytes than their eight, and the same hashes on arrival."""
    text = prose(3, 20_000)
    rows = [r for r in lm.ngram_counts(spark.createDataFrame([(text,)], "text string"), 3, 4).collect() if r["bucket"] & 15 == 1]
    words = np.concatenate([lm._wide(r["word"], len(r["n"]), np.uint64) for r in sorted(rows, key=lambda r: r["bucket"])])
    tokens, _ = lm.token_hashes(next(slices(pa.array([text]))))
    assert (words == np.unique(tokens)).all()
    assert sum(len(r["word"]) for r in rows) < 7.5 * len(words)


def test_chunks_count_over_texts_and_slices(spark, monkeypatch):
    """Contexts do not run over from one text of a chunk to the next, wherever its slices end."""
    texts = [prose(i, n) for i, n in enumerate([1, 0, 2, 300, 5, 1, 40])] + [""]
    docs = spark.createDataFrame([(x,) for x in texts], "text string").repartition(1)

    def counted():
        held: dict = {}
        for r in lm.ngram_counts(docs, 3, 4).collect():
            bucket = lm._Bucket(r["bucket"])
            bucket.add(r["context"], r["word"], r["n"], r["more"])
            for key, n in zip(*(x.tolist() for x in bucket.merge()), strict=True):
                held[r["bucket"], key] = held.get((r["bucket"], key), 0) + n
        return held

    whole = counted()
    tokens = sum(len(x.split()) + 1 for x in texts)
    assert [sum(n for (b, _), n in whole.items() if b & 15 == level) for level in (1, 2, 3)] == [tokens] * 3
    alone: dict = {}
    for x in texts:
        part = next(slices(pa.array([x])))
        hashes, bounds = lm.token_hashes(part)
        for level in (2, 3):
            bucket, key, n = lm._count(lm.contexts(hashes, bounds, level), hashes, 4)
            for b, k, m in zip(bucket.tolist(), key.tolist(), n.tolist(), strict=True):
                at = b << 4 | level, k
                alone[at] = alone.get(at, 0) + m
    assert alone == {k: n for k, n in whole.items() if k[0] & 15 > 1}


def test_shards_keep_only_their_own_bits(spark):
    """Many shards give the scores of one, and a key costs as few bits in the last shard as in the first."""
    texts = [prose(i, 400) for i in range(60)]
    docs = spark.createDataFrame([(x,) for x in texts], "text string")
    one = lm.train(docs)
    many = lm.train(docs, bucket_tokens=1 << 6, shard=1 << 10)
    assert one.shards == (1, 1, 1) and many.shards[0] >= 16
    part = next(slices(pa.array([*texts, *(prose(100 + i, 50) for i in range(5))])))
    a, b = (lm.score_slice(trie, part) for trie in (one, many))
    assert (a["n_known"] == b["n_known"]).all()
    assert a["score"] == pytest.approx(b["score"], rel=1e-12)
    for level in lm._levels(many)[1:]:
        widths = [s[0]["key"].width for s in level.shards if s]
        assert max(widths) <= min(widths) + 1
