"""Language-model scores from an Elias-Fano n-gram trie.

Counting. Tasks sort the n-grams of a few million tokens at a time, level by level, count repetitions, and
pass on packed arrays by bucket of the context's hash. A bucket sees all n-grams of its contexts; it merges the
arrays as they come, so that it holds distinct n-grams, not all arrays of a frequent context. All n-grams
are kept, those seen once as well, unless ``least`` says otherwise. Contexts are told apart by the bucket and
32 more bits of their hash.

Trie. Level 1 holds the word hashes as an Elias-Fano sequence with their counts. A higher level holds the
context hashes as such a sequence, the monotone pointers from contexts to their successors as another,
and the successors of each context as sorted 32-bit word hashes with one byte per probability (logarithm,
in sixteenths of a power of two) and one byte per context for its back-off weight. Levels are cut into
shards by context hash, each merged and written by one task, some four million tokens of text to a shard, and mapped by the
scoring workers; a shard keeps its hashes without the bits that all of them share. A worker seeks each
distinct context of a slice and then, within its range, each distinct successor, both in the order of the trie.

Smoothing is absolute discounting, interpolated: p(w|c) = max(n(cw) - d, 0) / n(c) + b(c) p(w|shorter c),
where b(c) is the rest of the mass; words have p(w) = (n(w) + 1) / (N + V + 1).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path
from .elias_fano import EliasFano, build, map_arrays, write_arrays
from .stats import fold
from .tables import parts, remainder
from .tokens import store_of
from .words import PLACE, U, give_back, mix, ragged, slices, sums

END = mix(np.array([0x0E0D], U))[0]
START = mix(np.array([0x57A7], U))[0]
BUCKET_TOKENS = 1 << 19
CHUNK = 1 << 22  # tokens whose n-grams a counting task sorts at a time
RANGES = 3  # bits of a context's hash by which a chunk is parted before it is sorted
SHARD = 1 << 22  # tokens of text for each shard of a level
MERGE = 1 << 22  # counts that wait to be merged
MANY = 12  # words sought after one context from which on it is searched by itself


@dataclass(frozen=True)
class Trie:
    order: int
    bits: int  # of the bucket number, the top of a context's hash
    shards: tuple[int, ...]  # shards of each level, a power of two
    folder: str
    tokens: int
    words: int


def token_hashes(part) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each text and one end, and where each text begins."""
    part.find_words()
    h = np.insert(part.word_hashes(), part.bounds[1:], END)
    return h, part.bounds + np.arange(len(part.bounds))


def contexts(tokens: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order - 1`` tokens before each token; starts stand before a text."""
    out = np.zeros(len(tokens), U)
    for back in range(1, order):
        before = np.full(len(tokens), START, U)
        before[back:] = tokens[:-back]
        for j in range(back):  # the first tokens of a text
            at = bounds[:-1] + j
            before[at[at < bounds[1:]]] = START
        out += before * PLACE[32 + back]
    return mix(out + PLACE[order])


def _count(context, word, bits: int):
    """Bucket, context, word and count of the distinct n-grams, ordered by these."""
    key = ((context >> U(32 - bits)) << U(32)) | (word >> U(32))
    order = np.argsort(key)
    bucket = (context >> U(64 - bits)).astype(np.uint32) if bits else np.zeros(len(key), np.uint32)
    order = order[np.argsort(bucket[order], kind="stable")]
    key, bucket = key[order], bucket[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(new)
    return bucket[at], key[at], np.diff(np.append(at, len(key))).astype(np.uint32)


def _small(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes, and those from 255 up as they are."""
    return np.minimum(n, 255).astype(np.uint8), n[n >= 255].astype(np.uint32)


def _thin(x: np.ndarray) -> bytes:
    """Ascending numbers as compressed planes of the bytes of their differences."""
    planes = np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.itemsize).T
    return pa.compress(np.ascontiguousarray(planes), "zstd", asbytes=True)


def _wide(body: bytes, n: int, kind: type = np.uint32) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(body, width * n, "zstd"), np.uint8).reshape(width, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def _packed(level: int, bucket, columns) -> pa.RecordBatch:
    cuts = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1, append=-2))
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    context, word, n = columns
    if level == 1:
        body = [[b""] * len(spans), [_thin(word[a:b]) for a, b in spans]]
    else:
        body = [[_thin(context[a:b]) for a, b in spans], [word[a:b].tobytes() for a, b in spans]]
    body += [list(x) for x in zip(*[[y.tobytes() for y in _small(n[a:b])] for a, b in spans], strict=True)]
    number = pa.array((bucket[cuts[:-1]].astype(np.int64) << 4) | level)
    return pa.RecordBatch.from_arrays(
        [number, *(pa.array(x, pa.binary()) for x in body)], ["bucket", "context", "word", "n", "more"]
    )


def ngram_counts(docs: DataFrame, order: int, bits: int) -> DataFrame:
    """Packed counts of one chunk of tokens after another, by ``bucket`` (number and level)."""

    def flush(kept):
        tokens = np.concatenate([x for x, _ in kept])
        first = sums(np.array([len(x) for x, _ in kept]))
        bounds = np.append(np.concatenate([b[:-1] + n for (_, b), n in zip(kept, first, strict=False)]), len(tokens))
        kept.clear()
        word = np.sort(tokens)
        new = np.ones(len(word), bool)
        new[1:] = word[1:] != word[:-1]
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(word))).astype(np.uint32)
        word = word[at]
        bucket = (word >> U(64 - bits)).astype(np.uint32) if bits else np.zeros(len(word), np.uint32)
        yield _packed(1, bucket, (np.zeros(len(word), "V0"), word, n))
        del word, new, at, n, bucket
        context = None
        for level in range(2, order + 1):  # contexts of a level at a time, sorted in ranges of their hashes
            context = contexts(tokens, bounds, level)
            for i in range(1 << RANGES):
                own = np.flatnonzero(context >> U(64 - RANGES) == U(i))
                if len(own):
                    bucket, key, n = _count(context[own], tokens[own], bits)
                    yield _packed(level, bucket, ((key >> U(32)).astype(np.uint32), key.astype(np.uint32), n))
        del context, tokens
        give_back()

    def run(batches):
        kept, held = [], 0
        for batch in batches:
            for part in slices(batch.column(0), 1 << 20):
                kept.append(token_hashes(part))
                held += len(kept[-1][0])
                if held > CHUNK:
                    yield from flush(kept)
                    held = 0
        if held:
            yield from flush(kept)

    return docs.select("text").mapInArrow(
        run, "bucket long, context binary, word binary, n binary, more binary"
    )


def _code(p: np.ndarray) -> np.ndarray:
    """Probabilities in one byte: sixteenths of a power of two; 255 stands for 0."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.round(-16 * np.log2(p)), 0, 254), 255).astype(np.uint8)


DECODE = np.append(2.0 ** (-np.arange(255) / 16), 0.0)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, n = key[order], n[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return key[at], np.add.reduceat(n, at) if len(at) else n


class _Bucket:
    """The counts of a bucket, merged while they come."""

    def __init__(self, number: int):
        self.number, self.level = number >> 4, number & 15
        self.keys, self.counts, self.waiting = [], [], 0

    def add(self, context: bytes, word: bytes, n: bytes, more: bytes) -> None:
        if self.level == 1:
            key = _wide(word, len(n), U)
        else:
            key = (_wide(context, len(n)).astype(U) << U(32)) | np.frombuffer(word, np.uint32)
        count = np.frombuffer(n, np.uint8).astype(np.int64)
        count[count == 255] = np.frombuffer(more, np.uint32)
        self.keys.append(key)
        self.counts.append(count)
        self.waiting += len(key)
        if self.waiting > MERGE + 2 * len(self.keys[0]):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            key, n = _merged(self.keys, self.counts)
            self.keys, self.counts = [key], [n]
        self.waiting = 0
        return self.keys[0], self.counts[0]

    def entries(self, least: int, discount: float) -> dict[str, np.ndarray]:
        """What the trie keeps of the bucket."""
        key, n = self.merge()
        if self.level == 1:
            return {"key": key, "count": n}
        context = key >> U(32)
        first = np.flatnonzero(np.diff(context, prepend=~context[:1]) != 0)
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        total = np.add.reduceat(n, first)
        keep = n >= least
        value = _code((n[keep] - discount) / total[of[keep]])
        length = np.bincount(of[keep], minlength=len(first))
        weight = 1 - np.bincount(of[keep], DECODE[value], len(first))
        has = length > 0
        return {
            "key": (U(self.number) << U(32)) | context[first[has]], "length": length[has],
            "weight": _code(np.maximum(weight[has], 2.0**-15)), "word": key[keep].astype(np.uint32), "value": value,
        }


def _write(counts: DataFrame, trie: Trie, least: int, discount: float) -> DataFrame:
    """Merges and writes the shards, each in one task from its buckets in order; a row per shard."""
    bits = (trie.shards[0] - 1).bit_length()
    shift = trie.bits - bits
    level = F.expr("bucket & 15")
    rows = counts.withColumn("shard", F.expr(f"shiftleft(shiftright(bucket, 4 + {shift}), 4)") + level)
    names = ["level", "shard", "kept", "words", "tokens"]

    def run(batches):
        store, root = store_of(trie.folder)
        shard, bucket, pieces = None, None, []

        def finished():
            level = shard & 15
            parts = {k: np.concatenate([x[k] for x in pieces]) for k in pieces[0]}
            parts["base"] = np.array([(shard >> 4) << (64 - bits) if bits else 0], U)
            keys = parts.pop("key")
            sequences = {"key": keys - (parts["base"] if level == 1 else parts["base"] >> U(32 - trie.bits))}
            if level > 1:
                sequences["pointer"] = sums(parts.pop("length").astype(np.int64)).astype(U)
            for name, values in sequences.items():
                parts |= {f"{name}.{k}": v for k, v in build(values).items()}
            name = f"{root}/{level}-{shard >> 4}.trie"
            own = f"{name}.{TaskContext.get().taskAttemptId()}"
            write_arrays(store, own, parts)
            store.move(own, name)
            kept = len(parts["count"]) if level == 1 else len(parts["word"])
            tokens = int(parts["count"].sum()) if level == 1 else 0
            row = [level, shard >> 4, kept, kept if level == 1 else 0, tokens]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names)

        for batch in batches:
            for here, number, *body in zip(*(batch.column(c).to_pylist() for c in ("shard", "bucket", "context", "word", "n", "more")), strict=True):
                if bucket is not None and (bucket.number << 4 | bucket.level) != number:
                    pieces.append(bucket.entries(least, discount))
                    bucket = None
                if here != shard:
                    if pieces:
                        yield finished()
                    shard, pieces = here, []
                bucket = bucket or _Bucket(number)
                bucket.add(*body)
        if bucket is not None:
            pieces.append(bucket.entries(least, discount))
            yield finished()

    count = sum(trie.shards)
    return (
        rows.repartition(count, "shard").sortWithinPartitions("shard", "bucket")
        .mapInArrow(run, ", ".join(f"{c} long" for c in names))
    )


def train(
    docs: DataFrame, order: int = 3, least: int = 1, discount: float = 0.75,
    bucket_tokens: int = BUCKET_TOKENS, shard: int = SHARD,
) -> Trie:
    """Counts all texts of ``docs`` and writes the trie below the shared folder."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, max(8, (parts(size // 6, bucket_tokens) - 1).bit_length()))  # contexts differ by 40 bits at least
    shards = 1 << min(bits, (parts(size // 6, shard) - 1).bit_length())
    folder = fresh_path(spark, "trie")
    store, root = store_of(folder)
    store.create_dir(root, recursive=True)
    trie = Trie(order, bits, (shards,) * order, folder, 0, 0)
    written = _write(ngram_counts(docs, order, bits), trie, least, discount).collect()  # a row per shard
    return replace(trie, tokens=sum(r["tokens"] for r in written), words=sum(r["words"] for r in written))


class _Level:
    def __init__(self, trie: Trie, level: int):
        store, root = store_of(trie.folder)
        self.level, self.shards, self.bits = level, [], trie.bits
        for i in range(trie.shards[level - 1]):
            try:
                arrays = map_arrays(store, f"{root}/{level}-{i}.trie")
            except FileNotFoundError:  # no n-gram fell into it
                self.shards.append(None)
                continue
            sequences = {}
            for name in ("key", "pointer"):
                own = {k.split(".")[1]: v for k, v in arrays.items() if k.startswith(f"{name}.")}
                if own:
                    sequences[name] = EliasFano(own)
            self.shards.append((sequences, arrays))

    def _by_shard(self, hashes: np.ndarray):
        """The shards of ascending ``hashes``, what lies before their keys, and the range of the hashes of each."""
        bits = (len(self.shards) - 1).bit_length()
        first = np.arange(len(self.shards), dtype=U) << U(64 - bits) if bits else np.zeros(len(self.shards), U)
        cuts = [*np.searchsorted(hashes, first).tolist(), len(hashes)]
        for i, held in enumerate(self.shards):
            if held and cuts[i] < cuts[i + 1]:
                yield *held, cuts[i], cuts[i + 1]

    def counts(self, words: np.ndarray) -> np.ndarray:
        """Counts of ascending hashes of words."""
        out = np.zeros(len(words), np.int64)
        for sequences, arrays, a, b in self._by_shard(words):
            found = sequences["key"].find(words[a:b] - arrays["base"])
            hit = np.flatnonzero(found >= 0)
            out[a + hit] = arrays["count"][found[hit]]
        return out

    def look_up(self, context: np.ndarray, word: np.ndarray, words: np.ndarray):
        """Share of the word after the context, and the weight of the shorter context.

        ``word`` are places in the ascending ``words``. Each pair is sought once, in the order of the trie.
        """
        distinct, of = np.unique(context >> U(32 - self.bits), return_inverse=True)
        room = max(1, (len(words) - 1).bit_length())
        pair, of_pair = np.unique((of << room) | word, return_inverse=True)
        of, want = pair >> room, (words >> U(32)).astype(np.uint32)[pair & ((1 << room) - 1)]
        share, weight = np.zeros(len(pair)), np.ones(len(distinct))
        first = np.searchsorted(of, np.arange(len(distinct) + 1))
        for sequences, arrays, begin, stop in self._by_shard(distinct << U(32 - self.bits)):
            found = sequences["key"].find(distinct[begin:stop] - (arrays["base"] >> U(32 - self.bits)))
            at = np.flatnonzero(found >= 0)
            found = found[at]
            at += begin
            weight[at] = DECODE[arrays["weight"][found]]
            lo, hi = (x.astype(np.int64) for x in sequences["pointer"].pairs(found))
            each = first[at + 1] - first[at]
            rows = ragged(first[at], each)
            place = _among(arrays["word"], lo, hi, want[rows], each)
            hit = np.flatnonzero(place >= 0)
            share[rows[hit]] = DECODE[arrays["value"][place[hit]]]
        return share[of_pair], weight[of][of_pair]


def _among(held: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Places of ``want`` in ``held``, -1 where it does not occur: the first ``each[0]`` are sought in the sorted
    range from ``lo[0]`` to ``hi[0]``, the next ``each[1]`` in the next range."""
    own = np.repeat(np.arange(len(each)), each)
    a, end = lo[own], hi[own]
    b, bounds = end.copy(), sums(each)
    many = each >= MANY
    for g in np.flatnonzero(many).tolist():
        at = slice(bounds[g], bounds[g + 1])
        a[at] += held[lo[g] : hi[g]].searchsorted(want[at])
    live = np.flatnonzero(~many[own] & (a < b))
    while len(live):
        low, high = a[live], b[live]
        mid = (low + high) >> 1
        less = held[mid] < want[live]
        low = np.where(less, mid + 1, low)
        high = np.where(less, high, mid)
        a[live], b[live] = low, high
        live = live[low < high]
    out = np.full(len(a), -1, np.int64)
    inside = np.flatnonzero(a < end)
    hit = inside[held[a[inside]] == want[inside]]
    out[hit] = a[hit]
    return out


@functools.lru_cache(maxsize=2)
def _levels(trie: Trie) -> list[_Level]:
    """The mapped levels, once per worker process."""
    return [_Level(trie, k) for k in range(1, trie.order + 1)]


def score_slice(trie: Trie, part) -> dict[str, np.ndarray]:
    levels = _levels(trie)
    tokens, bounds = token_hashes(part)
    distinct, of = np.unique(tokens, return_inverse=True)
    count = levels[0].counts(distinct)[of]
    base = (count + 1) / (trie.tokens + trie.words + 1)
    p = base.copy()
    open_ = np.arange(len(tokens))  # tokens whose longer contexts may be known
    for level in levels[1:]:
        context = contexts(tokens, bounds, level.level)[open_]
        share, weight = level.look_up(context, of[open_], distinct)
        p[open_] = share + weight * p[open_]
        open_ = open_[share > 0] if level.level > 2 else open_
    total = [sums(np.log10(x)) for x in (base, p)]
    known = sums((count > 0).astype(np.int64))
    a, b = bounds[:-1], bounds[1:]
    return {
        "n_tokens": b - a, "n_known": known[b] - known[a],
        "base_score": total[0][b] - total[0][a], "score": total[1][b] - total[1][a],
    }


def lm_scores(docs: DataFrame, modulus: int = 7, value: int = 2, order: int = 3, least: int = 1) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of
    every row of ``docs(doc_id, text, ...)``.

    Words are those of ``words.py`` with A-Z lower-cased; every text ends with one more token. The model
    learns from all rows with ``crc32(doc_id) mod modulus`` other than ``value``, repeated rows each time.
    ``base_score`` adds up the logarithms (base 10) of (n(w) + 1) / (N + V + 1). A null or empty text is the end token alone. A row with a null id
    is scored, never learned from, and not held out. Without a row to learn from N = V = 0 and every
    token has probability 1. Other columns are ignored. An empty table gives no rows. Texts of any
    length are read whole. Words are told apart by 64-bit hashes, contexts and successors in the trie by
    at least 32 bits each.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trie = train(texts.filter(remainder(F.col("doc_id"), modulus) != value), order, least)

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1), 1 << 21):
                found = score_slice(trie, part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, len(part)), *map(pa.array, found.values())],
                    ["doc_id", *found],
                )

    scored = texts.mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        "doc_id", fold(modulus, value), "n_tokens", "n_known",
        F.lit(trie.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
