"""Line dedup: two Bloom filters tell which lines may repeat; only those shuffle.

Every document is a set of line keys: the line without white space at both ends, A-Z lower-cased. One
pass over the texts sets bits for the keys of each slice of documents. The bits are merged by part of
the filter, in tasks: a bit that two slices set, or that one slice set for a key of two documents,
goes to the twice-seen filter. A key of two or more documents therefore always has all its bits there,
while a key of one document has them only by chance. The second pass looks every line up. Lines that
the twice-seen filter does not know stay, and nothing of them leaves the task. The suspected ones are
counted exactly, by a 128-bit cryptographic digest of the key, partial counts first, and the rows that
lose lines learn which. Filters only spare work: whatever they let through, the counts decide.

The filters have some ``BITS_PER_LINE`` bits a line and at most ``most_bits`` (64 MB). Tables of more
than 45 million lines keep the size and suspect more lines, at worst all, which then shuffle as digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .tables import stored
from .words import LOWER, SPACE, Slice, U, mix, prefix_hash, slices, span_hash, sums

BITS_PER_LINE = 12
PROBES = 3
PART_BITS = 16
MOST_BITS = 1 << 29
FLUSH_KEYS = 1 << 20
PROBE_FACTORS = mix(np.arange(1, PROBES + 1, dtype=U) * U(0x9E6C63D0876A9F4B)) | U(1)


class Lines:
    """Where the lines of some texts lie, and the key of each: a byte span."""

    def __init__(self, part: Slice):
        data, offsets = part.data, part.offsets
        breaks = np.flatnonzero(data == 10)
        owner = np.searchsorted(offsets, breaks, "right") - 1
        self.counts = np.bincount(owner, minlength=len(part)) + 1
        first = sums(self.counts)
        total = int(first[-1])
        inner = np.ones(total, bool)
        inner[first[:-1]] = False
        starts = np.empty(total, np.int64)
        starts[first[:-1]], starts[inner] = offsets[:-1], breaks + 1
        last = np.ones(total, bool)
        last[first[1:] - 1] = False
        ends = np.empty(total, np.int64)
        ends[first[1:] - 1], ends[last] = offsets[1:], breaks
        solid = np.flatnonzero(~SPACE[data])
        a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        some = b > a
        self.start, self.end = np.zeros(total, np.int64), np.zeros(total, np.int64)
        self.start[some], self.end[some] = solid[a[some]], solid[b[some] - 1] + 1
        self.owner = np.repeat(np.arange(len(part)), self.counts)
        self.number = np.arange(total) - np.repeat(first[:-1], self.counts)
        chars = sums(((data & 0xC0) != 0x80).astype(np.int64))
        self.chars = chars[self.end] - chars[self.start]
        self.lower = LOWER[data]

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(self.lower), self.start, self.end)


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash in a filter of 2^bits bits, a row for each probe."""
    return (mix(hashes[None, :] * PROBE_FACTORS[:, None]) >> U(64 - bits)).astype(np.int64)


def _by_part(where: np.ndarray) -> dict[int, bytes]:
    where = np.unique(where)
    parts, first = np.unique(where >> PART_BITS, return_index=True)
    low = (where & ((1 << PART_BITS) - 1)).astype("<u2")
    return {int(p): x.tobytes() for p, x in zip(parts, np.split(low, first[1:]), strict=True)} if len(where) else {}


BITS_SCHEMA = "part int, once binary, twice binary"


def _set_bits(bits: int, least: int):
    schema = pa.schema([("part", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def flush(gathered: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(gathered), return_counts=True)
        once = _by_part(_positions(keys, bits).ravel())
        twice = _by_part(_positions(keys[n > 1], bits).ravel())
        return pa.record_batch(
            [list(once), list(once.values()), [twice.get(p, b"") for p in once]], schema=schema
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = [], 0
        for batch in batches:
            for part in slices(batch.column("text")):
                lines = Lines(part)
                long = lines.chars >= least
                pairs = np.empty(int(long.sum()), [("owner", np.int64), ("key", U)])
                pairs["owner"], pairs["key"] = lines.owner[long], lines.hashes()[long]
                gathered.append(np.unique(pairs)["key"])
                held += len(gathered[-1])
                if held >= FLUSH_KEYS:
                    yield flush(gathered)
                    gathered, held = [], 0
        if held:
            yield flush(gathered)

    return run


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: the twice-seen bits of each part."""
    schema = pa.schema([("part", pa.int32()), ("bits", pa.binary())])
    now, once, twice = None, None, None

    def done() -> pa.RecordBatch:
        return pa.record_batch([[now], [np.packbits(twice).tobytes()]], schema=schema)

    for batch in batches:
        for part, seen, again in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if part != now:
                if now is not None and twice.any():
                    yield done()
                now, once, twice = part, np.zeros(1 << PART_BITS, bool), np.zeros(1 << PART_BITS, bool)
            seen = np.frombuffer(seen, "<u2")
            twice[seen[once[seen]]] = True
            twice[np.frombuffer(again, "<u2")] = True
            once[seen] = True
    if now is not None and twice.any():
        yield done()


def twice_seen(docs: DataFrame, least: int, most_bits: int = MOST_BITS) -> tuple[np.ndarray, int]:
    """The twice-seen filter as bytes, at most ``most_bits`` / 8 of them, and log2 of its bits."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)).first()[0] or 0
    bits = max(PART_BITS, min(int(lines * BITS_PER_LINE), most_bits).bit_length() - 1)
    rows = docs.select("text").mapInArrow(_set_bits(bits, least), BITS_SCHEMA)
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.repartition(min(width, 1 << (bits - PART_BITS)), "part").sortWithinPartitions("part")
    found = parts.mapInArrow(_merge, "part int, bits binary").toArrow()
    table = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (PART_BITS - 3)
    for part, body in zip(found["part"].to_pylist(), found["bits"], strict=True):
        table[part * size : (part + 1) * size] = np.frombuffer(body.as_buffer(), np.uint8)
    return table, bits


def _suspects(filter_bits, bits: int, least: int, schema: pa.Schema):
    """Each row with the digests of its suspected keys, and the lines of each; null if it has none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = filter_bits.value
        row = TaskContext.get().partitionId() << 33
        kind = schema.field("suspects").type
        for batch in batches:
            for part in slices(batch.column("text")):
                lines = Lines(part)
                at = np.flatnonzero(lines.chars >= least)
                hashes = lines.hashes()[at]
                seen = np.ones(len(at), bool)
                for where in _positions(hashes, bits):
                    seen &= (table[where >> 3] >> (7 - (where & 7))) & 1 == 1
                at, hashes = at[seen], hashes[seen]
                order = np.lexsort((hashes, lines.owner[at]))
                at, hashes = at[order], hashes[order]
                owner = lines.owner[at]
                new = np.ones(len(at), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
                first = np.flatnonzero(new)
                low = lines.lower.tobytes()
                keys = [
                    hashlib.blake2b(low[lines.start[i] : lines.end[i]], digest_size=16).digest() for i in at[first]
                ]
                per_key = pa.ListArray.from_arrays(
                    pa.array(np.append(first, len(at)), pa.int32()), pa.array(lines.number[at], pa.int32())
                )
                pairs = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), per_key], fields=list(kind.value_type))
                count = np.bincount(owner[first], minlength=len(part))
                found = pa.ListArray.from_arrays(
                    pa.array(sums(count), pa.int32()), pairs, type=kind, mask=pa.array(count == 0)
                )
                rows = batch.slice(part.first, len(part))
                yield pa.record_batch(
                    [
                        pa.array(np.arange(row, row + len(part))), rows.column("doc_id"),
                        rows.column("text").fill_null(""), pa.array(lines.counts), found,
                    ],
                    schema=schema,
                )
                row += len(part)

    return run


def _without(schema: pa.Schema):
    """Texts without the lines listed for them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = [], []
            for text, gone in zip(batch.column("text"), batch.column("gone"), strict=True):
                text, gone = text.as_py(), set(gone.as_py() or ())
                texts.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))
                sizes.append(len(gone))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("n_lines"), pa.array(sizes, pa.int64())],
                schema=schema,
            )

    return run


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, most_bits: int = MOST_BITS
) -> DataFrame:
    """Texts without the lines that ``min_docs`` documents share, but for one document that keeps them.

    Takes ``doc_id`` and ``text`` and no other column. Returns ``doc_id``, ``text`` (what stays, joined by
    newlines), ``n_lines`` (before) and ``n_dropped``, a row for each row.

    A key of at least ``min_chars`` code points that at least ``min_docs`` rows hold goes from all of them
    but the one with the largest id. Each row is a document: a repeated row counts each time, and rows that
    share the largest id all keep the line. A null id is smaller than any other, so such rows keep a line
    only if no row with an id holds it. A null text is an empty text, with one empty line. Memory follows
    a slice of 2 MB and the longest text. The filter, at most ``most_bits`` bits, is all that is broadcast.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    table, bits = twice_seen(docs, min_chars, most_bits)
    shared = spark.sparkContext.broadcast(table)
    kind = docs.schema["doc_id"].dataType
    pair = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("lines", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("doc_id", kind), T.StructField("text", T.StringType()),
        T.StructField("n_lines", T.LongType()), T.StructField("suspects", T.ArrayType(pair)),
    ])
    # Written, so that the numbers of the rows stand fast for the joins below.
    rows = stored(docs.mapInArrow(_suspects(shared, bits, min_chars, to_arrow_schema(schema)), schema), "line-suspects")
    shared.destroy()
    found = rows.filter("suspects IS NOT NULL").select("row", "doc_id", F.inline("suspects"))
    # Partial counts come before the shuffle. Written, because the join below is then between two exchanges:
    # of a frequent key one side has a row, the other many, which Spark's skew handling splits.
    repeated = stored(
        found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= min_docs).select("key", "keeper"),
        "repeated-lines",
    )
    gone = (
        found.join(repeated, "key").filter("NOT doc_id <=> keeper")
        .groupBy("row").agg(F.flatten(F.collect_list("lines")).alias("gone"))
    )
    out = T.StructType([*schema.fields[1:4], T.StructField("n_dropped", T.LongType())])
    suspected = rows.filter("suspects IS NOT NULL").select("row", "doc_id", "text", "n_lines").join(gone, "row", "left")
    cut = suspected.drop("row").mapInArrow(_without(to_arrow_schema(out)), out)
    clear = rows.filter("suspects IS NULL").select("doc_id", "text", "n_lines", F.lit(0).cast("long").alias("n_dropped"))
    return clear.unionByName(cut)
