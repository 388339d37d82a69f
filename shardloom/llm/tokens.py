"""Token ids of documents in Arrow stream files of equal-length sequences.

Method: Arrow stream-file format with fixed-size-list batches. A file holds the ids of a range of
documents in ascending order of id as rows of ``length`` ids. The ids and the mask are fixed-size
lists without nulls, so a row begins at a known place of one buffer: a reader maps the file and takes
any sequence without copying. The last row of a file is padded, and its mask says so. The document
index (id, first id within the file, count) lies beside it in a file of the same name.

The texts are encoded before they are moved: the shuffle by document ranges carries ids of two bytes
where the vocabulary allows. A file is written under a name of its own attempt and then renamed, so a
task that runs twice leaves one file. Encoding goes by pieces of words: the tokenizer splits at white space and
between letters and marks (tested against whole texts), so each distinct piece is encoded once.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path
from .tables import parts
from .words import LOWER, U, prefix_hash, ragged, slices, span_hash, sums

# Documents go to ranges of about so many ids per file.
FILE_TOKENS = 1 << 24
# Distinct pieces of words that a task remembers with their ids.
REMEMBERED = 1 << 20
BATCH_ROWS = 1 << 10


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder: a mounted one, or a store that Arrow knows."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return pafs.LocalFileSystem(), url.path
    return pafs.FileSystem.from_uri(path)


# Kinds of ASCII bytes; a piece of a word may end between a letter and a mark, where the tokenizer
# always splits. The apostrophe (contractions) and all bytes outside ASCII stay with their neighbours.
KIND = np.zeros(256, np.int8)
KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 1
KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = 2


class WordEncoder:
    """Ids of texts, by way of the ids of their distinct pieces of words.

    The tokenizer folds case, so pieces are told apart after folding A-Z; a slice that holds the
    beginning of a special token's name keeps its case and its words whole. A tokenizer that splits
    otherwise is found out at the start and given whole texts.
    """

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.by_pieces = self._splits_as_assumed()
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, U)
        self.first = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids: list[int] = []
        lengths = np.empty(len(pieces), np.int64)
        model = self.tokenizer.model
        for i, piece in enumerate(pieces):
            # Letters a-z are neither normalised nor split, so the model alone decides.
            if piece.isascii() and piece.isalpha() and piece.islower():
                own = [t.id for t in model.tokenize(piece)]
            else:
                own = self.tokenizer.encode(piece, add_special_tokens=False).ids
            lengths[i] = len(own)
            ids += own
        at = np.searchsorted(self.keys, keys)  # both ascending
        self.keys = np.insert(self.keys, at, keys)
        self.first = np.insert(self.first, at, len(self.ids) + sums(lengths)[:-1])
        self.length = np.insert(self.length, at, lengths)
        self.ids = np.concatenate([self.ids, np.array(ids, np.uint32)])

    def _splits_as_assumed(self) -> bool:
        """Whether this tokenizer folds case and splits at white space and at letter-mark borders."""
        whole = "Over  (the)\nQUICK, brown;fox's don't!? a-b C3po"
        pieces = ["over", "(", "the", ")", "quick", ",", "brown", ";", "fox's", "don't", "!?", "a", "-", "b", "c3po"]
        encode = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        plain = [t.id for t in self.tokenizer.model.tokenize("quick")]
        return encode(whole) == sum(map(encode, pieces), []) and plain == encode("quick")

    def encode(self, part) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and how many each text has."""
        if not self.by_pieces:
            texts = [part.text(i) for i in range(len(part))]
            each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            flat = np.array([i for x in each for i in x], np.uint32)
            return flat, np.array([len(x) for x in each], np.int64)
        part.find_words()
        data, starts, ends, bounds = part.data, part.starts, part.ends, part.bounds
        if b"<|" not in data.tobytes():
            data = LOWER[data]
            kind = KIND[data]
            inside = np.zeros(len(data) + 1, bool)
            inside[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
            cuts = np.flatnonzero(inside)
            # A text begins a word, so no cut within a word crosses two texts.
            cuts = cuts[~np.isin(cuts, part.offsets)]
            starts = np.sort(np.concatenate([starts, cuts]))
            ends = np.sort(np.concatenate([ends, cuts]))
            bounds = np.searchsorted(starts, part.offsets)
        h = span_hash(prefix_hash(data), starts, ends)
        order = np.argsort(h)
        sorted_h = h[order]
        new_run = np.ones(len(h), bool)
        new_run[1:] = sorted_h[1:] != sorted_h[:-1]
        distinct, first = sorted_h[new_run], order[new_run]
        inverse = np.empty(len(h), np.int64)
        inverse[order] = np.cumsum(new_run) - 1
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != distinct
        if len(self.keys) + new.sum() > REMEMBERED:
            self._forget()
            new[:] = True
        if new.any():
            body = data.tobytes()
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            self._learn(distinct[new], [body[a:b].decode() for a, b in spans])
            at = np.searchsorted(self.keys, distinct)
        lengths = self.length[at][inverse]
        ids = self.ids[ragged(self.first[at][inverse], lengths)]
        total = sums(lengths)
        return ids, total[bounds[1:]] - total[bounds[:-1]]


def encode(self, part) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and how many each text has."""
        if not self.by_pieces:
            texts = [part.text(i) for i in range(len(part))]
            each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            flat = np.array([i for x in each for i in x], np.uint32)
            return flat, np.array([len(x) for x in each], np.int64)
        part.find_words()
        h = span_hash(prefix_hash(part.data), part.starts, part.ends)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.keys)
        if len(self.keys) + new.sum() > REMEMBERED:
            self._forget()
            new[:] = True
        if new.any():
            spans = zip(part.starts[first[new]], part.ends[first[new]], strict=True)
            self._learn(distinct[new], [part.data[a:b].tobytes().decode() for a, b in spans])
        at = np.searchsorted(self.keys, distinct)[inverse]
        lengths = np.diff(self.starts)[at]
        ids = self.ids[ragged(self.starts[at], lengths)]
        total = sums(lengths)
        return ids, total[part.bounds[1:]] - total[part.bounds[:-1]]


@functools.cache
def _encoder(tokenizer_file: str) -> WordEncoder:
    """One per worker process, so that what it has learned serves the next task."""
    return WordEncoder(tokenizer_file)


def encode(
    docs: DataFrame, tokenizer_file: str, end_id: int = 2, wide: bool = False, cuts=()
) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian, two or four bytes each) of every row, and
    ``part``: how many of ``cuts`` lie below the id; rows without an id come after all others."""
    kind = "<u4" if wide else "<u2"
    edges = np.asarray(cuts, np.int64)

    def run(batches):
        encoder = _encoder(tokenizer_file)
        for batch in batches:
            for part in slices(batch.column(1), 1 << 20):
                ids, counts = encoder.encode(part)
                ends = np.cumsum(counts)
                ids = np.insert(ids.astype(kind), ends, end_id)
                body = ids.view(np.uint8)
                offsets = pa.py_buffer((sums(counts + 1) * ids.itemsize).astype(np.int32))
                packed = pa.BinaryArray.from_buffers(
                    pa.binary(), len(part), [None, offsets, pa.py_buffer(body)]
                )
                doc_ids = batch.column(0).slice(part.first, len(part))
                where = np.searchsorted(edges, doc_ids.fill_null(0).to_numpy())
                where[doc_ids.is_null().to_numpy(zero_copy_only=False)] = len(edges) + 1
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(counts + 1), packed, pa.array(where, pa.int32())],
                    ["doc_id", "n_tokens", "ids", "part"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, part int"
    )


class SequenceFile:
    """Writer of one file: rows of ``length`` ids and their masks, and the index of documents."""

    def __init__(self, folder: str, name: str, length: int, wide: bool):
        self.store, self.folder = store_of(folder)
        self.name, self.length = name, length
        self.dtype = np.dtype("<u4" if wide else "<u2")
        value = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema(
            [pa.field("ids", pa.list_(pa.field("item", value, False), length), False),
             pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), length), False)]
        )
        self.own = f"{self.folder}/.{name}-{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(f"{self.own}.arrows")
        self.writer = pa.ipc.new_stream(self.out, self.schema)
        self.rest = np.zeros(0, self.dtype)
        self.held: list[np.ndarray] = []
        self.size = 0
        self.docs: list[tuple] = []
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.tokens, len(ids)))
        self.tokens += len(ids)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= BATCH_ROWS * self.length:
            self._write(last=False)

    def _write(self, last: bool) -> None:
        ids = np.concatenate([self.rest, *self.held])
        self.held, self.size = [], 0
        valid = len(ids) if last else len(ids) // self.length * self.length
        rows = -(-valid // self.length)
        taken, self.rest = ids[:valid], ids[valid:]
        mask = np.ones(rows * self.length, bool)
        mask[valid:] = False
        full = np.zeros(rows * self.length, self.dtype)
        full[:valid] = taken
        batch = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type)
                 for x, f in zip((full, mask), self.schema, strict=True)]
        for a in range(0, rows, BATCH_ROWS):
            n = min(BATCH_ROWS, rows - a)
            self.writer.write_batch(
                pa.RecordBatch.from_arrays([c.slice(a, n) for c in batch], schema=self.schema)
            )

    def close(self) -> str:
        self._write(last=True)
        self.writer.close()
        self.out.close()
        index = pa.table(
            {k: pa.array(v, pa.int64()) for k, v in zip(("doc_id", "start", "n"), zip(*self.docs, strict=True), strict=True)}
        )
        with self.store.open_output_stream(f"{self.own}.index") as out, pa.ipc.new_stream(out, index.schema) as w:
            w.write_table(index)
        for end in ("index", "arrows"):
            self.store.move(f"{self.own}.{end}", f"{self.folder}/{self.name}.{end}")
        return self.name


def _map(store: pafs.FileSystem, path: str):
    local = isinstance(store, pafs.LocalFileSystem)
    return pa.memory_map(path) if local else store.open_input_file(path)


def read_sequences(folder: str, name: str) -> tuple[pa.Table, pa.Table]:
    """Sequences (``ids``, ``mask``) and document index of a file; mapped where the store is mounted."""
    store, root = store_of(folder)
    return tuple(
        pa.ipc.open_stream(_map(store, f"{root}/{name}.{end}")).read_all() for end in ("arrows", "index")
    )


def file_ids(sequences: pa.Table) -> np.ndarray:
    """All valid ids of a file in order."""
    out = [np.zeros(0, np.uint16)]
    for batch in sequences.to_batches():
        ids = batch.column(0).flatten().to_numpy()
        mask = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        out.append(ids if mask.all() else ids[mask])
    return np.concatenate(out[1:] or out)


def write_sequences(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int = 2,
    length: int = 2048,
    wide: bool = False,
    file_tokens: int = FILE_TOKENS,
    folder: str | None = None,
) -> DataFrame:
    """Encodes ``docs(doc_id, text, ...)`` and writes sequence files; returns the manifest.

    One row per file: ``part`` (files in ascending ``doc_id`` are in ascending ``part``), ``folder``,
    ``name``, ``n_docs``, ``n_tokens`` and ``first`` (ids of all files before it). ``wide`` stores four
    bytes per id, needed for vocabularies above 65,536.

    A null or empty text is the end id alone. Rows with a null id come last. Repeated ids are kept, in
    the order of their ids' bytes. Other columns are ignored. An empty table writes no file. A text of
    any length is encoded whole; the driver holds a row per file.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "sequences")
    store, root = store_of(folder)
    store.create_dir(root, recursive=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = parts(size // 2, file_tokens)
    cuts: list[int] = []
    if n > 1:
        share = F.array(*[F.lit(i / n) for i in range(1, n)])
        found = docs.agg(F.percentile_approx("doc_id", share, F.lit(max(10_000, 20 * n)))).first()[0]
        cuts = sorted(set(found or []))
    rows = encode(docs, tokenizer_file, end_id, wide, cuts)
    rows = rows.repartitionById(len(cuts) + 2, F.col("part")).sortWithinPartitions(
        "part", F.col("doc_id").asc_nulls_last(), "n_tokens", "ids"
    )

    def run(batches):
        file = None
        for batch in batches:
            for part, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids")), strict=True):
                name = f"part-{part:07d}"
                if file is None or file.name != name:
                    if file is not None:
                        yield done(file)
                    file = SequenceFile(folder, name, length, wide)
                file.add(doc_id, np.frombuffer(ids, file.dtype))
        if file is not None:
            yield done(file)

    def done(file):
        name = file.close()
        return pa.RecordBatch.from_pydict(
            {"part": [int(name[5:])], "folder": [folder], "name": [name], "n_docs": [len(file.docs)],
             "n_tokens": [file.tokens]}
        )

    kind = "part long, folder string, name string, n_docs long, n_tokens long"
    files = sorted(map(tuple, rows.mapInArrow(run, kind).collect()))
    first, out = 0, []
    for row in files:
        out.append((*row, first))
        first += row[-1]
    return spark.createDataFrame(out, kind + ", first long")


def read_documents(manifest: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, from the files."""

    def run(batches):
        for batch in batches:
            for folder, name, first in zip(*(batch.column(c).to_pylist() for c in ("folder", "name", "first")), strict=True):
                sequences, index = read_sequences(folder, name)
                ids = file_ids(sequences)
                start, n = index["start"].to_numpy(), index["n"].to_numpy()
                crc = [zlib.crc32(ids[a : a + k].astype("<u4").tobytes()) for a, k in zip(start, n, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [index["doc_id"].combine_chunks(), pa.array(start + first), pa.array(n), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # One task per file: a file is found by name, so any executor can read any of them.
    last = manifest.agg(F.max("part")).first()[0] or 0
    return manifest.repartitionById(last + 1, F.col("part").cast("int")).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
