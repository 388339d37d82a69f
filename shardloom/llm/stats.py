"""Statistics of whole texts for the quality operators, a batch at a time in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import held_out, remainder
from .words import U, mix, prefix_hash, slices, span_hash, sums, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
DIGIT = np.zeros(256, bool)
DIGIT[ord("0") : ord("9") + 1] = True
MARK = np.zeros(256, bool)
MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
HIGH = np.arange(256) >= 0xC0  # first bytes of characters outside ASCII

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_digits", "n_marks", "n_other", "n_distinct", "n_commonest", "n_stops", "n_chars"]
# Shares that the learners see; each has a value for every text, 0 where the text has no word.
FEATURES = {
    "log_words": "ln(1 + n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "other_share": "n_other / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "commonest_share": "n_commonest / greatest(n_words, 1)",
    "stop_share": "n_stops / greatest(n_words, 1)",
    "space_share": "(n_chars - word_chars) / greatest(n_words, 1)",
}


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = sums(values.astype(np.int64))
    return total[offsets[1:]] - total[offsets[:-1]]


def slice_stats(part) -> dict[str, np.ndarray]:
    part.find_words()
    data, offsets, bounds = part.data, part.offsets, part.bounds
    n = np.diff(bounds)
    texts = len(part)
    prefix = prefix_hash(data)
    words = span_hash(prefix, part.starts, part.ends)
    of = np.repeat(np.arange(texts), n)
    first_byte = (data & 0xC0) != 0x80
    in_words = sums(first_byte.astype(np.int64))
    out = {
        "n_words": n,
        "word_chars": np.bincount(of, in_words[part.ends] - in_words[part.starts], texts).astype(np.int64),
        "n_symbols": _per_text(SYMBOLS[data], offsets),
        "n_upper": _per_text(UPPER[data], offsets),
        "n_digits": _per_text(DIGIT[data], offsets),
        "n_marks": _per_text(MARK[data], offsets),
        "n_other": _per_text(HIGH[data], offsets),
        "n_chars": _per_text(first_byte, offsets),
    }
    # Lines: a text of k newlines has k + 1; those with a word count.
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(texts), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((np.arange(len(starts)) >= texts, starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.ones(len(starts), bool)
    last[:-1] = owner[1:] != owner[:-1]
    ends[last] = offsets[owner[last] + 1]
    full = np.searchsorted(part.starts, ends) > np.searchsorted(part.starts, starts)
    starts, ends, owner = starts[full], ends[full], owner[full]
    out["n_lines"] = np.bincount(owner, minlength=texts)
    line = mix(span_hash(prefix, starts, ends) ^ mix(owner.astype(U) + U(1)))
    out["n_dup_lines"] = out["n_lines"] - _distinct(line, owner, texts)[0]
    # Words in repeated 8-word windows.
    view, counts = windows(words, bounds, 8)
    owner = np.repeat(np.arange(texts), counts)
    long = n[owner] >= 8
    at = (np.arange(len(view)) - np.repeat(sums(counts)[:-1], counts) + np.repeat(bounds[:-1], counts))[long]
    key = mix(view[long] ^ mix(owner[long].astype(U) + U(1)))
    order = np.argsort(key)
    twin = np.zeros(len(key), bool)
    same = key[order][1:] == key[order][:-1]
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[twin], 1)
    np.add.at(cover, at[twin] + 8, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(cover)[:-1] > 0, bounds)
    key = mix(words ^ mix(of.astype(U) + U(1)))
    out["n_distinct"], out["n_commonest"] = _distinct(key, of, texts)
    # Words of up to three bytes stand for function words, whatever the language.
    out["n_stops"] = np.bincount(of, part.ends - part.starts <= 3, texts).astype(np.int64)
    return out


def _distinct(key: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each owner, and how often its commonest occurs."""
    distinct, first, count = np.unique(key, return_index=True, return_counts=True)
    who = owner[first]
    most = np.zeros(texts, np.int64)
    np.maximum.at(most, who, count)
    return np.bincount(who, minlength=texts), most


def text_stats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts ``BASE`` and ``MORE`` (long) of every row; all 0 for a null text."""
    columns = [*BASE, *MORE]

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1), 1 << 20):
                stats = slice_stats(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, len(part))]
                    + [pa.array(stats[c], pa.int64()) for c in columns],
                    ["doc_id", *columns],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in columns)
    )


def with_features(stats: DataFrame) -> DataFrame:
    return stats.select("*", *[F.expr(f"CAST({e} AS DOUBLE)").alias(f) for f, e in FEATURES.items()])


def known_labels(labels: DataFrame, column: str, modulus: int, value: int) -> DataFrame:
    """``doc_id`` and ``label`` (0 or 1) outside the held-out fold. A doc_id counts once; one with two
    different labels, or a null, not at all."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .filter("doc_id IS NOT NULL AND label IN (0, 1)")
        .filter(remainder(F.col("doc_id"), modulus) != value)
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .filter("label = other").select("doc_id", "label")
    )


def sampled_labels(labels: DataFrame, column: str, modulus: int, value: int, per_class: int) -> DataFrame:
    """At most ``per_class`` of the ``known_labels`` of each class."""
    known = known_labels(labels, column, modulus, value)
    order = F.xxhash64(F.lit(11), "doc_id")
    of = [known.filter(F.col("label") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    return of[0].union(of[1])


def fold(modulus: int, value: int):
    return held_out(F.col("doc_id"), modulus, value).alias("held_out")
