"""Language identification by rank-order profiles.

A language's profile lists its most frequent letter n-grams (one to three letters, words padded with a
border sign) in order of frequency, counted over all labelled documents. A document is compared by the
out-of-place distance: the n-grams it uses most, in its own order, against their places in each profile;
one that a profile lacks costs the length of the profile. The nearest profile wins.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import fold
from .tables import remainder, stored
from .words import ragged, slices, sums

PROFILE = 400  # n-grams of a language
DOCUMENT = 300  # n-grams of a document
MERGED = 1 << 21  # counts that a task holds before it passes them on
UNKNOWN = "und"
BORDER = ord("_")


@functools.cache
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, and its lower case where that is one letter."""
    letter = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            letter[c] = True
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return letter, lower


def ngrams(part) -> tuple[np.ndarray, np.ndarray]:
    """Code and text number of every n-gram of a slice. Three code points fit one code exactly."""
    letter, lower = _alphabet()
    points = np.frombuffer(part.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    starts_of = sums(((part.data & 0xC0) != 0x80).astype(np.int64))[part.offsets]
    text = np.repeat(np.arange(len(part)), np.diff(starts_of))
    at = np.flatnonzero(letter[points])
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = text[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (text[1:] != text[:-1])
    word = np.cumsum(new) - 1
    # Every word with one border before and one behind it.
    padded = np.full(len(at) + 2 * (word[-1] + 1), BORDER, np.uint64)
    place = np.arange(len(at)) + 2 * word + 1
    padded[place] = lower[points[at]]
    owner = np.empty(len(padded), np.int64)
    owner[place] = text
    first = place[new] - 1
    owner[first] = text[new]
    owner[np.append(first[1:] - 1, len(padded) - 1)] = text[new]
    pair = (padded[:-1] << np.uint64(21)) | padded[1:]
    triple = (pair[:-1] << np.uint64(21)) | padded[2:]
    two = np.ones(len(pair), bool)
    two[first[1:] - 1] = False  # from the border behind a word to the one before the next
    three = two[:-1] & two[1:]
    codes = np.concatenate([padded[place], pair[two], triple[three]])
    return codes, np.concatenate([text, owner[:-1][two], owner[:-2][three]])


def _merge(kept: list[tuple]) -> tuple:
    lang, code, count = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.lexsort((code, lang))
    lang, code, count = lang[order], code[order], count[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (lang[1:] != lang[:-1])
    at = np.flatnonzero(new)
    return lang[at], code[at], np.add.reduceat(count, at) if len(at) else count


def ngram_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``code``, ``n``: how often each language uses each n-gram, over all ``docs``."""

    def run(batches):
        names: dict[str, int] = {}
        kept: list[tuple] = []
        held = 0

        def rows():
            lang, code, count = _merge(kept)
            label = np.array(list(names), object)
            for a in range(0, len(lang), 1 << 16):
                b = a + (1 << 16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label[lang[a:b]], pa.string()), pa.array(code[a:b].view(np.int64)), pa.array(count[a:b])],
                    ["lang", "code", "n"],
                )

        for batch in batches:
            lang = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], np.int64)
            for part in slices(batch.column(1), 1 << 20):
                codes, text = ngrams(part)
                distinct, inverse = np.unique(codes, return_inverse=True)
                key = lang[part.first + text] * len(distinct) + inverse
                key, count = np.unique(key, return_counts=True)
                if len(key):
                    kept.append((key // len(distinct), distinct[key % len(distinct)], count))
                    held += len(key)
                if held > MERGED:
                    kept = [_merge(kept)]
                    held = len(kept[0][0])
                    if held > MERGED // 2:
                        yield from rows()
                        kept, held = [], 0
        if kept:
            yield from rows()

    counts = docs.select("lang", "text").mapInArrow(run, "lang string, code long, n long")
    return counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def profiles(counts: DataFrame, length: int = PROFILE) -> DataFrame:
    """The ``length`` most frequent n-grams of each language and their places, from 0."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return counts.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < length)


class Profiles:
    """Places of all profile n-grams in all languages, for numpy."""

    def __init__(self, rows: list[tuple[str, int, int]], length: int = PROFILE):
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[1] for r in rows], np.int64).view(np.uint64))
        self.places = np.full((len(self.codes) + 1, max(1, len(self.langs))), length, np.float32)
        index = {x: i for i, x in enumerate(self.langs)}
        at = np.searchsorted(self.codes, np.array([r[1] for r in rows], np.int64).view(np.uint64))
        for i, (lang, _, place) in zip(at, rows, strict=True):
            self.places[i, index[lang]] = place
        self.length = length

    def identify(self, part, most: int = DOCUMENT) -> tuple[list[str], np.ndarray]:
        texts = len(part)
        codes, text = ngrams(part)
        names, score = [UNKNOWN] * texts, np.zeros(texts)
        if not len(codes) or not self.langs:
            return names, score
        distinct, inverse = np.unique(codes, return_inverse=True)
        key, count = np.unique(text * len(distinct) + inverse, return_counts=True)
        text, code = key // len(distinct), distinct[key % len(distinct)]
        order = np.lexsort((code, -count, text))
        text, code = text[order], code[order]
        sizes = np.bincount(text, minlength=texts)
        place = ragged(np.zeros(texts, np.int64), sizes)
        used = place < most
        text, code, place = text[used], code[used], place[used]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        at[self.codes[at] != code] = len(self.codes)
        known = self.places[at]
        away = np.where(known < self.length, np.abs(known - place[:, None]), self.length)
        total = np.stack([np.bincount(text, a, texts) for a in away.T], axis=1)
        total /= np.maximum(np.minimum(sizes, most), 1)[:, None] * self.length
        near = total.argmin(1)
        ordered = np.sort(total, axis=1)
        best = ordered[:, 0]
        second = ordered[:, 1] if total.shape[1] > 1 else np.ones(texts)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(second > 0, 1 - best / second, 0.0)
        has = sizes > 0
        names = [self.langs[i] if h else UNKNOWN for i, h in zip(near, has, strict=True)]
        return names, np.clip(np.where(has, score, 0.0), 0, 1)


def identify_languages(docs: DataFrame, modulus: int = 5, value: int = 0, length: int = PROFILE) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row of ``docs(doc_id, text, lang, ...)``.

    Profiles are counted over all rows whose ``lang`` is not null and whose ``crc32(doc_id) mod modulus``
    is not ``value``; a prediction looks at the text alone. ``score`` is how much nearer the winner is than
    the next language (0: a tie, which the first name in code point order wins). A text that is null or has
    no letter, and any text where nothing could be learned, is ``und`` with score 0. A row with a null id
    is predicted, never learned from, and not held out; repeated rows count each time. Other columns are
    ignored. An empty table gives no rows. Texts of any length are read whole.
    """
    train = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(
        remainder(F.col("doc_id").cast("long"), modulus) != value
    )
    rows = profiles(stored(ngram_counts(train), "language-counts"), length)
    rows = [(r["lang"], r["code"], r["place"]) for r in rows.select("lang", "code", "place").collect()]
    known = docs.sparkSession.sparkContext.broadcast(Profiles(rows, length))  # languages x length rows

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1), 1 << 20):
                names, score = known.value.identify(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, len(part)), pa.array(names, pa.string()), pa.array(score)],
                    ["doc_id", "lang_pred", "score"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double").select(
        "doc_id", fold(modulus, value), "lang_pred", "score"
    )
