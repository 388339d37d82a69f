"""Personal data: fixed forms, and bootstrapped contextual extraction of what has no fixed form.

Base kinds have a grammar and are found by it. They are also the seeds of a bootstrap: the words around a
seed are lexical patterns (two before, one on each side, two behind). Spark counts, over all documents,
how often each pattern stands around a seed, around another identifier-like word (one with at least two
digits), and around anything else. On that graph of patterns and instances, the confidence of a pattern
is the mean belief in its instances, and the belief in an instance is that of its best pattern; seeds are
believed, ordinary words are not, and some rounds spread the belief. Identifier-like words in a pattern of
high confidence are reported as kind ``other``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored
from .words import PLACE, U, mix, slices

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits can only begin a match at its first digit.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SUPPORT = 3  # different seeds that a pattern must have stood around
CONFIDENCE = 0.7
ROUNDS = 3
# Bits of the filter that spares words whose patterns no seed stood in. All that passes is joined with the
# patterns themselves, so a filter that fills up costs time and loses nothing.
FILTER = 1 << 27
SALTS = 16


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind."""
    out = []
    if "@" in text:
        out += [(a, b, 0) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


class _Words:
    """Words of a slice with the patterns around each, and the base spans of its texts."""

    def __init__(self, part):
        part.find_words()
        self.part, self.bounds = part, part.bounds
        h = part.word_hashes()
        n = len(h)
        of = np.repeat(np.arange(len(part)), np.diff(part.bounds))
        near = np.zeros((4, n), U)  # two before, one before, one behind, two behind; 0 beyond the text
        for row, step in enumerate((-2, -1, 1, 2)):
            a, b = max(0, -step), n - max(0, step)
            if b > a:
                same = of[a:b] == of[a + step : b + step]
                near[row, a:b] = np.where(same, h[a + step : b + step], U(0))
        self.word = h
        self.patterns = np.stack(
            [mix(near[i] * PLACE[2 * k] + near[j] * PLACE[2 * k + 1] + U(k)) for k, (i, j) in enumerate(((0, 1), (1, 2), (2, 3)))]
        ) if n else np.zeros((3, 0), U)
        digit = (part.data >= 48) & (part.data <= 57)
        total = np.concatenate([[0], np.cumsum(digit)])
        self.like = (total[part.ends] - total[part.starts] >= 2) & (part.ends - part.starts >= 6)
        # Texts without a digit or an @ have no base span.
        marks = total[part.offsets[1:]] > total[part.offsets[:-1]]
        signs = np.concatenate([[0], np.cumsum(part.data == 64)])
        marks |= signs[part.offsets[1:]] > signs[part.offsets[:-1]]
        self.base = {int(t): base_spans(part.text(t)) for t in np.flatnonzero(marks)}
        # First and last word of every base span, and the words that a base span touches.
        self.seeds, self.taken = [], np.zeros(n, bool)
        for t, spans in self.base.items():
            if not spans:
                continue
            chars = self.char_bounds(t)
            for a, b, _ in spans:
                first = self.bounds[t] + int(np.searchsorted(chars[1], a, "right"))
                last = self.bounds[t] + int(np.searchsorted(chars[0], b, "left")) - 1
                self.seeds.append((first, last))
                self.taken[first : last + 1] = True

    def char_bounds(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of a text begin and end, in code points."""
        part = self.part
        lo, a, b = part.offsets[t], self.bounds[t], self.bounds[t + 1]
        first = (part.data[lo : part.offsets[t + 1]] & 0xC0) != 0x80
        count = np.concatenate([[0], np.cumsum(first)])
        return count[part.starts[a:b] - lo], count[part.ends[a:b] - lo]

    def seed_patterns(self):
        """(pattern, instance) of every base span: what is before its first and behind its last word."""
        for first, last in self.seeds:
            inside = hash(tuple(self.word[first : last + 1].tolist())) & ((1 << 62) - 1)
            yield int(self.patterns[0, first]), inside
            yield int(self.patterns[2, last]), inside
            if first == last:
                yield int(self.patterns[1, first]), inside


def _signed(x) -> np.ndarray:
    return np.asarray(x, U).view(np.int64)


def _seed_edges(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1), 1 << 20):
                found = list(_Words(part).seed_patterns())
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_signed([p for p, _ in found])), pa.array([i for _, i in found], pa.int64())],
                        ["pattern", "instance"],
                    )

    edges = docs.mapInArrow(run, "pattern long, instance long")
    return edges.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"))


def _filter(patterns: DataFrame) -> np.ndarray:
    """A bitmap of hashed patterns: ``FILTER`` bits, however many patterns there are."""
    rows = patterns.groupBy(F.expr(f"shiftright(pattern & {FILTER - 1}L, 6)").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(pattern & 63 AS INT)))").alias("bits")
    ).toArrow()
    out = np.zeros(FILTER // 64, U)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(U)
    return out


def _passes(bitmap: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    return (bitmap[((pattern & U(FILTER - 1)) >> U(6)).astype(np.int64)] >> (pattern & U(63))) & U(1) != 0


def _other_edges(docs: DataFrame, known) -> DataFrame:
    """How often patterns of a filter stand around identifier-like words, and (instance 0) around others."""

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1), 1 << 20):
                words = _Words(part)
                rows = []
                for row in words.patterns:
                    at = np.flatnonzero(_passes(known.value, row) & ~words.taken)
                    rows.append((row[at], np.where(words.like[at], words.word[at] >> U(2), U(0))))
                pattern, instance = (np.concatenate(x) for x in zip(*rows, strict=True))
                if len(pattern):
                    order = np.lexsort((instance, pattern))
                    pattern, instance = pattern[order], instance[order]
                    new = np.ones(len(order), bool)
                    new[1:] = (pattern[1:] != pattern[:-1]) | (instance[1:] != instance[:-1])
                    n = np.diff(np.flatnonzero(new), append=len(order))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_signed(pattern[new])), pa.array(_signed(instance[new])), pa.array(n)],
                        ["pattern", "instance", "n"],
                    )

    edges = docs.mapInArrow(run, "pattern long, instance long, n long")
    return edges.groupBy("pattern", "instance").agg(F.sum("n").alias("n"))


def trusted_patterns(
    docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS
) -> DataFrame:
    """Hashes (``pattern``) of the patterns that the bootstrap ends up trusting."""
    spark = docs.sparkSession
    seeds = stored(_seed_edges(docs), "pii-seeds")
    strong = seeds.groupBy("pattern").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= support)
    strong = stored(strong.select("pattern"), "pii-patterns")
    known = spark.sparkContext.broadcast(_filter(strong))
    edges = (
        seeds.withColumn("belief", F.lit(1.0))
        .unionByName(_other_edges(docs, known).withColumn("belief", F.lit(0.0)))
        .join(strong, "pattern", "left_semi")
    )
    edges = stored(edges.withColumn("seed", F.col("belief") == 1.0), "pii-graph")
    for _ in range(rounds):
        trust = edges.groupBy("pattern").agg((F.sum(F.col("belief") * F.col("n")) / F.sum("n")).alias("trust"))
        belief = edges.filter("NOT seed AND instance <> 0").join(trust, "pattern")
        belief = belief.groupBy("instance").agg(F.max("trust").alias("found"))
        edges = stored(
            edges.join(belief, "instance", "left")
            .withColumn("belief", F.when(F.col("seed"), 1.0).when(F.col("instance") == 0, 0.0).otherwise(F.coalesce("found", F.lit(0.0))))
            .drop("found"),
            "pii-graph",
        )
    trust = edges.groupBy("pattern").agg((F.sum(F.col("belief") * F.col("n")) / F.sum("n")).alias("trust"))
    return stored(trust.filter(F.col("trust") >= confidence).select("pattern"), "pii-trusted")


def personal_data(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Counts and spans of personal data of every row of ``docs(doc_id, text, ...)``.

    Returns ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans`` and
    ``n_other``. Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind, joined
    by commas; kinds of the bootstrap come last. A null or empty text has none, and the hash of the empty
    string. A row with a null id is searched like any other; repeated rows are all returned, and count as
    often in the bootstrap. Other columns are ignored. An empty table gives no rows. Texts of any length
    are searched whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trusted = trusted_patterns(docs, support, confidence)
    known = docs.sparkSession.sparkContext.broadcast(_filter(trusted))
    columns = [f"n_{k}" for k in KINDS]
    every = (*KINDS, "other")
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    maybe = pa.struct([("pattern", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1), 1 << 20):
                words = _Words(part)
                more: dict[int, list] = {}
                for row in words.patterns:
                    for w in np.flatnonzero(_passes(known.value, row) & words.like & ~words.taken):
                        t = int(np.searchsorted(words.bounds, w, "right")) - 1
                        more.setdefault(t, []).append((int(w - words.bounds[t]), int(row[w].view(np.int64))))
                rows = []
                for t in range(len(part)):
                    base = words.base.get(t, [])
                    text = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
                    first, last = words.char_bounds(t) if t in more else ((), ())
                    kinds = [k for _, _, k in base]
                    rows.append((
                        *(kinds.count(k) for k in KINDS), hashlib.sha256(text.encode()).hexdigest(),
                        [(a, KINDS.index(k), b) for a, b, k in base],
                        [(p, int(first[w]), int(last[w])) for w, p in more.get(t, [])],
                    ))
                types = [pa.int64()] * 4 + [pa.string(), pa.list_(span), pa.list_(maybe)]
                own = batch.slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(2), own.column(3)]
                    + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                    ["doc_id", "k1", "k2", *columns, "base_sha256", "base", "maybe"],
                )

    # Two hashes name a text, whatever ids its rows have.
    keyed = docs.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(1), "text"))
    found = stored(
        keyed.mapInArrow(
            run,
            "doc_id long, k1 long, k2 long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
            "base array<struct<start: bigint, kind: int, end: bigint>>, "
            "maybe array<struct<pattern: bigint, start: bigint, end: bigint>>",
        ),
        "pii-found",
    )
    none = F.lit(None).cast("array<struct<start: bigint, kind: int, end: bigint>>")
    other = F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")
    hits = (
        found.select("k1", "k2", F.inline("maybe")).distinct().join(trusted, "pattern", "left_semi")
        .groupBy("k1", "k2").agg(F.collect_set(other).alias("other"))
    )
    # One text may be a third of all rows: they are spread, and its spans repeated, once per salt.
    hits = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    open_ = found.filter(F.size("maybe") > 0).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    rows = (
        open_.join(hits, ["k1", "k2", "salt"], "left").drop("salt")
        .unionByName(found.filter(F.size("maybe") == 0).withColumn("other", none))
        .withColumn("other", F.coalesce("other", F.expr("slice(base, 1, 0)")))
    )
    names = F.array(*map(F.lit, every))
    spans = F.transform(
        F.array_sort(F.concat("base", "other")),
        lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")),
    )
    return rows.select(
        "doc_id", *columns, "base_sha256", F.array_join(spans, ",").alias("spans"),
        F.size("other").cast("long").alias("n_other"),
    )
