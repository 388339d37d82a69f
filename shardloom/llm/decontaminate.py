"""Benchmark decontamination by latent semantic retrieval, with exact retrieval of shared words beside it.

Passages are bags of hashed words with TF-IDF weights. For every few dozen parts of benchmark passages a
randomised SVD, whose products with the passage matrix are summed over tasks, gives the axes of a latent
space in which each part keeps ``SHARE`` of its length or more, however large the benchmark is. Every document is cut into
blocks of words, every run of blocks long enough for a passage is a region, and regions whose cosine with a
part reaches ``COSINE`` are candidates. A second way finds the regions that hold half of a part's words,
by postings of its rarer words, so that no copy depends on the fit.

A candidate is accepted if the longest common subsequence of words covers enough of the part; or covers less
but the answer, or the part's rarest words where it has no answer, is there too: so paraphrases are
found and topical neighbours are not. A bound on the subsequence, for all candidates of a slice at once, comes first.

Word frequencies are counted over all documents, the axes are fitted on all passages of all documents
beside those of the benchmark, and every passage of every document is searched. The
benchmark is a stated set of queries: it is matched in blocks, each of bounded size, against all rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored
from .words import SLICE_BYTES, U, Slice, distinct, give_back, ragged, slices, sums

TERMS = 1 << 15
RANK = 64
SPACE_PARTS = 48  # parts of benchmark passages that share a space
SPACES = 8  # spaces that are searched in one pass over the documents
SHARE = 0.9  # of its length that each part keeps, at least
EMPHASIS = 256  # times a benchmark passage counts in the fit
CORPUS = 8_192  # passages that all documents count for in the fit, if they have more
MIXED = 256  # rows in which a task adds up its passages with random signs
RANGE = 2_048  # terms whose products are summed together
BLOCK = 8  # words
LONGEST = 48  # words of a part of a benchmark passage
COPY, PARAPHRASE, KEYS = 0.65, 0.5, 0.8
COSINE, LATENT = 0.15, 0.3  # of a latent candidate: its cosine, and the least share of words in order
FAINT = 0.05  # weights of terms in a part's latent vector below this share of its largest add nothing


_SPACE = bytes(i for i in range(128) if chr(i).isspace())
_GONE = bytes(i for i in range(128) if not (chr(i).isalnum() or chr(i).isspace()))
_ASCII = bytes(32 if i in _SPACE else i + 32 if 65 <= i <= 90 else i for i in range(256))
_COMMON = frozenset(c for c in map(chr, range(0x3000)) if c.isalnum() or c == " ")
_DROP = re.compile(r"[^\w\s]|_")  # all but white space and what str.isalnum accepts


def _fold_bytes(text: bytes) -> bytes:
    """A text as it is compared: lower case, letters, digits and blanks only."""
    text = text.translate(_ASCII, _GONE)
    if text.isascii():
        return text
    folded = text.decode().lower()
    if not _COMMON.issuperset(folded):
        folded = " ".join(_DROP.sub("", folded).split())
    return folded.encode()


def _fold(text: str) -> list[str]:
    return _fold_bytes(text.encode()).decode().split()


def _folded(texts: pa.Array, max_bytes: int = SLICE_BYTES):
    """``slices`` of the folded texts."""
    for part in slices(texts, max_bytes):
        body = [_fold_bytes(x.tobytes()) for x in np.split(part.data, part.offsets[1:-1])]
        offsets = sums(np.array([len(x) for x in body], np.int64))
        yield Slice(part.first, np.frombuffer(b"".join(body), np.uint8), offsets)


def _terms(part) -> np.ndarray:
    part.find_words()
    return (part.word_hashes() & U(TERMS - 1)).astype(np.int64)


def _blocks(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every block of ``width`` words, and blocks per text."""
    n = np.diff(bounds)
    count = -(-n // width)
    return np.repeat(bounds[:-1], count) + width * ragged(np.zeros_like(count), count), count


def _places(terms: np.ndarray, first: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The terms, those ``known`` if given, in order, and the blocks that each occurs in."""
    at = np.arange(len(terms)) if known is None else np.flatnonzero(known[terms])
    return np.divmod(distinct(terms[at] * len(first) + (np.searchsorted(first, at, "right") - 1)), len(first))


def _texts(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block of each block's text, and the first one after it."""
    ends = sums(count)
    return np.repeat(ends[:-1], count), np.repeat(ends[1:], count)


def _passages(docs: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """The distinct terms of all passages of all documents, how often each occurs there, and terms per passage;
    in how many passages each term occurs; passages."""

    def run(batches):
        seen, passages = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for part in _folded(batch.column(0)):
                terms = _terms(part)
                if not len(terms):
                    continue
                first, count = _blocks(part.bounds, LONGEST)
                of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(terms))))
                pairs = np.sort(of * TERMS + terms)
                at = np.flatnonzero(np.diff(pairs, prepend=-1))
                of, terms = np.divmod(pairs[at], TERMS)
                seen += np.bincount(terms, minlength=TERMS)
                passages += int(count.sum())
                body = terms.astype("<u2"), np.diff(np.append(at, len(pairs))).astype("u1"), np.bincount(of).astype("u1")
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 2 + [pa.array([x.tobytes()]) for x in body], names)
        at = np.flatnonzero(seen)
        counts = [pa.array(np.append(at, -1)), pa.array(np.append(seen[at], passages))]
        yield pa.RecordBatch.from_arrays(counts + [pa.nulls(len(at) + 1, pa.binary())] * 3, names)

    names = ["term", "n", "terms", "times", "sizes"]
    found = docs.select("text").mapInArrow(run, "term long, n long, terms binary, times binary, sizes binary")
    found = stored(found, "passages")
    table = found.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most TERMS + 1 rows
    term, n = table["term"].to_numpy(), table["n"].to_numpy()
    out = np.zeros(TERMS)
    out[term[term >= 0]] = n[term >= 0]
    return found.filter("term IS NULL").select("terms", "times", "sizes"), out, int(n[term < 0].sum())


def _bags(words: np.ndarray, of: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and value of the TF-IDF vectors of passages, each of unit length."""
    pairs = np.sort(of * TERMS + words)
    at = np.flatnonzero(np.diff(pairs, prepend=-1))
    of, words = pairs[at] // TERMS, pairs[at] % TERMS
    x = np.diff(np.append(at, len(pairs))) * weight[words]
    return of, words, x / (np.sqrt(np.bincount(of, x * x))[of] + 1e-12)


def _drawn(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((TERMS, RANK), np.float32)


def corpus_products(bags: DataFrame, idf: np.ndarray, passages: int, seed: int = 1) -> DataFrame:
    """X'(X random) for the TF-IDF passages X of all documents, in ranges of terms.

    A task adds its passages with random signs to ``MIXED`` rows M, each passage to one, so that the mean of
    M'M is X'X; with no more than so many passages M'M is X'X. The products of the tasks are summed. All
    documents together count for ``CORPUS`` passages at most.
    """
    shared = bags.sparkSession.sparkContext.broadcast(idf.astype(np.float32))

    def run(batches):
        weight, sign = shared.value, np.random.default_rng([seed, TaskContext.get().partitionId()])
        mixed, done = np.zeros((MIXED, TERMS), np.float32), 0
        for batch in batches:
            for body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms, times, sizes = (np.frombuffer(x, k).astype(np.int64) for x, k in zip(body, ("<u2", "u1", "u1"), strict=True))
                x = weight[terms] * times.astype(np.float32)
                length = np.sqrt(np.add.reduceat(x * x, sums(sizes)[:-1])) + 1e-12
                x *= np.repeat((sign.integers(0, 2, len(sizes)) * 2 - 1).astype(np.float32) / length, sizes)
                # Neighbours share a row, as far as there are more than rows: a row stays in the cache meanwhile.
                row = (done + np.arange(len(sizes)) * MIXED // max(MIXED, len(sizes))) % MIXED
                np.add.at(mixed.reshape(-1), np.repeat(row, sizes) * TERMS + terms, x)
                done += len(sizes)
        if not done:
            return
        out = mixed.T @ (mixed @ _drawn(seed)) * np.float32(min(1, CORPUS / passages))
        for at in range(0, TERMS, RANGE):
            yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int32()), "body": [out[at : at + RANGE].tobytes()]})
        give_back()

    def total(key, found):
        out = np.zeros(RANGE * RANK)
        for body in found["body"]:
            out += np.frombuffer(body.as_buffer(), np.float32)
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "body": [out.astype(np.float32).tobytes()]})

    parts = bags.mapInArrow(run, "at int, body binary")
    return stored(parts.groupBy("at").applyInArrow(total, "at int, body binary"), "latent-products")


def fit_latent(rows: DataFrame, idf: np.ndarray, queries: list[Query], seed: int = 1) -> np.ndarray:
    """``fit_spaces`` on the documents of ``rows(text, space)``, which are those with space -1."""
    bags, _, passages = _passages(rows.filter("space = -1"))
    return fit_spaces(corpus_products(bags, idf, passages, seed), idf, queries, seed)


def fit_spaces(products: DataFrame, idf: np.ndarray, queries: list[Query], seed: int = 1) -> np.ndarray:
    """Gives every query the terms that its latent vector weighs, and the weights; returns kept lengths.

    A randomised range finder of the passages X of all documents and of a space's benchmark parts: an
    orthogonal basis of the products X'(X random) spans the space. The documents' ``corpus_products`` serve every space, a benchmark part
    counts ``EMPHASIS`` times and in its own. Of a part that keeps less than ``SHARE`` of its length the rest
    becomes an axis of its own. Cosines depend on the space alone, so the axes are not turned within it. A
    region's product with a query is the sum of the weights of its terms. The driver gets those only.
    """
    spark = products.sparkSession
    shared = spark.sparkContext.broadcast((idf, [(q.space, q.terms) for q in queries]))

    def learn(key, found):
        weight, asked = shared.value
        total = np.zeros((TERMS, RANK))
        for at, body in zip(found["at"].to_pylist(), found["body"], strict=True):
            total[at : at + RANGE] = np.frombuffer(body.as_buffer(), np.float32).reshape(-1, RANK)
        own = [i for i, (space, _) in enumerate(asked) if space == key[0].as_py()]
        of = np.repeat(np.arange(len(own)), [len(asked[i][1]) for i in own])
        row, words, x = _bags(np.concatenate([asked[i][1] for i in own]), of, weight)
        here = distinct(np.append(np.flatnonzero(total.any(1)), words))
        bags = np.zeros((len(own), len(here)))
        bags[row, np.searchsorted(here, words)] = x
        basis = np.linalg.qr(total[here] + EMPHASIS * (bags.T @ (bags @ _drawn(seed)[here])))[0]
        vectors = bags @ basis
        weak = np.linalg.norm(vectors, axis=1) < SHARE
        if weak.any():
            rest = bags[weak] - vectors[weak] @ basis.T
            basis = np.hstack([basis, np.linalg.qr(rest.T)[0]])
            vectors = bags @ basis
        latent = (vectors @ basis.T) * weight[here]
        keep = [np.flatnonzero(v >= FAINT * v.max()) for v in latent]
        return pa.table({
            "query": pa.array(own, pa.int32()), "kept": np.linalg.norm(vectors, axis=1),
            "terms": [here[k].astype("<i4").tobytes() for k in keep],
            "weights": [v[k].tobytes() for v, k in zip(latent, keep, strict=True)],
        })

    spaces = spark.range(1 + max(q.space for q in queries)).withColumnRenamed("id", "space")
    learnt = products.crossJoin(F.broadcast(spaces)).groupBy("space").applyInArrow(
        learn, "query int, kept double, terms binary, weights binary"
    )
    kept = np.zeros(len(queries))
    for query, length, terms, weights in learnt.collect():  # a few dozen terms a query
        queries[query].latent = np.frombuffer(bytes(terms), "<i4").astype(np.int64), np.frombuffer(bytes(weights))
        kept[query] = length
    shared.destroy()
    return kept


@dataclass
class Query:
    item: int
    name: object
    words: list[str]
    part: tuple[int, int]  # the words of the item that this query stands for
    answer: list[str] | None
    keys: set[str]
    terms: np.ndarray  # of those words
    space: int = 0
    latent: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0))  # terms and weights

    @property
    def blocks(self) -> int:
        """Blocks of a region that surely holds the words, wherever a block begins."""
        return max(3, -(-(self.part[1] - self.part[0]) // BLOCK) + 1)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one machine operation per word of ``b``."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = row & where.get(x, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def accepted(query: Query, region: list[str], latent: bool = False) -> tuple[bool, float, bool]:
    """Whether a region of a document holds the query's words; its share, and whether by paraphrase.
    What the latent space found may share fewer words."""
    a, b = query.part
    own = query.words[a:b]
    share = lcs(own, region) / max(1, len(own))
    if share >= COPY:
        return True, share, False
    if share < (LATENT if latent else PARAPHRASE):
        return False, share, False
    there = set(region)
    if query.answer:
        return all(w in there for w in query.answer), share, True
    return bool(query.keys) and len(query.keys & there) >= KEYS * len(query.keys), share, True


def _queries(items: list[tuple], idf: np.ndarray) -> list[Query]:
    out = []
    for i, (name, text, answer) in enumerate(items):
        words = _fold(text or "")
        if not words:
            continue
        n = -(-len(words) // LONGEST)
        cuts = [len(words) * j // n for j in range(n + 1)]
        [part] = _folded(pa.array([text], pa.string()), 1 << 40)
        terms = _terms(part)
        weight = idf[terms]
        rare = np.quantile(weight, 0.75) if len(weight) else 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            keys = {w for w, x in zip(words[a:b], weight[a:b], strict=False) if x >= rare}
            out.append(Query(i, name, words, (a, b), _fold(answer or "") or None, keys, terms[a:b]))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``cosine``, ``covered``, ``paraphrase`` and ``way`` of every document of
    ``docs(doc_id, text, ...)`` that holds a passage of ``benchmark(item_id, text[, answer], ...)``.

    Words are compared in lower case, by their letters and digits; what has neither is no word.
    ``covered`` is the share of the passage's words (of its best part, if it is longer than ``LONGEST``
    words) found in order; ``way`` tells whether the latent space, the shared words or both led to a
    place that was accepted. Documents and items that are null, empty or without words match nothing. A row
    with a null doc_id is reported with it; rows that repeat an id are one document, repeated items one
    item. Other columns are ignored. An empty table on either side gives no rows. Texts of any length are searched whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    kind = dict(benchmark.dtypes)["item_id"]
    kind = f"doc_id long, item_id {kind}, cosine double, covered double, paraphrase boolean, ways int"
    found = docs.sparkSession.createDataFrame([], kind)
    for shared in _passes(docs.select("text"), benchmark):
        found = found.unionByName(stored(docs.mapInArrow(_findings(shared), kind), "contaminated"))
        shared.destroy()
    way = F.element_at(F.array(F.lit("latent"), F.lit("words"), F.lit("both")), F.bit_or("ways"))
    return found.groupBy("doc_id", "item_id").agg(
        F.max("cosine").alias("cosine"), F.max("covered").alias("covered"),
        F.min("paraphrase").alias("paraphrase"), way.alias("way"),
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no passage of ``benchmark``, with all their columns.

    Each row is judged by its own text where it lies, whatever its id: nothing is shuffled or joined.
    """
    for shared in _passes(docs.select("text").filter("text IS NOT NULL"), benchmark):
        docs = docs.mapInArrow(_clean(shared, docs.columns.index("text")), docs.schema)
    return docs


def _passes(texts: DataFrame, benchmark: DataFrame):
    """Broadcasts of queries, bounded in number, one for each pass over the documents."""
    spark = texts.sparkSession
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None)
    items = benchmark.select("item_id", "text", answer.cast("string").alias("answer")).filter("text IS NOT NULL")
    items = stored(
        items.distinct().withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(_item_blocks(items)))), "items"
    )
    bags, seen, passages = _passages(texts)
    idf = np.log((1 + passages) / (1 + seen)) + 0.1
    products = corpus_products(bags, idf, passages)
    for r in items.select("block").distinct().collect():
        own = items.filter(F.col("block") == r["block"])
        table = own.orderBy("item_id", "text", "answer").select("item_id", "text", "answer").collect()
        queries = sorted(_queries([tuple(x) for x in table], idf), key=lambda q: q.blocks)
        for at in range(0, len(queries), SPACE_PARTS * SPACES):
            some = queries[at : at + SPACE_PARTS * SPACES]
            for i, query in enumerate(some):
                query.space = i // SPACE_PARTS
            fit_spaces(products, idf, some)
            yield spark.sparkContext.broadcast((some, idf, seen))


def _item_blocks(items: DataFrame) -> int:
    """Blocks of items so that each has about as many parts as are searched in one pass."""
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")) / LONGEST + 1)).first()[0] or 0
    return int(words // (SPACE_PARTS * SPACES)) + 1


class Postings:
    """In which queries of one size each term stands: how often, and with what latent weight.

    By words a query is found only if ``PARAPHRASE`` of its own occur in a region. Terms that make up at
    most half of that number do not count, the most frequent ones, and the number is lowered by them: a region that
    has enough words in common has at least the lowered number, so none is lost.
    """

    def __init__(self, queries: list[np.ndarray], seen: np.ndarray, latent: list | None = None):
        """Terms of each query; in how many passages each term occurs; terms and weights of the latent vectors."""
        self.need = np.zeros(len(queries), np.int64)
        parts = []
        for q, own in enumerate(queries):
            t, n = np.unique(own, return_counts=True)
            order = np.lexsort((t, -seen[t]))
            t, n = t[order], n[order]
            need = int(np.ceil(PARAPHRASE * len(own)))
            left_out = int(np.searchsorted(np.cumsum(n), need // 2, "right"))
            self.need[q] = need - n[:left_out].sum()
            near, by = latent[q] if latent else (t[:0], n[:0])
            term = np.union1d(t[left_out:], near)
            times, weight = np.zeros(len(term)), np.zeros(len(term))
            times[np.searchsorted(term, t[left_out:])] = n[left_out:]
            weight[np.searchsorted(term, near)] = by
            parts.append((term, np.full(len(term), q), times, weight))
        term, query, times, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(term, kind="stable")
        self.query, self.step = query[order], times[order] + 1j * weight[order]
        self.size = np.bincount(term, minlength=TERMS)
        self.first = sums(self.size)

    def candidates(self, terms, bounds, first, count, blocks: int):
        """Block and query of the ``regions`` that share enough words, for texts as ``_blocks`` cuts them."""
        square = np.arange(len(first) + 1)
        block, query, _, way = self.regions(*_places(terms, first), *_texts(count), square, blocks)
        return block[way >= 2], query[way >= 2]

    def regions(self, term, block, start, stop, square, blocks: int):
        """Block, query, cosine and way (1 latent, 2 words) of the regions, from one block before a block
        to ``blocks`` after it and within its text, that are near a query or share enough of its words.

        ``term`` and ``block``: where each term occurs, in order; ``start`` and ``stop``: the first and last
        block of each block's text; ``square``: sums of squared weights of the words before each block.
        """
        held = self.size[term] > 0
        term, block = term[held], block[held]
        if not len(term):
            return [np.zeros(0, np.int64)] * 4
        # A term counts for a region at the first block that has it there: regions that begin at or
        # before the block it occurred in last are left to that one.
        lo = np.maximum(start[block], block - blocks)
        same = (term[1:] == term[:-1]) & (block[:-1] >= start[block[1:]])
        lo[1:] = np.where(same, np.maximum(lo[1:], block[:-1] + 2), lo[1:])
        hi = np.minimum(block + 2, stop[block])
        keep = lo < hi
        term, lo, hi = term[keep], lo[keep], hi[keep]
        size = self.size[term]
        where = ragged(self.first[term], size)
        base = self.query[where] * (len(start) + 1)
        key = np.concatenate([base + np.repeat(lo, size), base + np.repeat(hi, size)])
        # Sorting keys with their places in the low bits takes a fraction of the time of np.argsort.
        low = len(key).bit_length()
        key = np.sort(key << low | np.arange(len(key)))
        order = key & ((1 << low) - 1)
        key >>= low
        step = self.step[where]
        total = np.cumsum(np.concatenate([step, -step])[order])
        shared, product = total.real, total.imag
        last = np.flatnonzero(key[1:] > key[:-1])
        query, at = np.divmod(key[last], len(start) + 1)
        block = np.arange(len(start))
        norm = np.sqrt(square[np.minimum(block + blocks + 1, stop)] - square[np.maximum(block - 1, start)])
        norm = np.append(norm, [np.inf, np.inf])
        # Until the next change regions share the product; the shortest of them has the largest cosine.
        end = np.minimum(at + key[last + 1] - key[last], len(start))
        least = np.minimum.reduceat(norm, np.stack([at, np.maximum(end, at + 1)], 1).ravel())[::2]
        good = last[(shared[last] >= self.need[query] - 0.5) | (product[last] >= COSINE * least)]
        count = key[good + 1] - key[good]
        query, at = np.divmod(np.repeat(key[good], count), len(start) + 1)
        at += ragged(np.zeros_like(count), count)
        near = np.repeat(product[good], count) / (norm[at] + 1e-6)
        way = (near >= COSINE) + 2 * (np.repeat(shared[good], count) >= self.need[query] - 0.5)
        some = way > 0
        return at[some], query[some], near[some], way[some]


class Matcher:
    """Finds and judges the regions of slices of folded texts."""

    def __init__(self, queries: list[Query], idf: np.ndarray, seen: np.ndarray):
        self.queries, self.square = queries, idf**2
        by_size: dict[int, list[int]] = {}
        for i, query in enumerate(queries):
            by_size.setdefault(query.blocks, []).append(i)
        self.sizes = {
            b: (np.array(own), Postings([queries[i].terms for i in own], seen, [queries[i].latent for i in own]))
            for b, own in by_size.items()
        }
        self.known = sum(p.size for _, p in self.sizes.values()) > 0
        self.length = np.array([len(q.terms) for q in queries])
        # For each query and term a bit for every place of the term in the query.
        key = np.repeat(np.arange(len(queries)), self.length) * TERMS + np.concatenate([q.terms for q in queries])
        bit = U(1) << np.concatenate([np.arange(n, dtype=U) for n in self.length])
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.diff(key[order], prepend=-1))
        self.key, self.mask = key[order][at], np.bitwise_or.reduceat(bit[order], at)

    def bounds(self, terms, lo, hi, query) -> np.ndarray:
        """At least the longest common subsequence of each region and query: that of their hashed words."""
        out = np.zeros(len(lo), np.int64)
        for a in range(0, len(lo), 8192):
            size = (hi - lo)[a : a + 8192]
            asked = query[a : a + 8192]
            key = np.repeat(asked, size) * TERMS + terms[ragged(lo[a : a + 8192], size)]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            masks = np.zeros((int(size.max()), len(size)), U)
            masks[ragged(np.zeros_like(size), size), np.repeat(np.arange(len(size)), size)] = np.where(
                self.key[at] == key, self.mask[at], U(0)
            )
            full = (U(1) << self.length[asked].astype(U)) - U(1)
            row = full.copy()
            for m in masks:
                m = row & m
                row = ((row + m) | (row - m)) & full
            out[a : a + 8192] = self.length[asked] - np.bitwise_count(row)
        return out

    def match(self, part) -> dict[tuple[int, int], tuple]:
        """By (text, item): name, cosine, share, whether a paraphrase, and the ways (1 latent, 2 words)."""
        terms, hits = _terms(part), {}
        if not len(terms):
            return hits
        first, count = _blocks(part.bounds, BLOCK)
        text = np.repeat(np.arange(len(part)), count)
        start, stop = _texts(count)
        square = np.append(0, np.cumsum(np.add.reduceat(self.square[terms], first)))
        term, place = _places(terms, first, self.known)
        for blocks, (own, postings) in self.sizes.items():
            block, query, near, way = postings.regions(term, place, start, stop, square, blocks)
            if not len(block):
                continue
            query = own[query]
            lo = np.maximum(part.bounds[text[block]], first[block] - BLOCK)
            hi = np.minimum(part.bounds[text[block] + 1], first[block] + (blocks + 1) * BLOCK)
            least = np.where(way & 1, LATENT, PARAPHRASE) * self.length[query]
            good = self.bounds(terms, lo, hi, query) >= least - 1e-9
            for b, q, c, w, x, y in zip(*(v[good].tolist() for v in (block, query, near, way, lo, hi)), strict=True):
                asked, t = self.queries[q], int(text[b])
                old = hits.get((t, asked.item))
                if old is not None and old[2] == 1 and old[4] | w == old[4]:
                    continue
                body = part.data[part.starts[x] : part.ends[y - 1]].tobytes().decode()
                yes, share, other = accepted(asked, body.split(), bool(w & 1))
                if yes:
                    best = old if old is not None and (share, c) <= (old[2], old[1]) else (asked.name, c, share, other)
                    hits[t, asked.item] = (*best[:4], w | (old[4] if old else 0))
        return hits


def _findings(shared):
    names = ["doc_id", "item_id", "cosine", "covered", "paraphrase", "ways"]

    def run(batches):
        matcher = Matcher(*shared.value)
        for batch in batches:
            for part in _folded(batch.column(1), 1 << 18):
                hits = matcher.match(part)
                if hits:
                    rows = batch.column(0).slice(part.first, len(part)).take(pa.array([t for t, _ in hits], pa.int64()))
                    name, near, share, other, way = (list(x) for x in zip(*hits.values(), strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows, pa.array(name), pa.array(near, pa.float64()), pa.array(share, pa.float64()),
                            pa.array(other, pa.bool_()), pa.array(way, pa.int32()),
                        ],
                        names,
                    )

    return run


def _clean(shared, text: int):
    def run(batches):
        matcher = Matcher(*shared.value)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for part in _folded(batch.column(text), 1 << 18):
                keep[[part.first + t for t, _ in matcher.match(part)]] = False
            yield batch.filter(pa.array(keep))
        give_back()

    return run
