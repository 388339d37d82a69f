"""Ranked lexical search over two trees: one of items, one of documents.

A document is a vector over the terms of the items: term weight times damped frequency, all integers. Items
are put in an order in which neighbours share terms, documents of a batch by the part of that order that they
resemble, and by their total. Over both stand trees in which eight nodes have a parent. A document node holds the maximum of
each coordinate below it, an item node the union of its items' terms. The sum of a document node's maxima over
an item node's terms bounds every score below the pair. Where it is less than the weakest kth score of
the items below, the whole pair is left out; otherwise both nodes are opened. At the leaves scores are exact.
Every task keeps the best k documents of each item, and the best k of all tasks are the result.

One pass over the texts counts terms and writes the vectors, from which document frequencies and then the
ranking are read. Items go through in slices of bounded size, which are all that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored
from .words import LOWER, prefix_hash, slices, span_hash, sums

FANOUT = 8
LEVELS = 3
BANDS = 32
SLICE_ITEMS = 4096
SLICE_TERMS = 1 << 18
CELLS = 1 << 22
BLOCK_DOCS = FANOUT**LEVELS
TERM = np.array([chr(b).isalnum() or b >= 0x80 for b in range(256)])
PAIR = np.dtype([("term", "<u4"), ("tf", "<u4")])


def term_hashes(part) -> np.ndarray:
    """A hash of each term of a slice of texts; ``part.bounds`` tells whose it is."""
    part.find_words(TERM)
    return span_hash(prefix_hash(LOWER[part.data]), part.starts, part.ends)


def _item_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch.column("text")):
            hashes, b = term_hashes(part), part.bounds
            terms = [np.unique(hashes[b[i] : b[i + 1]]).tobytes() for i in range(len(part))]
            ids = batch.column("item_id").slice(part.first, len(part))
            yield pa.record_batch([ids, pa.array(terms, pa.binary())], ["item_id", "terms"])


def _item_slices(items: DataFrame) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and term hashes of the items, so many at a time that their terms stay bounded."""
    kind = items.schema["item_id"].dataType.simpleString()
    found = stored(items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {kind}, terms binary"), "items")
    ids, terms, size = [], [], 0
    for item_id, body in found.filter(F.length("terms") > 0).toLocalIterator():
        own = np.frombuffer(bytes(body), np.uint64)
        if ids and (len(ids) == SLICE_ITEMS or size + len(own) > SLICE_TERMS):
            yield ids, terms
            ids, terms, size = [], [], 0
        ids.append(item_id)
        terms.append(own)
        size += len(own)
    if ids:
        yield ids, terms


def _vectors(vocabulary):
    """(doc_id, n, vector): the number of a text's terms, and those of the vocabulary with their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for part in slices(batch.column("text")):
                hashes = term_hashes(part)
                n = np.diff(part.bounds)
                owner = np.repeat(np.arange(len(part)), n)
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                cell, tf = np.unique(owner[hit] * len(known) + at[hit], return_counts=True)
                pairs = np.empty(len(cell), PAIR)
                pairs["term"], pairs["tf"] = cell % len(known), tf
                ends = sums(np.bincount(cell // len(known), minlength=len(part))) * PAIR.itemsize
                body = pa.Array.from_buffers(
                    pa.large_binary(), len(part), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(pairs)]
                )
                ids = batch.column("doc_id").slice(part.first, len(part))
                yield pa.record_batch([ids, pa.array(n), body.cast(pa.binary())], ["doc_id", "n", "vector"])

    return run


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All (term, tf) pairs of some vectors, and where each vector begins."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if offsets[-1] == offsets[0]:
        return np.empty(0, PAIR), np.zeros(len(column) + 1, np.int64)
    body = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return body.view(PAIR), (offsets - offsets[0]).astype(np.int64) // PAIR.itemsize


def _frequencies(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size, np.int64)
        for batch in batches:
            count += np.bincount(_pairs(batch.column("vector"))[0]["term"], minlength=size)
        some = np.flatnonzero(count)
        yield pa.record_batch([some, count[some]], ["term", "df"])

    return run


def tree_order(terms: list[np.ndarray], weights: np.ndarray) -> list[int]:
    """Items in an order in which neighbours share terms: each group parts into those nearer to its first
    item and those nearer to the one least like it, until it fits a node or all are alike."""
    order, stack = [], [np.arange(len(terms))]
    while stack:
        group = stack.pop()

        def like(i: int, group=group) -> np.ndarray:
            mark = np.zeros(len(weights))
            mark[terms[i]] = weights[terms[i]] + 1
            return np.array([mark[terms[j]].sum() / max(len(terms[j]), 1) for j in group])

        near = np.ones(len(group), bool)
        if len(group) > FANOUT:
            one = like(group[0])
            near = one > like(group[int(one.argmin())])
        if near.all() or not near.any():
            order += group.tolist()
        else:
            stack += [group[~near], group[near]]
    return order


@dataclass
class Node:
    """Items ``first`` to ``last`` of the order; the union of their terms; the nodes below."""

    first: int
    last: int
    terms: np.ndarray
    below: list


def item_trees(terms: list[np.ndarray]) -> list[Node]:
    """Trees of at most ``BLOCK_DOCS`` items, in the given order."""
    nodes = [Node(i, i + 1, t, []) for i, t in enumerate(terms)]
    for _ in range(LEVELS):
        runs = [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)]
        nodes = [Node(r[0].first, r[-1].last, np.unique(np.concatenate([x.terms for x in r])), r) for r in runs]
    return nodes


class Search:
    """The best ``k`` documents of every item among those added."""

    def __init__(self, trees: list[Node], n_items: int, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.trees, self.k, self.weights = trees, k, weights
        self.n_docs, self.n_terms = n_docs, n_terms
        self.score = np.zeros((n_items, k), np.int64)
        self.doc = np.zeros((n_items, k), np.int64)
        self.no_id = np.zeros((n_items, k), bool)
        self.kth = np.zeros(n_items, np.int64)
        self.scored = 0
        # Where in the order of the items a term stands: the mean of its leaves.
        place, count = np.zeros(len(weights)), np.zeros(len(weights))
        stack = list(trees)
        while stack:
            node = stack.pop()
            stack += node.below
            if not node.below:
                place[node.terms] += node.first
                count[node.terms] += 1
        self.place = place / np.maximum(count, 1)

    def add(self, ids: np.ndarray, no_id: np.ndarray, n: np.ndarray, pairs: np.ndarray, bounds: np.ndarray) -> None:
        """Documents by id, number of terms and (term, tf) pairs from ``bounds``."""
        held = np.diff(bounds)
        m = 10 + (90 * self.n_docs * n.astype(np.int64)) // max(self.n_terms, 1)
        tf, term = pairs["tf"].astype(np.int64), pairs["term"].astype(np.int64)
        value = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, held)))
        owner = np.repeat(np.arange(len(ids)), held)
        total = np.bincount(owner, value, len(ids))
        middle = np.bincount(owner, value * self.place[term], len(ids)) / np.maximum(total, 1)
        rows = np.lexsort((total, middle * BANDS // len(self.kth)))
        rows = rows[total[rows] > 0]
        while len(rows):
            take = rows[:BLOCK_DOCS]
            while True:
                which = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in take])
                active = np.unique(term[which])
                if len(take) == 1 or len(take) * len(active) <= CELLS:
                    break
                take = take[: len(take) // 2]
            self._block(ids[take], no_id[take], np.repeat(np.arange(len(take)), held[take]), term[which], value[which], active)
            rows = rows[len(take) :]

    def _block(self, ids, no_id, row, term, value, active) -> None:
        self.column = np.full(len(self.weights), -1, np.int64)
        self.column[active] = np.arange(len(active))
        base = np.zeros((len(ids), len(active)), np.int64)
        base[row, self.column[term]] = value
        self.maxima = [base]
        for _ in range(LEVELS):
            below = self.maxima[-1]
            spare = -len(below) % FANOUT
            below = np.pad(below, ((0, spare), (0, 0))) if spare else below
            self.maxima.append(below.reshape(-1, FANOUT, len(active)).max(1))
        self.ids, self.no_id_of = ids, no_id
        for tree in self.trees:
            self._visit(tree, LEVELS, np.arange(len(self.maxima[LEVELS])))

    def _open(self, level: int, rows: np.ndarray) -> np.ndarray:
        """The document nodes below."""
        rows = (rows[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        return rows[rows < len(self.maxima[level - 1])]

    def _visit(self, node: Node, level: int, rows: np.ndarray) -> None:
        """An item node and document nodes of a level; a single item meets nodes of documents, then these."""
        columns = self.column[node.terms]
        columns = columns[columns >= 0]
        if not len(columns):
            return
        bound = self.maxima[level][np.ix_(rows, columns)].sum(1)
        rows = rows[bound >= max(1, self.kth[node.first : node.last].min())]
        if not len(rows):
            return
        if node.below:
            rows = self._open(level, rows) if level > 1 else rows
            for below in node.below:
                self._visit(below, max(level - 1, 1), rows)
        else:
            rows = self._open(level, rows)
            self.scored += len(rows)
            self._keep(node.first, rows, self.maxima[0][np.ix_(rows, columns)].sum(1))

    def _keep(self, item: int, rows: np.ndarray, score: np.ndarray) -> None:
        good = score >= max(1, self.kth[item])
        if not good.any():
            return
        score = np.concatenate([self.score[item], score[good]])
        doc = np.concatenate([self.doc[item], self.ids[rows[good]]])
        none = np.concatenate([self.no_id[item], self.no_id_of[rows[good]]])
        best = np.lexsort((doc, none, -score))[: self.k]
        self.score[item], self.doc[item], self.no_id[item] = score[best], doc[best], none[best]
        self.kth[item] = self.score[item, -1]

    def found(self) -> pa.RecordBatch:
        item, place = np.nonzero(self.score)
        doc = pa.array(self.doc[item, place], mask=self.no_id[item, place])
        return pa.record_batch([pa.array(item), doc, pa.array(self.score[item, place])], ["item", "doc_id", "score"])


def _searched(shared, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, n_items, weights = shared.value
        search = Search(trees, n_items, weights, n_docs, n_terms, k)
        for batch in batches:
            ids = batch.column("doc_id")
            known = ids.fill_null(0).cast(pa.int64()).to_numpy()
            pairs, bounds = _pairs(batch.column("vector"))
            search.add(known, ids.is_null().to_numpy(zero_copy_only=False), batch.column("n").to_numpy(), pairs, bounds)
        yield search.found()

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id``, ``rank`` (from 1), ``doc_id`` and ``score``.

    Takes ``doc_id`` (an integer) and ``text``, ``item_id`` and ``text``, and no other column. Only scores
    above 0 are ranked. Equal scores are ranked by ascending id, rows without an id last; rows that repeat a
    document are ranked one by one, and rows that repeat an item are items of their own. A null or empty text
    has no terms: such an item has no rows, such a document is not counted. Terms are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    kind = items.schema["item_id"].dataType.simpleString()
    results = []
    for ids, hashes in _item_slices(items):
        known = np.unique(np.concatenate(hashes))
        shared = context.broadcast(known)
        vectors = docs.select("doc_id", "text").mapInArrow(_vectors(shared), "doc_id long, n long, vector binary")
        vectors = stored(vectors, "term-vectors")
        shared.destroy()
        n_docs, n_terms = vectors.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        counts = vectors.select("vector").mapInArrow(_frequencies(len(known)), "term long, df long")
        counts = counts.groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df = np.zeros(len(known), np.int64)
        df[counts["term"].to_numpy()] = counts["df"].to_numpy()
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        terms = [np.searchsorted(known, h) for h in hashes]
        order = tree_order(terms, weights.astype(float))
        trees = item_trees([terms[i] for i in order])
        shared = context.broadcast((trees, len(ids), weights))
        found = vectors.mapInArrow(_searched(shared, n_docs, n_terms, k), "item long, doc_id long, score long")
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(j, ids[i]) for j, i in enumerate(order)], f"item long, item_id {kind}")
        results.append(stored(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
        shared.destroy()
    if not results:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
