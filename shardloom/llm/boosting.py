"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level on binned features: a histogram of gradients and curvatures per node and
feature gives the best cut. A finished tree is three arrays (feature, threshold, value) in heap order,
so a batch of documents walks down all of them by numpy indexing, one step per level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import FEATURES, fold, known_labels, sampled_labels, text_stats, with_features

SAMPLE = 10_000  # labelled rows of each class that a model is fitted on


@dataclass
class Trees:
    """``feature`` and ``threshold``: trees x inner nodes; ``value``: trees x leaves. A row goes right
    where its feature exceeds the threshold; a threshold of infinity sends all rows left."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        depth = (self.value.shape[1] - 1).bit_length()
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (len(value) - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15,
    bins: int = 48, least: float = 4.0, shrink: float = 1.0, weight: np.ndarray | None = None,
) -> Trees:
    """Logistic loss; rows count ``weight`` times, once if it is not given. With one class, or no rows, the trees are empty and the score is constant:
    the smoothed share of ones."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    weight = np.ones(len(y)) if weight is None else weight
    share = ((y * weight).sum() + 0.5) / (weight.sum() + 1)
    base = float(np.log(share / (1 - share)))
    out = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    if len(np.unique(y)) < 2:
        return out
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)])
    features, thresholds, values = [], [], []
    margin = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        cut = np.full(inner, bins)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            lo, n = (1 << level) - 1, 1 << level
            best = np.full(n, 1e-9)
            local = node - lo
            for f, b in enumerate(binned):
                key = local * bins + b
                hist = [np.bincount(key, w, n * bins).reshape(n, bins).cumsum(1) for w in (g, h)]
                (gl, hl), (gt, ht) = hist, (hist[0][:, -1:], hist[1][:, -1:])
                gain = (
                    gl**2 / (hl + shrink) + (gt - gl) ** 2 / (ht - hl + shrink) - gt**2 / (ht + shrink)
                )
                gain[(hl < least) | (ht - hl < least)] = 0
                gain[:, len(edges[f]) :] = 0
                at = gain.argmax(1)
                top = gain[np.arange(n), at]
                for i in np.flatnonzero(top > best):
                    best[i], feature[lo + i], cut[lo + i] = top[i], f, at[i]
                    threshold[lo + i] = edges[f][at[i]]
            node = 2 * node + 1 + (binned[feature[node], np.arange(len(y))] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + shrink)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.stack(features), np.stack(thresholds), np.stack(values), base)


def labelled_features(docs: DataFrame, labels: DataFrame, column: str, modulus: int, value: int, per_class: int):
    """Features, labels and weights of the bounded sample, as arrays in the driver.

    The weights give the classes of the sample the ratio that they have among all labels outside the fold,
    whatever the bound; they are 1 where it leaves out nothing, and 1 on average over the labels sampled.
    """
    known = known_labels(labels, column, modulus, value).groupBy("label").count().collect()
    there = np.zeros(2)
    for r in known:  # a row per class
        there[r["label"]] = r["count"]
    taken = np.minimum(there, per_class)
    weight = there / np.maximum(taken, 1) * taken.sum() / max(1, there.sum())
    sample = sampled_labels(labels, column, modulus, value, per_class)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")  # 2 x per_class rows
    table = with_features(text_stats(texts)).join(F.broadcast(sample), "doc_id").select("label", *FEATURES)
    table = table.toArrow()
    x = np.stack([table[f].to_numpy() for f in FEATURES], axis=1).astype(float)
    y = table["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows came in
    return x[order], y[order], weight[y[order].astype(int)]


def quality_scores(
    docs: DataFrame, labels: DataFrame, column: str = "quality", threshold: float = 0.5,
    modulus: int = 3, value: int = 1, per_class: int = SAMPLE, trees: int = 60,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs(doc_id, text, ...)``.

    The model is fitted on at most ``per_class`` rows of each class of ``labels`` outside the fold
    ``crc32(doc_id) mod modulus = value``, weighted to the ratio that the classes have in the table. Only the text decides a score. A null or empty text has all
    statistics 0 and is scored like any other; a row with a null id is scored, not learned from, and not
    held out; repeated rows are all scored. Without labels of both classes the score is constant. Other
    columns of either table are ignored. An empty table gives no rows.
    """
    x, y, weight = labelled_features(docs, labels, column, modulus, value, per_class)
    model = docs.sparkSession.sparkContext.broadcast(fit(x, y, trees, weight=weight))
    stats = with_features(text_stats(docs)).select("doc_id", *FEATURES)

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy() for f in FEATURES], axis=1)
            score = pa.array(model.value.score(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), score], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", fold(modulus, value), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
