"""Quality rules: a learned decision list.

Method: sequential covering. On one part of the labelled statistics a rule is grown, condition by
condition, to the conjunction of thresholds with the largest information gain for the rejected class;
on the other part conditions are dropped from its end while that makes it more precise. The rows it
covers are set aside and the next rule is grown, until a rule no longer pays. The result is an ordered
list of readable conditions, which Spark evaluates as one ``CASE`` expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import SAMPLE, labelled_features
from .stats import BASE, FEATURES, fold, text_stats, with_features

# Condition: index of the feature, whether above or not above, threshold.
Condition = tuple[int, bool, float]


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.conditions:
            out &= (x[:, f] > t) == above
        return out

    def text(self, names: list[str]) -> str:
        return " AND ".join(
            f"{names[f]} {'>' if above else '<='} {float(t)!r}D" for f, above, t in self.conditions
        )


def _grow(x, bad, weight, cuts, most: int) -> list[Condition]:
    """Adds the condition with the largest FOIL gain until no good row is covered."""
    rule: list[Condition] = []
    here = np.ones(len(x), bool)
    while len(rule) < most:
        p, n = weight[here & bad].sum(), weight[here & ~bad].sum()
        if not p or not n:
            break
        now = np.log2(p / (p + n))
        best, found = 1e-9, None
        for f, edges in enumerate(cuts):
            at = np.searchsorted(edges, x[here, f])  # x <= edges[i] for i >= at
            size = len(edges) + 1
            low_p = np.cumsum(np.bincount(at[bad[here]], weight[here & bad], size))[:-1]
            low_n = np.cumsum(np.bincount(at[~bad[here]], weight[here & ~bad], size))[:-1]
            high_p, high_n = np.maximum(p - low_p, 0), np.maximum(n - low_n, 0)
            for above, pp, nn in ((False, low_p, low_n), (True, high_p, high_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 1e-6, pp * (np.log2(pp / (pp + nn)) - now), 0)
                if len(gain) and gain.max() > best:
                    best, found = gain.max(), (f, above, float(edges[gain.argmax()]))
        if found is None:
            break
        rule.append(found)
        here &= (x[:, found[0]] > found[2]) == found[1]
    return rule


def learn(
    x: np.ndarray, y: np.ndarray, rules: int = 12, conditions: int = 4, precision: float = 0.8,
    least: int = 4, bins: int = 64, seed: int = 5, weight: np.ndarray | None = None,
) -> list[Rule]:
    """Rules that reject rows labelled 0. A rule is kept if it is right on at least ``precision`` of
    what it covers outside the rows it was grown on, where rows count ``weight`` times (once if it is not
    given), and covers ``least`` bad rows there."""
    weight = np.ones(len(y)) if weight is None else weight
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    bad = y == 0
    part = np.random.default_rng(seed).random(len(y)) < 2 / 3
    out: list[Rule] = []
    left = np.ones(len(y), bool)
    while len(out) < rules and (left & bad & part).any():
        grown = _grow(x[left & part], bad[left & part], weight[left & part], cuts, conditions)
        xs, bs, ws = x[left & ~part], bad[left & ~part], weight[left & ~part]

        def worth(k, grown=grown, xs=xs, bs=bs, ws=ws):
            c = Rule(tuple(grown[:k]), 0).covers(xs)
            return (ws[c & bs].sum() + 1) / (ws[c].sum() + 2), (c & bs).sum()

        if not grown:
            break
        k = max(range(1, len(grown) + 1), key=lambda k: (worth(k)[0], -k))
        value, hits = worth(k)
        if value < precision or hits < least:
            break
        rule = Rule(tuple(grown[:k]), float(value))
        out.append(rule)
        left &= ~rule.covers(x)
    return out


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """Whether a row is kept, and the number of the rule that rejects it (null if none does)."""
    names = list(FEATURES)
    which = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        which = F.when(F.expr(rule.text(names)), F.lit(i)).otherwise(which)
    return which.isNull(), which


def apply_rules(docs: DataFrame, rules: list[Rule], least_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    keep, which = verdict(rules)
    rows = with_features(text_stats(docs))
    failed = (F.col("n_words") < least_words) | (
        100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")
    )
    return rows.select(
        "doc_id", *BASE, failed.alias("base_failed"), (~failed & keep).alias("kept"),
        fold(3, 1), which.alias("rule"),
    )


def quality_rules(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept``, ``held_out`` and ``rule`` of every row.

    Rules are learned from at most ``per_class`` labelled rows of each class whose
    ``crc32(doc_id) mod 3`` is not 1, weighted to the ratio of the classes in the table, and look at statistics of the text alone. A null or empty text has no words: all
    counts 0, ``base_failed``. Without labels of both classes no rule is learned and the base decides. A
    row with a null id is judged, never learned from; repeated rows are all judged. Other columns are
    ignored. An empty table gives no rows.
    """
    x, y, weight = labelled_features(docs, labels, "quality", 3, 1, per_class)
    return apply_rules(docs, learn(x, y, weight=weight))
