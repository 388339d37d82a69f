"""H: evaluation of a fixed nearest-centroid model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shardloom.functions import vectors as V
from shardloom.operators import evaluation as H
from shardloom.operators.models import ModelSpec

from .views import centroids, digest, samples, sql_digest, table, with_views


def scored(spark, d):
    means, biases = centroids(spark, d)
    spec = ModelSpec(n_features=means.shape[1], n_classes=means.shape[0])
    return H.score(samples(spark, d), spec, np.concatenate([means.ravel(), biases]))


def h1(spark, d):
    return scored(spark, d).select("sample_id", "label", "prediction", *digest("scores"))


def h1_linear(spark, d):
    rows = H.score_linear(samples(spark, d), *centroids(spark, d))
    return rows.select("sample_id", "label", "prediction", *digest("scores"))


def h2(spark, d):
    return H.accuracy(scored(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


def _loss(df):
    return df.select(F.round("loss", 6).alias("loss"))


def h3(spark, d):
    return _loss(H.cross_entropy(scored(spark, d)))


def h4(spark, d):
    return _loss(H.cross_entropy(scored(spark, d), mode="batch_mean", batch=32))


def h4_cells(spark, d):
    return _loss(H.cross_entropy(scored(spark, d), mode="batch_mean", batch=32, rows_per_cell=64))


def h5(spark, d):
    rows = scored(spark, d).withColumn("log_probabilities", V.log_softmax("scores"))
    return _loss(H.nll(rows))


def h6(spark, d):
    return H.confusion(scored(spark, d))


def _labels(spark, d):
    """Quality as the label, and the absence of toxicity as its prediction."""
    return table(spark, d, "labels").select(
        F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction")
    )


def h6_labels(spark, d):
    return H.confusion(_labels(spark, d))


def _rounded(df):
    cols = ("precision", "recall", "f1", "accuracy")
    return df.withColumns({c: F.round(c, 6) for c in cols if c in df.columns})


def h7(spark, d):
    return _rounded(H.classification_metrics(scored(spark, d)))


def h7_labels(spark, d):
    return _rounded(H.classification_metrics(_labels(spark, d)))


def h7_per_label(spark, d):
    return _rounded(H.metrics_per_label(scored(spark, d)))


QUERIES = {
    "h1_score": h1,
    "h1_score_linear": h1_linear,
    "h2_accuracy": h2,
    "h3_cross_entropy": h3,
    "h4_cross_entropy_batch_mean": h4,
    "h4_cross_entropy_batch_mean_cells": h4_cells,
    "h5_nll": h5,
    "h6_confusion": h6,
    "h6_confusion_labels": h6_labels,
    "h7_classification_metrics": h7,
    "h7_classification_metrics_labels": h7_labels,
    "h7_metrics_per_label": h7_per_label,
}

_PRED = with_views(
    f"SELECT sample_id, label, prediction, {sql_digest('scores')} FROM predicted", "predicted"
)
_LOSS = "SELECT *, log_z - scores[label + 1] AS l FROM predicted"
_LABELS = "SELECT quality AS label, 1 - toxic AS prediction FROM labels"


def _report(query: str, source: str, *views: str, **extra: str) -> str:
    return with_views(
        query,
        *views, **extra,
        classes=f"SELECT label AS c FROM {source} UNION SELECT prediction FROM {source}",
        counts=f"""SELECT c AS label, (SELECT count(*) FROM {source} WHERE label = c) AS support,
        (SELECT count(*) FROM {source} WHERE prediction = c) AS predicted,
        (SELECT count(*) FROM {source} WHERE prediction = c AND label = c) AS tp FROM classes""",
        rates="""SELECT *, CASE WHEN predicted > 0 THEN tp / CAST(predicted AS DOUBLE) ELSE 0 END AS precision,
        CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS recall FROM counts""",
        by_label="""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall
        / (precision + recall) ELSE 0 END AS f1 FROM rates""",
    )


_WEIGHTED = """SELECT CAST(sum(support) AS BIGINT) AS support, round(sum(tp) / sum(support), 6) AS accuracy,
    round(sum(precision * support) / sum(support), 6) AS precision,
    round(sum(recall * support) / sum(support), 6) AS recall,
    round(sum(f1 * support) / sum(support), 6) AS f1 FROM by_label"""
_PER_LABEL = """SELECT label, support, tp, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(f1, 6) AS f1 FROM by_label"""


ORACLE = {
    "h1_score": _PRED,
    "h1_score_linear": _PRED,
    "h2_accuracy": with_views(
        """SELECT round(100.0 * avg(CAST(label = prediction AS INTEGER)), 6) AS accuracy,
        count(*) AS n_samples FROM predicted""",
        "predicted",
    ),
    "h3_cross_entropy": with_views("SELECT round(avg(l), 6) AS loss FROM losses", "predicted", losses=_LOSS),
    "h4_cross_entropy_batch_mean": with_views(
        """SELECT round(avg(m), 6) AS loss FROM (SELECT (i // 32) AS b, avg(l) AS m FROM (
        SELECT l, row_number() OVER (ORDER BY sample_id) - 1 AS i FROM losses) GROUP BY 1)""",
        "predicted", losses=_LOSS,
    ),
    "h5_nll": with_views("SELECT round(avg(l), 6) AS loss FROM losses", "predicted", losses=_LOSS),
    "h6_confusion": with_views(
        "SELECT label, prediction, count(*) AS n FROM predicted GROUP BY 1, 2", "predicted"
    ),
    "h6_confusion_labels": with_views(
        "SELECT label, prediction, count(*) AS n FROM pairs GROUP BY 1, 2", pairs=_LABELS
    ),
    "h7_classification_metrics": _report(_WEIGHTED, "predicted", "predicted"),
    "h7_classification_metrics_labels": _report(_WEIGHTED, "pairs", pairs=_LABELS),
    "h7_metrics_per_label": _report(_PER_LABEL, "predicted", "predicted"),
}
ORACLE["h4_cross_entropy_batch_mean_cells"] = ORACLE["h4_cross_entropy_batch_mean"]
