"""Scoring and classification metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .models import ModelSpec, forward, hits_and_losses, matrix, unpack
from .positions import ROWS_PER_CELL, with_position


def score(samples: DataFrame, spec: ModelSpec, weights) -> DataFrame:
    """Predictions table: scores, predicted class and the true label.

    The model, of fixed size ``spec.size``, goes to the executors once as a
    broadcast; rows pass in Arrow batches through one matrix product each.
    Nothing is shuffled.
    """
    vector = np.asarray(weights, dtype=np.float64)
    if vector.size != spec.size:
        raise ValueError(f"model has {vector.size} values, {spec.size} expected")
    shared = samples.sparkSession.sparkContext.broadcast(vector)

    @F.arrow_udf("array<double>")
    def class_scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        params = unpack(spec, shared.value)
        for features in batches:
            scores = forward(spec, params, matrix(features, spec.n_features))
            ends = np.arange(len(scores) + 1, dtype=np.int32) * spec.n_classes
            yield pa.ListArray.from_arrays(ends, scores.ravel())

    keep = [c for c in samples.columns if c != "features"]
    scored = samples.select(*keep, class_scores("features").alias("scores"))
    return scored.withColumn("prediction", V.predict("scores"))


def score_linear(samples: DataFrame, coefficients, biases) -> DataFrame:
    """The linear model as a plain JVM expression, for few features and classes."""
    models = F.array(
        *[
            F.struct(
                F.array(*[F.lit(float(v)) for v in row]).alias("w"), F.lit(float(b)).alias("b")
            )
            for row, b in zip(coefficients, biases)
        ]
    )

    def one(m):
        products = F.zip_with(F.col("features"), m.getField("w"), lambda x, w: x * w)
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v) + m.getField("b")

    keep = [c for c in samples.columns if c != "features"]
    scored = samples.select(*keep, F.transform(models, one).alias("scores"))
    return scored.withColumn("prediction", V.predict("scores"))


def accuracy(pred: DataFrame) -> DataFrame:
    hit = (F.col("prediction") == F.col("label")).cast("int")
    return pred.agg(
        (F.lit(100.0) * F.sum(hit) / F.count(F.lit(1))).alias("accuracy"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def _own_loss(log_probabilities):
    return -F.get(log_probabilities, F.col("label"))


def cross_entropy(
    pred: DataFrame, mode: str = "mean", batch: int = 32, rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """Mean loss, or the mean of batch means over batches in id order."""
    losses = pred.select("sample_id", _own_loss(V.log_softmax("scores")).alias("_loss"))
    if mode == "mean":
        return losses.agg(F.avg("_loss").alias("loss"))
    if mode != "batch_mean":
        raise ValueError(f"unknown mode {mode!r}")
    placed = with_position(losses, ["sample_id"], name="_pos", rows_per_cell=rows_per_cell)
    return (
        placed.groupBy(F.floor(F.col("_pos") / F.lit(batch)).alias("_batch"))
        .agg(F.avg("_loss").alias("_mean"))
        .agg(F.avg("_mean").alias("loss"))
    )


def nll(pred: DataFrame, log_probabilities: str = "log_probabilities") -> DataFrame:
    """Negative log-likelihood of given log-probabilities."""
    return pred.agg(F.avg(_own_loss(F.col(log_probabilities))).alias("loss"))


def evaluate(pred: DataFrame) -> DataFrame:
    """Accuracy and mean loss in one pass."""
    hit = (F.col("prediction") == F.col("label")).cast("int")
    return pred.agg(
        (F.lit(100.0) * F.sum(hit) / F.count(F.lit(1))).alias("accuracy"),
        F.avg(_own_loss(V.log_softmax("scores"))).alias("loss"),
    )


def evaluate_model(samples: DataFrame, spec: ModelSpec, weights) -> DataFrame:
    """``evaluate(score(..))`` with the loss taken in the scoring batch itself.

    The round loop runs it once a round: only a flag and a loss per row come
    back from the batch, and the plan is a partial and a final aggregate.
    """
    shared = samples.sparkSession.sparkContext.broadcast(np.asarray(weights, dtype=np.float64))

    @F.arrow_udf("hit int, loss double")
    def judged(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        params = unpack(spec, shared.value)
        for features, label in batches:
            scores = forward(spec, params, matrix(features, spec.n_features))
            hit, loss = hits_and_losses(scores, label.to_numpy(zero_copy_only=False))
            yield pa.StructArray.from_arrays([pa.array(hit), pa.array(loss)], ["hit", "loss"])

    return (
        samples.select(judged("features", "label").alias("j"))
        .agg(
            (F.lit(100.0) * F.sum("j.hit") / F.count(F.lit(1))).alias("accuracy"),
            F.avg("j.loss").alias("loss"),
        )
    )


def confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def metrics_per_label(pred: DataFrame) -> DataFrame:
    """Support, precision, recall and F1 of every label.

    Works on the confusion counts: each cell adds to the row total of its
    label and to the column total of its prediction.
    """
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero)

    def side(column: str, support: Column, predicted: Column, tp: Column) -> Column:
        return F.struct(
            F.col(column).alias("label"), support.alias("support"),
            predicted.alias("predicted"), tp.alias("tp"),
        )

    sides = confusion(pred).select(
        F.inline(
            F.array(side("label", F.col("n"), zero, hit), side("prediction", zero, F.col("n"), zero))
        )
    )
    counts = sides.groupBy("label").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")]
    )
    rates = counts.select(
        "label",
        "support",
        "tp",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumn("f1", _ratio(2 * p * r, p + r))


def classification_metrics(pred: DataFrame) -> DataFrame:
    """Accuracy, and precision, recall and F1 weighted by label frequency."""
    total = F.sum("support")
    return metrics_per_label(pred).agg(
        total.alias("support"),
        (F.sum("tp") / total).alias("accuracy"),
        *[
            (F.sum(F.col(c) * F.col("support")) / total).alias(c)
            for c in ("precision", "recall", "f1")
        ],
    )
