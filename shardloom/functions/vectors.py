"""Element-wise and per-vector functions on ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scale(features, divisor: float) -> Column:
    return F.transform(_col(features), lambda x: x / F.lit(float(divisor)))


def standardize(features, mean: float, std: float) -> Column:
    return F.transform(_col(features), lambda x: (x - F.lit(float(mean))) / F.lit(float(std)))


def standardize_channels(
    features, means: Sequence[float], stds: Sequence[float], channel_size: int
) -> Column:
    """Standardise a flattened channel-major tensor, channel by channel."""
    mean_of = F.array(*[F.lit(float(m)) for m in means])
    std_of = F.array(*[F.lit(float(s)) for s in stds])

    def one(x: Column, i: Column) -> Column:
        channel = F.floor(i / F.lit(channel_size)).cast("int")
        return (x - F.get(mean_of, channel)) / F.get(std_of, channel)

    return F.transform(_col(features), one)


def clip(features, low: float = 0.0, high: float = 1.0) -> Column:
    return F.transform(
        _col(features), lambda x: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))
    )


def flatten_features(features) -> Column:
    return F.flatten(_col(features))


def predict(scores) -> Column:
    """Index of the first maximum."""
    s = _col(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def log_softmax(scores) -> Column:
    s = _col(scores)
    top = F.array_max(s)
    total = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    log_z = top + F.log(total)
    # An one-element array carries log_z into the lambda, so it is computed once.
    return F.flatten(
        F.transform(F.array(log_z), lambda z: F.transform(s, lambda x: x - z))
    )


def vector_norm(weights) -> Column:
    return F.sqrt(F.aggregate(_col(weights), F.lit(0.0), lambda acc, x: acc + x * x))


def clip_l2(weights, clip_norm: float) -> Column:
    """Scale a vector down to ``clip_norm`` when it is longer."""
    w = _col(weights)
    factor = F.lit(float(clip_norm)) / vector_norm(w)
    return F.when(
        vector_norm(w) > F.lit(float(clip_norm)),
        F.flatten(F.transform(F.array(factor), lambda f: F.transform(w, lambda x: x * f))),
    ).otherwise(w)


def add(left, right) -> Column:
    return F.zip_with(_col(left), _col(right), lambda a, b: a + b)
