"""Scalar formulas: learning-rate decay and noise scale."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def lr_schedule(round_no, lr0: float, gamma: float = 0.8, step: int = 5) -> Column:
    """Step decay by round number, rounds counted from 1."""
    r = F.col(round_no) if isinstance(round_no, str) else round_no
    return F.lit(float(lr0)) * F.pow(F.lit(float(gamma)), F.floor((r - 1) / F.lit(step)))


def lr_at(round_no: int, lr0: float, gamma: float = 0.8, step: int = 5) -> float:
    return lr0 * gamma ** ((round_no - 1) // step)


def gaussian_sigma(epsilon, delta, sensitivity) -> Column:
    """Standard deviation of the Gaussian mechanism, from columns or numbers."""
    e, d, s = (F.lit(float(v)) if isinstance(v, (int, float)) else v for v in (epsilon, delta, sensitivity))
    return F.sqrt(F.lit(2.0) * F.log(F.lit(1.25) / d)) * s / e


def gaussian_sigma_value(epsilon: float, delta: float, sensitivity: float) -> float:
    return math.sqrt(2.0 * math.log(1.25 / delta)) * sensitivity / epsilon
