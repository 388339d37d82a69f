"""Gaussian noise, clipping and the privacy budget."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.random import normals
from ..functions.rates import gaussian_sigma_value


@dataclass(frozen=True)
class PrivacyConfig:
    epsilon: float = 1.0
    delta: float = 1e-5
    sensitivity: float = 1.0
    clip_norm: float = 1.0

    @property
    def sigma(self) -> float:
        return gaussian_sigma_value(self.epsilon, self.delta, self.sensitivity)


def add_gaussian_noise(
    updates: DataFrame, cfg: PrivacyConfig, seed, keys: Sequence[str] = ("participant_id",)
) -> DataFrame:
    """``w + N(0, sigma)`` per coordinate, drawn from the update's own keys and ``seed``.

    Who knows the seed can subtract the noise: give a secret, such as ``secrets.token_hex(16)``, and a fixed
    value in tests only.
    """
    z = normals(F.size("weights"), *[F.col(k) for k in keys], seed=seed)
    return updates.withColumn(
        "weights", F.zip_with("weights", z, lambda w, e: w + F.lit(cfg.sigma) * e)
    )


def clip_updates(updates: DataFrame, clip_norm: float) -> DataFrame:
    return updates.withColumn("weights", V.clip_l2("weights", clip_norm))


def privacy_ledger(updates: DataFrame, epsilon: float, order_col: str = "round") -> DataFrame:
    """Budget spent per round and up to it: epsilon for every noised update.

    The window runs over one row per round, after the updates are counted.
    """
    per_round = updates.groupBy(order_col).agg(
        F.count(F.lit(1)).alias("n_updates"),
        (F.count(F.lit(1)) * F.lit(float(epsilon))).alias("epsilon"),
    )
    so_far = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_round.withColumn("spent", F.sum("epsilon").over(so_far))


def privacy_metrics(cfg: PrivacyConfig, ledger: DataFrame) -> DataFrame:
    """Budget, amount spent, noise scale (sensitivity / epsilon) and clip norm."""
    return ledger.agg(
        F.lit(cfg.epsilon).alias("privacy_budget"),
        F.coalesce(F.max("spent"), F.lit(0.0)).alias("privacy_spent"),
        F.lit(cfg.sensitivity / cfg.epsilon).alias("noise_scale"),
        F.lit(cfg.clip_norm).alias("clip_norm"),
    )
