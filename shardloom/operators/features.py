"""Feature noise, per-participant sampling and row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.random import normals, permuted
from .joins import BROADCAST_ROWS, spread_join
from .positions import with_position

ID = "sample_id"
# Draws of a participant that one task makes at once.
BLOCK_DRAWS = 1 << 16


def add_feature_noise(
    samples: DataFrame, sigma: float = 0.1, seed=42, low: float = 0.0, high: float = 1.0
) -> DataFrame:
    """``clip(x + N(0, sigma), low, high)`` with noise keyed by (id, position)."""
    z = normals(F.size("features"), F.col(ID), seed=seed)
    noisy = F.zip_with(F.col("features"), z, lambda x, e: x + F.lit(float(sigma)) * e)
    return samples.withColumn("features", V.clip(noisy, low, high))


def sample_per_participant(
    samples: DataFrame, participants: DataFrame, k: int, seed=42
) -> DataFrame:
    """Each participant draws ``k`` distinct samples, independently of the others.

    Draw i of a participant is the sample at the place to which its own permutation of the samples sends
    i - 1: exactly ``participants * k`` rows, whatever the share of k, and nothing to sort, to sift or to
    retry. Samples are numbered by id; then places are joined to samples. The draws are made in blocks that are
    dealt to all tasks, and few samples come to them by broadcast.
    """
    n = samples.count()
    if k > n:
        raise ValueError(f"cannot draw {k} distinct samples out of {n}")
    indexed = with_position(samples.select(ID), [ID], name="_at")
    spark = samples.sparkSession
    first = F.sequence(F.lit(0), F.lit(k - 1), F.lit(BLOCK_DRAWS)) if k else F.array().cast("array<int>")
    blocks = participants.select("participant_id", F.explode(first).alias("_first"))
    blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    last = F.least(F.col("_first") + F.lit(BLOCK_DRAWS), F.lit(k))
    picks = blocks.select("participant_id", F.explode(F.sequence(F.col("_first") + 1, last)).alias("draw")).withColumn(
        "_at", permuted(F.col("draw") - 1, max(n, 1), F.col("participant_id"), seed=seed)
    )
    if n > BROADCAST_ROWS:
        drawn = picks.join(indexed, "_at").drop("_at")
        if participants.count() * k <= BROADCAST_ROWS:
            return spread_join(samples, drawn, [ID])
        both = drawn.alias("drawn").join(samples.alias("samples"), ID)
    else:
        drawn = picks.join(F.broadcast(indexed), "_at").drop("_at")
        both = drawn.alias("drawn").join(F.broadcast(samples.alias("samples")), ID)
    return both.select("samples.*", "drawn.participant_id", "drawn.draw")


def valid_updates(updates: DataFrame) -> DataFrame:
    return updates.filter((F.col("status") == "success") & F.col("weights").isNotNull())


def failed_updates(updates: DataFrame) -> DataFrame:
    ok = F.coalesce(F.col("status") == "success", F.lit(False)) & F.col("weights").isNotNull()
    return updates.filter(~ok)


def exclude_unavailable(
    shards: DataFrame, outages: DataFrame, round_no: int | None = None, key: str = "shard_id"
) -> DataFrame:
    """Drop shards that are out: in one round, or row by row on a round column."""
    if round_no is not None:
        out = outages.filter(F.col("round") == round_no).select(key).distinct()
        return spread_join(shards, out, [key], "left_anti")
    return spread_join(shards, outages.select("round", key), ["round", key], "left_anti")


def format_ledger(ledger: DataFrame) -> DataFrame:
    """Two digits for accuracy and time, four for the loss."""
    digits = {"accuracy": 2, "timestamp": 2, "loss": 4}
    return ledger.withColumns(
        {c: F.round(F.col(c), d) for c, d in digits.items() if c in ledger.columns}
    )
