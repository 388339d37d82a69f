"""Participant data quality, scoring and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import order_key
from ..session import materialised
from .joins import spread_join
from .positions import with_position


def label_entropy(samples: DataFrame, by: str = "participant_id", label: str = "label") -> DataFrame:
    """Entropy in bits of each participant's labels.

    Rows are first counted per (participant, label), so a participant with
    very many rows reaches the second step as a handful of counts. Written as
    ``log2(n) - sum(c * log2(c)) / n``: one pass, no join for the total.
    """
    counts = samples.groupBy(by, label).agg(F.count(F.lit(1)).alias("_c"))
    total = F.sum("_c")
    return counts.groupBy(by).agg(
        F.greatest(
            F.lit(0.0), F.log2(total) - F.sum(F.col("_c") * F.log2("_c")) / total
        ).alias("entropy"),
        total.alias("n_samples"),
    )


def label_histogram(samples: DataFrame, label: str = "label") -> DataFrame:
    return samples.groupBy(label).agg(F.count(F.lit(1)).alias("n_samples"))


def participant_metrics(entropy: DataFrame, resources: DataFrame) -> DataFrame:
    """One row per participant: resource use and data quality."""
    return entropy.join(resources, "participant_id").select(
        "participant_id",
        "cpu_percent",
        "memory_percent",
        "disk_usage",
        F.col("entropy").alias("data_quality_score"),
    )


def participant_score(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn(
        "score",
        F.lit(0.4) * (1 - F.col("cpu_percent") / 100)
        + F.lit(0.3) * (1 - F.col("memory_percent") / 100)
        + F.lit(0.3) * F.col("data_quality_score"),
    )


def select_participants(
    scored: DataFrame,
    ratio: float = 0.5,
    min_n: int = 2,
    seed=42,
    by: Sequence[str] = (),
    digits: int = 9,
    checkpoint: bool = True,
) -> DataFrame:
    """The best ``max(min_n, int(n * ratio))`` participants, overall or per group.

    Ranked by score, ties in seeded random order. Scores are compared at
    ``digits`` decimals, so that participants with equal inputs tie whatever
    the order their values were added up in. Rank and group size come from
    cell positions: selecting half of very many participants is a filter, not
    a limit on one task.

    Ranking reads ``scored`` several times: one row per participant, but often
    the result of a pass over all samples. It is checkpointed first, unless the
    caller holds it already.
    """
    keyed = scored.withColumn(
        # A participant without a score ranks behind all others.
        "_desc", F.coalesce(-F.round("score", digits), F.lit(float("inf")))
    ).withColumn(
        "_tie", order_key(F.col("participant_id"), seed=seed)
    )
    ranked = with_position(
        materialised(keyed) if checkpoint else keyed, ["_desc", "_tie", "participant_id"], within=by, name="_pos", total="_total"
    )
    k = F.greatest(F.lit(min_n), F.floor(F.col("_total") * F.lit(float(ratio))).cast("int"))
    return (
        ranked.filter(F.col("_pos") < k)
        .withColumn("rank", (F.col("_pos") + 1).cast("bigint"))
        .drop("_desc", "_tie", "_pos", "_total")
    )


def restrict_to(samples: DataFrame, selected: DataFrame, key: str = "participant_id") -> DataFrame:
    """Rows of the selected ids. A short list is broadcast, and the samples stay
    where they are; a long one is joined by a shuffle that spreads
    the rows of a hot id."""
    return spread_join(samples, selected.select(key), [key], "left_semi")
