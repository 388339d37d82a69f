"""Which participants should train this round?"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.quality import (
    label_entropy,
    participant_metrics,
    participant_score,
    restrict_to,
    select_participants,
)


def choose_participants(
    samples: DataFrame, resources: DataFrame, ratio: float = 0.5, min_n: int = 2, seed=42
) -> DataFrame:
    """Entropy, resource metrics, score, and the best participants in rank order."""
    metrics = participant_metrics(label_entropy(samples), resources)
    return select_participants(participant_score(metrics), ratio, min_n, seed)


def training_rows(
    samples: DataFrame, resources: DataFrame, ratio: float = 0.5, min_n: int = 2, seed=42
) -> DataFrame:
    """The samples of the chosen participants."""
    return restrict_to(samples, choose_participants(samples, resources, ratio, min_n, seed))
