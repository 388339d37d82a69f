"""Micro-batch training over a message stream.

A batch is an ordinary batch plan. Whatever outlives it is a table with one
folder per batch id, written by overwrite: a batch that is replayed after a
failure replaces its own rows and changes nothing else.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.averaging import vector_sum_mean
from ..operators.privacy import PrivacyConfig, add_gaussian_noise
from ..operators.quality import (
    label_entropy,
    participant_metrics,
    participant_score,
    restrict_to,
    select_participants,
)
from ..operators.training import train_logistic
from ..sources.messages import parse_messages

_SCHEMAS = {
    "model": "pos INT, value DOUBLE, batch_id BIGINT",
    "budget": "participant_id INT, epsilon DOUBLE, sigma DOUBLE, batch_id BIGINT",
    "metrics": "n_selected BIGINT, n_updates BIGINT, n_samples BIGINT, weights_norm DOUBLE, "
    "privacy_spent DOUBLE, batch_id BIGINT",
}


@dataclass(frozen=True)
class StreamConfig:
    path: str
    n_classes: int
    ratio: float = 0.5
    min_n: int = 2
    seed: int = 42
    # Of the privacy noise: a secret of this run, unless a test needs the same noise again.
    noise_seed: str = field(default_factory=lambda: secrets.token_hex(16), repr=False)
    denominator: str = "selected"
    privacy: PrivacyConfig | None = field(default_factory=PrivacyConfig)


def start_stream(
    df: DataFrame,
    fn: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval: float = 10.0,
    available_now: bool = False,
) -> StreamingQuery:
    """Call ``fn`` on a micro-batch every ``interval`` seconds.

    ``query.stop()`` ends the stream and leaves the session running.
    """
    writer = df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{interval} seconds").start()


def _replace(rows: DataFrame, path: str, table: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{table}/batch_id={batch_id}")


def read_state(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A state table over all batches; empty before the first one."""
    schema = _SCHEMAS[table]
    try:
        return spark.read.schema(schema).parquet(f"{path}/{table}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def update_global_model(mean: DataFrame, path: str, batch_id: int) -> None:
    """Make the averaged vector the model of this batch."""
    _replace(mean.select(F.col("pos").cast("int").alias("pos"), "value"), path, "model", batch_id)


def global_model(spark: SparkSession, path: str) -> DataFrame:
    """The model of the newest batch that produced one."""
    models = read_state(spark, path, "model")
    newest = models.agg(F.max("batch_id")).scalar()
    return models.filter(F.col("batch_id") == newest)


def budget_spent(spark: SparkSession, path: str) -> DataFrame:
    """Budget spent per batch and up to it: one row per batch in the window."""
    per_batch = read_state(spark, path, "budget").groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_updates"), F.sum("epsilon").alias("epsilon")
    )
    so_far = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_batch.withColumn("spent", F.sum("epsilon").over(so_far))


def train_batch(cfg: StreamConfig, resources: DataFrame) -> Callable[[DataFrame, int], None]:
    """The function for ``start_stream``: select, train, add noise, average, log."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        samples = parse_messages(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if samples.isEmpty():
                return
            metrics = participant_metrics(label_entropy(samples), resources)
            # Held in the cache for the batch: a stream leaves no checkpoint files.
            scored = participant_score(metrics).persist()
            selected = select_participants(
                scored, cfg.ratio, cfg.min_n, cfg.seed, checkpoint=False
            ).persist()
            updates = train_logistic(restrict_to(samples, selected), cfg.n_classes).filter(
                F.col("status") == "success"
            )
            if cfg.privacy is not None:
                updates = add_gaussian_noise(updates, cfg.privacy, f"{cfg.noise_seed}|{batch_id}")
            # The written updates are read below; nothing is trained again.
            stage = f"{cfg.path}/updates/batch_id={batch_id}"
            # Counted while they are written: the metrics need no job of their own.
            counted = Observation("updates")
            updates.observe(
                counted, F.count(F.lit(1)).alias("n_updates"),
                F.coalesce(F.sum("n_samples"), F.lit(0)).alias("n_samples"),
            ).write.mode("overwrite").parquet(stage)
            written = spark.read.parquet(stage)
            if cfg.privacy is not None:
                _replace(
                    written.select(
                        F.col("participant_id").cast("int").alias("participant_id"),
                        F.lit(cfg.privacy.epsilon).alias("epsilon"),
                        F.lit(cfg.privacy.sigma).alias("sigma"),
                    ),
                    cfg.path, "budget", batch_id,
                )
            mean = vector_sum_mean(
                written.select("weights"), cfg.denominator, selected
            )
            update_global_model(mean, cfg.path, batch_id)
            epsilon = cfg.privacy.epsilon if cfg.privacy is not None else 0.0
            _replace(
                batch_metrics(spark, cfg.path, batch_id, selected, written, epsilon, counted.get),
                cfg.path, "metrics", batch_id,
            )
            selected.unpersist()
            scored.unpersist()
        finally:
            samples.unpersist()

    return run


def batch_metrics(
    spark: SparkSession,
    path: str,
    batch_id: int,
    selected: DataFrame,
    updates: DataFrame,
    epsilon: float = 0.0,
    counts: dict | None = None,
) -> DataFrame:
    """One row: participants, updates, samples, model norm, budget spent so far.

    ``counts`` has ``n_updates`` and ``n_samples`` where they were observed as the updates were made.

    The budget adds to that of the last earlier batch, so the history of
    updates is not read again, and a replayed batch arrives at the same sum.
    """
    model = read_state(spark, path, "model").filter(F.col("batch_id") == batch_id)
    spent = (
        read_state(spark, path, "metrics")
        .filter(F.col("batch_id") < batch_id)
        .agg(F.max_by("privacy_spent", "batch_id"))
    )
    norm = model.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))))
    if counts is None:
        totals = updates.agg(
            F.count(F.lit(1)).alias("n_updates"),
            F.coalesce(F.sum("n_samples"), F.lit(0)).cast("bigint").alias("n_samples"),
        )
    else:
        totals = spark.range(1).select(
            *[F.lit(counts[c]).cast("bigint").alias(c) for c in ("n_updates", "n_samples")]
        )
    return totals.select(
        selected.agg(F.count(F.lit(1))).scalar().alias("n_selected"),
        "n_updates",
        "n_samples",
        norm.scalar().alias("weights_norm"),
        (F.coalesce(spent.scalar(), F.lit(0.0)) + F.col("n_updates") * F.lit(epsilon)).alias(
            "privacy_spent"
        ),
    )


def admit_stream(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Streaming form of admission: the first request of a participant in a
    round; state older than the delay is dropped. ``ts`` must be a timestamp."""
    return (
        requests.filter(F.col("round") == F.col("expected"))
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["round", "participant_id"])
    )


def within_deadline_stream(updates: DataFrame, seconds: float = 30.0) -> DataFrame:
    """Streaming form of the deadline, for updates that carry ``round_start``."""
    limit = F.make_dt_interval(secs=F.lit(float(seconds)))
    return updates.withWatermark("ts", f"{seconds} seconds").filter(
        (F.col("ts") >= F.col("round_start")) & (F.col("ts") <= F.col("round_start") + limit)
    )
