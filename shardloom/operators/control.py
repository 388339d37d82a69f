"""Round control as table operations: admission, deadlines, completeness,
recovery and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import spread_join
from .positions import ROWS_PER_CELL, with_position


def admit(
    requests: DataFrame,
    expected_round: int | Column,
    order_by: str = "request_id",
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Reply to every request: refused, rejected with a reason, or accepted.

    The first matching request of a participant in a round is the one at
    position 0. Positions are found by cells of time, so a participant that
    sends very many requests is not ordered in one task.
    """
    expected = F.lit(expected_round) if isinstance(expected_round, int) else expected_round
    known = F.col("round").isNotNull()
    base = requests.withColumn("expected", expected.cast("int"))
    base = base.withColumn(
        "_matches", F.coalesce(F.col("round") == F.col("expected"), F.lit(False))
    )
    placed = with_position(
        base, ["ts", order_by], ["round", "participant_id", "_matches"], "_pos",
        rows_per_cell=rows_per_cell,
    )
    is_first = F.col("_pos") == 0
    mismatch = known & ~F.col("_matches")
    return placed.select(
        *requests.columns,
        F.when(~known, "refused")
        .when(mismatch, "rejected")
        .when(is_first, "accepted")
        .otherwise("rejected")
        .alias("status"),
        F.when(~known, "invalid_request")
        .when(mismatch, "round_mismatch")
        .when(~is_first, "duplicate_connection")
        .alias("reason"),
        "expected",
        mismatch.alias("sync_required"),
        F.when(mismatch, F.col("expected")).alias("resume_round"),
    )


def within_deadline(
    updates: DataFrame, round_starts: DataFrame, seconds: float = 30.0, by: tuple[str, ...] = ("round",)
) -> DataFrame:
    """Rows that arrived within ``seconds`` of their round's start."""
    limit = F.make_dt_interval(secs=F.lit(float(seconds)))
    starts = round_starts.select(*by, F.col("ts").alias("round_start"))
    return spread_join(updates, starts, list(by)).filter(
        (F.col("ts") >= F.col("round_start")) & (F.col("ts") <= F.col("round_start") + limit)
    )


def round_complete(updates: DataFrame, expected: int) -> DataFrame:
    """A round is complete when enough participants were processed and sent updates."""
    sent = F.coalesce(F.col("status") == "success", F.lit(False))
    shards = updates.groupBy("round", "shard_id").agg(F.max(sent.cast("int")).alias("_sent"))
    processed, received = F.count(F.lit(1)), F.sum("_sent").cast("bigint")
    return shards.groupBy("round").agg(
        processed.alias("processed"),
        received.alias("received"),
        ((processed >= expected) & (received >= expected)).alias("complete"),
    )


def recover(
    checkpoints: DataFrame,
    failed_round: int,
    current: DataFrame | None = None,
) -> DataFrame:
    """Model of the round before the failed one, to resume the failed round.

    ``checkpoints`` is read with a filter on its ``round`` partition column.
    Without a checkpoint the result is empty, or ``current`` where given.
    """
    found = checkpoints.filter(F.col("round") == failed_round - 1)
    values = [c for c in ("layer", "pos", "value") if c in checkpoints.columns]
    restored = found.select(*values, F.lit("checkpoint").alias("source"))
    if current is not None:
        missing = found.limit(1).agg(F.count(F.lit(1)) == 0).scalar()
        fallback = current.select(*values, F.lit("current").alias("source")).filter(missing)
        restored = restored.unionByName(fallback)
    return restored.withColumn("resume_round", F.lit(failed_round))


def participant_status(events: DataFrame, order_by: str = "event_id") -> DataFrame:
    """Latest status of each participant from failure and recovery events."""
    status = F.when(F.col("event") == "failure", "failed").otherwise("active")
    return events.groupBy("participant_id").agg(
        F.max_by(status, F.struct("ts", order_by)).alias("status"),
        F.max("ts").alias("since"),
        F.count_if(F.col("event") == "failure").alias("n_failures"),
    )


def detect_short_round(updates: DataFrame, expected: DataFrame) -> DataFrame:
    """A failure event for every expected (round, shard) without a valid update."""
    received = updates.filter((F.col("status") == "success") & F.col("weights").isNotNull())
    missing = expected.join(
        received.select("round", "shard_id").distinct(), ["round", "shard_id"], "left_anti"
    )
    return missing.select(
        "round",
        F.lit("update_missing").alias("event"),
        F.col("shard_id").alias("participant_id"),
        F.lit("participant_offline").alias("value"),
    )
