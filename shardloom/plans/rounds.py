"""The training round loop."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..operators.evaluation import evaluate_model
from ..operators.joins import BROADCAST_ROWS
from ..operators.models import ModelSpec, TrainConfig
from ..operators.training import packed, train_units
from ..schemas import LEDGER
from ..sources.checkpoints import save_checkpoint
from ..sources.ledgers import append_ledger
from .journal import Journal, model_table, shard_status, status_events

# Up to so many units for each shuffle partition every unit has a task of its own.
UNITS_PER_PARTITION = 16
# Feature values of a test set up to which it is kept on the executors.
HELD_VALUES = 1 << 25


@dataclass(frozen=True)
class RoundConfig:
    spec: ModelSpec
    train: TrainConfig = field(default_factory=TrainConfig)
    rounds: int = 20
    policy: str = "any"
    method: str = "spark"
    mode: str = "normal"
    # Units of a shard: a number, or about so many rows each. See train_local.
    units_per_shard: int = 1
    unit_rows: int | None = None
    partitions: int | None = None
    checkpoint_path: str | None = None
    ledger_path: str | None = None
    # A folder that keeps the whole state of the run, from which the same call goes on.
    journal: str | None = None
    zeros: bool = False
    start_round: int = 1


@dataclass
class RoundResult:
    ledger: DataFrame
    model: DataFrame
    weights: np.ndarray


def run_rounds(
    samples: DataFrame,
    test: DataFrame,
    cfg: RoundConfig,
    outages: DataFrame | None = None,
    start: np.ndarray | None = None,
) -> RoundResult:
    """Distribute, train per shard, check the quorum, average, evaluate, log.

    The sharded samples are laid out once by unit and kept on the executors, compressed; every round trains on them
    where they lie, and a unit of any size passes through its task (with ``order="keyed"`` a task must hold its unit). Shards and their outages stay tables: what comes back to the driver in a round is the
    averaged model and two counts. Averaging units by their sample counts equals averaging shards by theirs,
    since a shard's update is the weighted mean of its units; a shard with a failed unit is left out.

    With ``cfg.journal`` each round leaves its model, the status of every shard, its events and, last, a
    commit. The same call with the same folder goes on after the newest commit, up to the last of
    ``cfg.rounds`` rounds, and its ledger holds the rounds before as well.
    """
    if cfg.policy not in ("any", "all"):
        raise ValueError(f"unknown quorum policy {cfg.policy!r}")
    spark = samples.sparkSession
    journal = Journal(spark, cfg.journal) if cfg.journal else None
    newest = journal.last() if journal else None
    first, last, elapsed = cfg.start_round, cfg.start_round + cfg.rounds - 1, 0.0
    weights = cfg.spec.initial(cfg.train.seed, cfg.zeros) if start is None else np.asarray(start)
    if newest is not None:
        first, elapsed = newest["round"] + 1, newest["timestamp"]
        weights = journal.model(cfg.spec, first)
    shards = _shards(samples, cfg).persist(StorageLevel.MEMORY_AND_DISK)  # a row per shard
    laid_out, parts, n_shards = _laid_out(samples, shards, cfg)
    held_out = test.select("sample_id", "features", "label")
    if held_out.count() * cfg.spec.n_features <= HELD_VALUES:
        # Even tasks for every evaluation, whatever files the test set came in. A larger one is read anew.
        held_out = held_out.repartition(parts, "sample_id").persist(StorageLevel.MEMORY_AND_DISK)
    short = set()  # rounds with an outage; which shards are away stays a table
    if outages is not None:
        of_run = outages.filter(F.col("round").between(first, last))
        short = {row[0] for row in of_run.select("round").distinct().collect()}
    rows = []
    began = time.monotonic()
    try:
        for r in range(first, last + 1):
            away = None
            if r in short:
                away = outages.filter(F.col("round") == r).select("shard_id").distinct()
            # A broadcast of the shards that are away keeps the cached layout: no shuffle.
            active = laid_out if away is None else laid_out.join(F.broadcast(away), "shard_id", "left_anti")
            shared = spark.sparkContext.broadcast(weights)
            units = train_units(active, cfg.spec, cfg.train, shared, r, by=("shard_id", "unit", "slot"))
            if journal:
                units = units.persist(StorageLevel.MEMORY_AND_DISK)  # read again for the status
            mean, valid = _average(units, cfg.spec.size, cfg.units_per_shard == 1 and not cfg.unit_rows)
            failed = n_shards - valid
            met = valid > 0 and (cfg.policy == "any" or failed == 0)
            if met:
                weights = mean
            status = journal and shard_status(shards, units, away)
            accuracy, loss = evaluate_model(held_out, cfg.spec, weights).first()
            row = (r, elapsed + time.monotonic() - began, accuracy, loss, valid, failed, cfg.mode, cfg.method)
            rows.append(row)
            if cfg.ledger_path:
                append_ledger(spark.createDataFrame([row], LEDGER), cfg.ledger_path)
            if cfg.checkpoint_path:
                save_checkpoint(model_table(spark, cfg.spec, weights), cfg.checkpoint_path, r)
            if journal:
                events = status_events(journal.status(r - 1), status, r)
                commit = Row(*LEDGER.names, "quorum_met", "expected")(*row, met, n_shards)
                journal.commit(commit, model_table(spark, cfg.spec, weights), status, events)
                units.unpersist()
            shared.destroy()
    finally:
        for kept in (shards, laid_out, held_out):
            kept.unpersist()
    ledger = journal.commits().select(*LEDGER.names) if journal else spark.createDataFrame(rows, LEDGER)
    return RoundResult(ledger, model_table(spark, cfg.spec, weights), weights)


def _shards(samples: DataFrame, cfg: RoundConfig) -> DataFrame:
    """Every shard with its size, its number of units and the slot of its first unit. A sample without a
    shard takes no part."""
    sizes = samples.filter("shard_id IS NOT NULL").groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_samples"))
    units = F.lit(cfg.units_per_shard)
    if cfg.unit_rows:
        units = F.ceil(F.col("n_samples") / F.lit(cfg.unit_rows))
    before = Window.orderBy("shard_id").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    sizes = sizes.withColumn("units", units.cast("int"))
    return sizes.withColumn("slot", F.coalesce(F.sum("units").over(before), F.lit(0)).cast("int"))


def _laid_out(samples: DataFrame, shards: DataFrame, cfg: RoundConfig) -> tuple[DataFrame, int, int]:
    """Samples with their unit, packed in the order of their ids and cached so that a unit lies in one
    partition; partitions; shards.

    While units are few each has a partition of its own, where hashes of few keys would collide and leave
    tasks idle. Many units are spread by hash.
    """
    n_shards, n_units = shards.agg(F.count(F.lit(1)), F.coalesce(F.sum("units"), F.lit(0))).first()
    of_shard = shards.select("shard_id", "units", "slot")
    of_shard = F.broadcast(of_shard) if n_shards <= BROADCAST_ROWS else of_shard
    unit = F.pmod(F.xxhash64("sample_id"), F.col("units")).cast("int")
    rows = (
        samples.select("shard_id", "sample_id", "features", "label").join(of_shard, "shard_id")
        .withColumn("unit", unit).withColumn("slot", F.col("slot") + F.col("unit")).drop("units")
    )
    width = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cfg.partitions or max(width, math.ceil(n_units / UNITS_PER_PARTITION))
    if cfg.partitions is None and n_units <= width * UNITS_PER_PARTITION:
        dealt = rows.repartitionById(max(1, n_units), F.col("slot"))
    else:
        dealt = rows.repartition(parts, "slot")
    if cfg.train.order == "keyed":
        dealt = dealt.sortWithinPartitions("shard_id", "unit", "slot")
    else:
        dealt = packed(dealt.sortWithinPartitions("slot", F.col("sample_id").asc_nulls_last()), cfg.spec, "slot")
    return dealt.persist(StorageLevel.MEMORY_AND_DISK), parts, n_shards


def _average(units: DataFrame, size: int, whole: bool) -> tuple[np.ndarray | None, int]:
    """The mean model of the shards without a failed unit, and their number, in one job.

    Weights become (shard, pos) sums, with a mark at position -1; a failed unit marks all positions of
    its shard. The marks drop the shard before the mean is taken. Both aggregates are partial before their shuffle. Where a unit is a ``whole`` shard
    there is nothing to sum by shard.
    """
    ok, n = F.col("status") == "success", F.col("n_samples")
    missing = F.array_repeat(F.lit(None).cast("double"), size)
    cells = units.select(
        "shard_id", "n_samples", ok.alias("ok"),
        F.posexplode(F.concat(F.array(F.lit(0.0)), F.coalesce("weights", missing))).alias("pos", "v"),
    )
    if whole:
        shards = cells.filter("ok").select("pos", (n * F.col("v")).alias("s"), n.alias("n"))
    else:
        shards = cells.groupBy("shard_id", "pos").agg(
            F.sum(n * F.col("v")).alias("s"), F.sum("n_samples").alias("n"), F.bool_and("ok").alias("ok")
        ).filter("ok")
    found = shards.groupBy("pos").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("value"), F.count(F.lit(1)).alias("valid"))
    table = found.toArrow()  # a row per model parameter, and one
    if not table.num_rows:
        return None, 0
    if table.num_rows != size + 1:
        raise ValueError(f"averaged model has {table.num_rows - 1} values, {size} expected")
    mean = np.empty(size + 1)
    mean[table["pos"].to_numpy()] = table["value"].to_numpy()
    return mean[1:], table["valid"][0].as_py()
