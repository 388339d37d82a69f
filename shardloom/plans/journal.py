"""The state of a training run as tables, from which it can go on.

Below one folder, a partition for each round: the model after the round, the status of every shard, the
events of the round, and last the commit. A round counts when its commit is there. Whatever an interrupted
round has left is replaced when the round is run again, because every write overwrites its partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.control import recover
from ..operators.models import ModelSpec
from ..schemas import FAILURE_LOG, LEDGER
from ..sources.checkpoints import read_checkpoints, save_checkpoint

# One row a round: the ledger's row, whether the quorum was met, and how many shards were expected.
COMMIT = T.StructType([*LEDGER.fields, T.StructField("quorum_met", T.BooleanType()), T.StructField("expected", T.IntegerType())])
STATUS = "participant_id INT, status STRING"


class Journal:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, part: str, schema: T.StructType | str) -> DataFrame:
        """A table of the journal; empty before the first round."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        return self._read("commits", COMMIT)

    def events(self) -> DataFrame:
        """Failures and recoveries of the committed rounds."""
        return self._read("events", FAILURE_LOG).join(self.commits().select("round"), "round", "left_semi")

    def status(self, round_no: int) -> DataFrame:
        found = self._read("status", f"{STATUS}, saved_at DOUBLE, round INT")
        return found.filter(F.col("round") == round_no).select("participant_id", "status")

    def last(self) -> Row | None:
        """The commit of the newest round."""
        return self.commits().orderBy(F.desc("round")).first()

    def model(self, spec: ModelSpec, resumed_round: int) -> np.ndarray:
        """The model with which ``resumed_round`` begins: that of the round before."""
        return flat_model(recover(read_checkpoints(self.spark, self.path), resumed_round), spec)

    def commit(self, row: Row, model: DataFrame, status: DataFrame, events: DataFrame) -> None:
        """Writes a round's tables, and then the row by which it counts."""
        round_no = row["round"]
        save_checkpoint(model, self.path, round_no, status)
        self._write(events.withColumn("ts", F.unix_micros(F.current_timestamp()) / 1e6), "events")
        self._write(self.spark.createDataFrame([row], COMMIT), "commits")

    def _write(self, rows: DataFrame, part: str) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("round").parquet(f"{self.path}/{part}")


def shard_status(shards: DataFrame, marks: DataFrame, away: DataFrame | None) -> DataFrame:
    """``active``, ``failed`` or ``offline`` for every expected shard of a round.

    ``marks`` has a row for every unit that was trained, ``away`` the shards of an outage. A shard that
    neither sent an update nor is away was silent, and is offline too.
    """
    trained = marks.groupBy("shard_id").agg(F.bool_and(F.col("status") == "success").alias("_ok"))
    if away is not None:
        trained = trained.join(away, "shard_id", "left_anti")
    status = F.when(F.col("_ok"), "active").when(~F.col("_ok"), "failed").otherwise("offline")
    return shards.select("shard_id").join(trained, "shard_id", "left").select(
        F.col("shard_id").alias("participant_id"), status.alias("status")
    )


def status_events(before: DataFrame, now: DataFrame, round_no: int) -> DataFrame:
    """An event for every shard that is not active, and for every one that is again."""
    old = before.select("participant_id", F.col("status").alias("_before"))
    joined = now.join(old, "participant_id", "left")
    lost, back = F.col("status") != "active", F.coalesce(F.col("_before") != "active", F.lit(False))
    return joined.filter(lost | back).select(
        F.lit(round_no).alias("round"),
        F.when(lost, "failure").otherwise("recovery").alias("event"),
        "participant_id",
        F.col("status").alias("value"),
    )


def flat_model(rows: DataFrame, spec: ModelSpec) -> np.ndarray:
    """(layer, pos, value) rows as one vector; their number is fixed by the spec."""
    found = rows.select("layer", "pos", "value").toArrow()
    if found.num_rows != spec.size:
        raise LookupError(f"a model of {spec.size} values was asked for, {found.num_rows} were found")
    first, at = {}, 0
    for name, shape in spec.layers:
        first[name] = at
        at += int(np.prod(shape))
    out = np.empty(spec.size)
    out[[first[x] + i for x, i in zip(found["layer"].to_pylist(), found["pos"].to_pylist())]] = found["value"].to_numpy()
    return out


def model_table(spark: SparkSession, spec: ModelSpec, weights: np.ndarray) -> DataFrame:
    """(layer, pos, value) rows of a flat model; its size is fixed by the spec."""
    sizes = [int(np.prod(shape)) for _, shape in spec.layers]
    names = np.repeat([name for name, _ in spec.layers], sizes)
    places = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
    return spark.createDataFrame(pa.table({"layer": names, "pos": places, "value": np.asarray(weights, float)}))
