"""Round ledgers, accuracy histories and failure logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import format_ledger
from ..schemas import FAILURE_LOG, HISTORY

# The ledger columns as they stand in the files.
LEDGER_COLUMNS = {
    "Round": "round",
    "Timestamp": "timestamp",
    "Accuracy": "accuracy",
    "Loss": "loss",
    "Participants": "active",
    "Active_Partitions": "active",
    "Failed_Participants": "failed",
    "Failed_Partitions": "failed",
    "Mode": "mode",
}
_TYPES = {"round": "int", "timestamp": "double", "accuracy": "double", "loss": "double",
          "active": "int", "failed": "int"}
_REQUIRED = ("round", "timestamp", "accuracy", "loss")


def clean_ledger(raw: DataFrame) -> DataFrame:
    """Type an all-string ledger and drop rows that cannot be read.

    In the loss the letter ``l`` stands for a mistyped 1. A value of the four
    main columns that is not a number makes its row unreadable.
    """
    named = raw.select(*[F.col(c).alias(LEDGER_COLUMNS.get(c, c)) for c in raw.columns])
    if "loss" in named.columns:
        named = named.withColumn("loss", F.replace("loss", F.lit("l"), F.lit("1")))
    as_number = {
        # '3.0' is round 3, as a numeric column reads it
        c: F.col(c).try_cast("double").try_cast(t) if t == "int" else F.col(c).try_cast(t)
        for c, t in _TYPES.items()
        if c in named.columns
    }
    return named.withColumns(as_number).na.drop(
        subset=[c for c in _REQUIRED if c in named.columns]
    )


def read_ledger(spark: SparkSession, path: str, method: str | None = None) -> DataFrame:
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    ledger = clean_ledger(raw)
    return ledger if method is None else ledger.withColumn("method", F.lit(method))


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """Accuracy history; empty when missing or under another header."""
    empty = spark.createDataFrame([], HISTORY)
    try:
        header = spark.read.text(path).limit(1).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    if not header or header[0][0].strip() != "Round,Accuracy":
        return empty
    return spark.read.schema(HISTORY).option("header", True).csv(path)


def save_history(ledger: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The whole history anew, or (``append``) the last round only.

    A history has one row per round and goes to a single file, so that its
    header is the file's first line.
    """
    rows = ledger.select(F.col("round").alias("Round"), F.col("accuracy").alias("Accuracy"))
    if mode == "append":
        newest = rows.agg(F.max("Round")).scalar()
        rows = rows.filter(F.col("Round") == newest)
    rows.coalesce(1).sortWithinPartitions("Round").write.mode(mode).option("header", True).csv(path)


def append_ledger(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = format_ledger(rows).write.mode("append")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def append_failure_event(events: DataFrame, path: str) -> None:
    """Failure log rows; the event time defaults to now, in epoch seconds."""
    if "ts" not in events.columns:
        events = events.withColumn("ts", F.unix_micros(F.current_timestamp()) / 1e6)
    events.select(*[F.col(f.name).cast(f.dataType) for f in FAILURE_LOG]).write.mode(
        "append"
    ).parquet(path)


def read_failure_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FAILURE_LOG).parquet(path)
