"""Model and status checkpoints, one partition per round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MODEL

_STATUS = "participant_id INT, status STRING"


def save_checkpoint(
    params: DataFrame, path: str, round_no: int | None = None, status: DataFrame | None = None
) -> None:
    """Write the parameters (and participant status) of one round, or of the
    rounds in a ``round`` column. Only those partitions are replaced."""
    for df, part in ((params, "model"), (status, "status")):
        if df is None:
            continue
        rows = df if round_no is None else df.withColumn("round", F.lit(round_no))
        (
            rows.withColumn("saved_at", F.unix_micros(F.current_timestamp()) / 1e6)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("round")
            .parquet(f"{path}/{part}")
        )


def read_checkpoints(spark: SparkSession, path: str, part: str = "model") -> DataFrame:
    """All rounds; a filter on ``round`` prunes partitions."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MODEL)
    ddl = columns if part == "model" else _STATUS
    return spark.read.schema(f"{ddl}, saved_at DOUBLE, round INT").parquet(f"{path}/{part}")


def load_checkpoint(spark: SparkSession, path: str, round_no: int, part: str = "model") -> DataFrame:
    """The checkpoint of exactly this round; a missing one is an error."""
    found = read_checkpoints(spark, path, part).filter(F.col("round") == round_no)
    if found.isEmpty():
        raise LookupError(f"no checkpoint of round {round_no}")
    return found
