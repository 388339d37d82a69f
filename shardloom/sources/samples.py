"""Sample tables: parquet shards and the headerless label-first CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sharding import with_unit
from ..schemas import SAMPLES, SHARDED_SAMPLES


def read_samples(spark: SparkSession, path: str, schema: T.StructType = SAMPLES) -> DataFrame:
    """Samples from parquet; a ``shard_id=..`` layout adds that column."""
    return spark.read.schema(schema).parquet(path)


def read_label_csv(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """Label first, then ``n_features`` numbers, no header."""
    names = [f"f{i}" for i in range(n_features)]
    schema = T.StructType(
        [T.StructField("label", T.IntegerType())]
        + [T.StructField(c, T.DoubleType()) for c in names]
    )
    rows = spark.read.schema(schema).option("header", False).csv(path)
    return rows.select("label", F.array(*names).alias("features"))


def write_label_csv(samples: DataFrame, path: str, n_features: int, mode: str = "overwrite") -> None:
    columns = [F.get("features", F.lit(i)).alias(f"f{i}") for i in range(n_features)]
    samples.select("label", *columns).write.mode(mode).option("header", False).csv(path)


def write_shards(
    samples: DataFrame, path: str, test: DataFrame | None = None, rows_per_file: int = 1_000_000
) -> None:
    """One folder per shard below ``train``, and one shared ``test`` set.

    Rows are laid out by (shard, file), so a task writes few files, and a large
    shard is spread over as many files and tasks as its size asks for.
    """
    (
        with_unit(samples, rows_per_file)
        .repartition("shard_id", "unit")
        .drop("unit")
        .write.mode("overwrite")
        .partitionBy("shard_id")
        .parquet(f"{path}/train")
    )
    if test is not None:
        test.write.mode("overwrite").parquet(f"{path}/test")


def read_shard(spark: SparkSession, path: str, shard_id: int | None = None) -> DataFrame:
    """Training shards written by ``write_shards``; one shard is a pruned scan."""
    shards = spark.read.schema(SHARDED_SAMPLES).parquet(f"{path}/train")
    return shards if shard_id is None else shards.filter(F.col("shard_id") == shard_id)
