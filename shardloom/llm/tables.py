"""Reading, checkpointing and splitting tables, shared by the operators of this package."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus))


def held_out(doc_id: Column, modulus: int, value: int) -> Column:
    """True for the held-out fold. A row without an id is in no fold: false here, and
    never learned from, because ``remainder`` is null."""
    return F.coalesce(remainder(doc_id, modulus) == value, F.lit(False))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written as a table below the shared folder and read back.

    Cuts the lineage and survives lost executors; later reads take only the columns they use.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(rows: int, per_part: int, least: int = 1) -> int:
    """Partitions so that each has about ``per_part`` rows."""
    return max(least, math.ceil(rows / per_part))
