"""Assignment of samples to shards, and the exact train / test split.

Assignments by rank look up a few cut keys (``keys_at``) and compare every
row's own key with them. The samples themselves, with their feature arrays,
are not shuffled: the shard is a map-side column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import order_key, shuffled
from .joins import spread_join
from .positions import ROWS_PER_CELL, count_reached, hashed_cell, keys_at, with_position

ID = "sample_id"


def with_dense_index(
    df: DataFrame, order_by: Sequence[str], name: str = "idx", rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """Position 0..N-1 over the whole table."""
    return with_position(df, order_by, name=name, rows_per_cell=rows_per_cell)


def _cut(
    df: DataFrame,
    order_by: Sequence[str],
    n: int,
    remainder: str,
    rows_per_cell: int,
    cell: Column | None = None,
) -> DataFrame:
    """Add ``_part`` 0..n-1: equal runs of the order, remainder last or dropped."""
    if n < 1:
        raise ValueError("at least one shard is needed")
    if remainder not in ("last", "drop"):
        raise ValueError(f"unknown remainder policy {remainder!r}")
    last_cut = n if remainder == "drop" else n - 1

    def wanted(total: int) -> list[int]:
        size = total // n
        return [i * size for i in range(1, last_cut + 1)] if size else []

    total, cuts = keys_at(df, order_by, wanted, rows_per_cell, cell)
    if total < n:
        # size 0: nothing for the first shards, all rows are remainder
        out = df.withColumn("_part", F.lit(n - 1))
        return out.limit(0) if remainder == "drop" else out
    out = df.withColumn("_part", count_reached(df, order_by, cuts).cast("int"))
    if remainder == "drop":
        out = out.filter(F.col("_part") < n)
    return out


def shard_contiguous(
    samples: DataFrame, n: int, remainder: str = "last", rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """Runs of ``N // n`` consecutive ids; the rest goes to the last shard or is dropped."""
    out = _cut(samples, [ID], n, remainder, rows_per_cell)
    return out.withColumnRenamed("_part", "shard_id")


def shard_iid(samples: DataFrame, n: int, seed=42) -> DataFrame:
    """``N // n`` samples each, drawn without replacement (a seeded permutation, cut)."""
    keyed = samples.withColumn("_key", order_key(F.col(ID), seed=seed))
    out = _cut(keyed, ["_key", ID], n, "drop", ROWS_PER_CELL, hashed_cell(keyed, "_key"))
    return out.withColumnRenamed("_part", "shard_id").drop("_key")


shard_permuted = shard_iid


def shard_noniid(
    samples: DataFrame,
    n: int,
    shards_per: int = 2,
    seed=42,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Sort by label, cut into ``n * shards_per`` blocks, deal blocks at random."""
    blocks = n * shards_per
    out = _cut(samples, ["label", ID], blocks, "drop", rows_per_cell)
    owner = [0] * blocks
    for rank, block in enumerate(shuffled(blocks, seed)):
        owner[block] = rank // shards_per
    owners = F.expr(f"array({', '.join(map(str, owner))})")
    return (
        out.withColumn("shard_id", F.get(owners, F.col("_part")))
        .withColumnRenamed("_part", "block_id")
    )


def shard_modulo(samples: DataFrame, n: int, by: str = "label") -> DataFrame:
    """``key % n`` of the label, or of the sample index."""
    columns = {"label": "label", "index": ID}
    if by not in columns:
        raise ValueError(f"by must be 'label' or 'index', not {by!r}")
    return samples.withColumn("shard_id", F.pmod(F.col(columns[by]), F.lit(n)).cast("int"))


def train_test_split(samples: DataFrame, test_size: int, seed=42) -> DataFrame:
    """Add ``is_test``, true for exactly ``test_size`` rows."""
    keyed = samples.withColumn("_key", order_key(F.col(ID), seed=seed))
    total, cut = keys_at(
        keyed, ["_key", ID], lambda n: [test_size], cell=hashed_cell(keyed, "_key")
    )
    if test_size > total:
        raise ValueError(f"test_size {test_size} is larger than the table ({total} rows)")
    is_test = F.lit(True) if not cut else count_reached(keyed, ["_key", ID], cut) == 0
    return keyed.withColumn("is_test", is_test).drop("_key")


def to_local_index(
    samples: DataFrame,
    assignment: DataFrame | None = None,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Index of each sample inside its shard; samples without a shard are dropped."""
    owned = samples if assignment is None else samples.join(
        assignment.select(ID, "shard_id"), ID
    )
    return with_position(
        owned.filter(F.col("shard_id").isNotNull()),
        [ID],
        within=["shard_id"],
        name="local_index",
        rows_per_cell=rows_per_cell,
    )


def shard_stats(samples: DataFrame) -> DataFrame:
    """Per shard: size, feature range, label range, number of classes."""
    return samples.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.min(F.array_min("features")).alias("feature_min"),
        F.max(F.array_max("features")).alias("feature_max"),
        F.min("label").alias("label_min"),
        F.max("label").alias("label_max"),
        F.count_distinct("label").alias("n_classes"),
    )


def class_histogram(samples: DataFrame, class_names: Sequence[str] | None = None) -> DataFrame:
    """Per shard and label: number of samples, with the class name if given."""
    out = samples.groupBy("shard_id", "label").agg(F.count(F.lit(1)).alias("n_samples"))
    if class_names is not None:
        names = F.array(*[F.lit(c) for c in class_names])
        out = out.withColumn("class_name", F.get(names, F.col("label")))
    return out


def verify_shards(samples: DataFrame, shards: DataFrame, expected_total: int | None = None) -> DataFrame:
    """One row per expected shard with its size, and whether the set is complete."""
    sizes = samples.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_samples"))
    found = (
        shards.select("shard_id")
        .join(sizes, "shard_id", "left")
        .withColumn("n_samples", F.coalesce("n_samples", F.lit(0).cast("bigint")))
    )
    everything = Window.partitionBy()  # one row per expected shard
    total = F.sum("n_samples").over(everything)
    complete = F.bool_and(F.col("n_samples") > 0).over(everything)
    if expected_total is not None:
        complete = complete & (total == F.lit(expected_total))
    return found.select(
        "shard_id",
        "n_samples",
        (F.col("n_samples") > 0).alias("present"),
        total.alias("total_samples"),
        complete.alias("valid"),
    )


def with_equal_units(samples: DataFrame, units_per_shard: int = 1) -> DataFrame:
    """Split every shard into ``units_per_shard`` training units by a hash of the sample id.

    The number is the caller's and looks at no size, so the same samples are in
    the same unit whatever else their shard holds. Nothing is counted or moved.
    """
    if units_per_shard < 1:
        raise ValueError("units_per_shard must be positive")
    unit = F.pmod(F.xxhash64(F.col(ID)), F.lit(units_per_shard)).cast("int")
    return samples.withColumn("unit", F.lit(0) if units_per_shard == 1 else unit)


def with_unit(
    samples: DataFrame, unit_rows: int, key: str = "shard_id", sizes: DataFrame | None = None
) -> DataFrame:
    """Split every shard into units of about ``unit_rows`` rows, where a caller asks for a size.

    A shard at or below the limit is one unit. A larger one is split by a hash
    of the sample id into ``ceil(n / unit_rows)`` units, so a shard of any size
    never has to fit into one task. ``sizes`` may hold the rows per shard
    (``n_samples``) where they are known.
    """
    if sizes is None:
        sizes = samples.groupBy(key).agg(F.count(F.lit(1)).alias("n_samples"))
    units = sizes.select(
        key, F.ceil(F.col("n_samples") / F.lit(unit_rows)).cast("int").alias("_units")
    )
    return (
        spread_join(samples, units, [key], nulls=True)
        .withColumn("unit", F.pmod(F.xxhash64(F.col(ID)), F.col("_units")).cast("int"))
        .drop("_units")
    )


def colocate(
    samples: DataFrame,
    n: int,
    unit_rows: int | None = None,
    sort_by: Sequence[str] = (),
    sizes: DataFrame | None = None,
    units_per_shard: int = 1,
) -> DataFrame:
    """Bring each unit of each shard together in one of ``n`` Spark partitions.

    With one unit per shard, whatever its size, a shard lies in one partition.
    A shard that must be spread is cut into ``units_per_shard`` units, or into
    units of about ``unit_rows`` rows if that is given. Ranges of (shard, unit)
    carry about equally many rows, where hashes of few keys would collide.
    Grouping by shard and unit needs no further shuffle; cache the result to
    reuse the layout.
    """
    keys = ["shard_id", "unit"]
    if unit_rows is None:
        units = with_equal_units(samples, units_per_shard)
    else:
        units = with_unit(samples, unit_rows, sizes=sizes)
    return (
        units
        .repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys, *sort_by)
    )
