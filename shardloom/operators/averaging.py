"""Averaging of updates, quorum rules and round accounting.

Vectors are reduced by (round, layer, position) hash aggregation: partial sums
are formed where the updates are, and no task or driver holds all updates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import valid_updates
from .joins import join_on, small_side, spread_join


def _group(df: DataFrame) -> list[str]:
    return [c for c in ("round", "layer") if c in df.columns]


def _positions(updates: DataFrame, *carry: str) -> DataFrame:
    return updates.select(
        *_group(updates), *carry, F.posexplode("weights").alias("pos", "value")
    )


def average_weighted(updates: DataFrame) -> DataFrame:
    """``sum(n * w) / sum(n)`` per parameter over the valid updates."""
    rows = _positions(valid_updates(updates), "n_samples")
    return rows.groupBy(*_group(updates), "pos").agg(
        # null, not an error, where all updates are of no samples
        F.try_divide(F.sum(F.col("n_samples") * F.col("value")), F.sum("n_samples")).alias("value")
    )


def average_stacked(updates: DataFrame) -> DataFrame:
    """Plain mean per parameter, no structure check."""
    return (
        _positions(updates.filter(F.col("weights").isNotNull()))
        .groupBy(*_group(updates), "pos")
        .agg(F.avg("value").alias("value"))
    )


def average_unweighted(updates: DataFrame, expected_layers: Sequence[str]) -> DataFrame:
    """Plain mean over the updates whose set of layers is the expected one.

    ``updates`` has one row per (round, shard_id, layer). An update with a
    missing or an extra layer is skipped and not counted.
    """
    keys = [c for c in ("round", "shard_id") if c in updates.columns]
    layers = sorted(set(expected_layers))
    present = updates.filter(F.col("weights").isNotNull())
    expected = F.array(*[F.lit(x) for x in layers])
    # Two counts decide set equality, so the layer names are never collected.
    matching = (
        present.groupBy(*keys, "layer").agg(F.count(F.lit(1)).alias("_rows"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_layers"),
            F.count_if(F.array_contains(expected, F.col("layer"))).alias("_known"),
        )
        .filter((F.col("_layers") == len(layers)) & (F.col("_known") == len(layers)))
        .select(*keys)
    )
    return average_stacked(spread_join(present, matching, keys, "left_semi"))


def average_typed(updates: DataFrame, model_layers: DataFrame) -> DataFrame:
    """Weighted mean, cast back to the layer's type (integers are truncated once)."""
    mean = average_weighted(updates)
    typed = spread_join(mean, model_layers.select("layer", "dtype"), ["layer"])
    # Weighted means of equal integers can come out a hair below the integer.
    whole = F.round("value", 9)
    truncated = F.when(whole >= 0, F.floor(whole)).otherwise(F.ceil(whole)).cast("double")
    value = (
        F.when(F.col("dtype").startswith("int"), truncated)
        .when(F.col("dtype") == "float32", F.col("value").cast("float").cast("double"))
        .otherwise(F.col("value"))
    )
    return typed.withColumn("value", value).select(*mean.columns, "dtype")


def apply_quorum(
    updates: DataFrame, previous: DataFrame, policy: str = "any", expected: int | None = None
) -> DataFrame:
    """The averaged model of each round, or the previous one where the quorum fails.

    ``any`` needs one valid update with samples, ``all`` needs every expected
    shard. ``previous`` holds, per round, the model the round started from.
    A round without any update row keeps its previous model too.
    """
    if policy not in ("any", "all"):
        raise ValueError(f"unknown quorum policy {policy!r}")
    if policy == "all" and expected is None:
        raise ValueError("policy 'all' needs the number of expected shards: a silent one sends no row")
    good = F.coalesce(F.col("status") == "success", F.lit(False)) & F.col("weights").isNotNull()
    shards = updates.groupBy("round", "shard_id").agg(
        F.max(good.cast("int")).alias("_good"),
        F.max(F.when(good, F.col("n_samples")).otherwise(F.lit(0))).alias("_n"),
    )
    met = (F.sum("_good") >= 1) & (F.sum("_n") > 0)
    if policy == "all":
        met = met & (F.sum("_good") >= F.lit(expected))
    accepted = shards.groupBy("round").agg(met.alias("_met")).filter("_met").select("round")
    accepted = small_side(accepted) or accepted
    new = average_weighted(updates).join(accepted, "round", "left_semi")
    columns = [c for c in ("round", "layer", "pos", "value") if c in new.columns]
    kept = previous.join(accepted, "round", "left_anti")
    return (
        new.select(*columns, F.lit("averaged").alias("source"))
        .unionByName(kept.select(*columns, F.lit("kept").alias("source")))
    )


def round_accounting(updates: DataFrame, expected: int | DataFrame) -> DataFrame:
    """Per round: received, valid, failed, failed ids, samples, mean rate and loss.

    One row per (round, shard) first; the failed ids listed are at most the
    number of shards. A shard that sent nothing counts as failed. Where ``expected``
    is a table of (round, shard_id), it is listed by its id as well, a round in which
    all are silent has a row, and shards that were not expected do not count.
    """
    good = F.coalesce(F.col("status") == "success", F.lit(False)) & F.col("weights").isNotNull()
    extra = {c: F.col(c) if c in updates.columns else F.lit(None).cast("double") for c in ("lr", "avg_loss")}
    rows = updates.withColumns(extra)
    shards = rows.groupBy("round", "shard_id").agg(
        F.max(good.cast("int")).alias("_good"),
        F.max(F.when(good, F.col("n_samples"))).alias("_n"),
        F.avg(F.when(good, F.col("lr"))).alias("_lr"),
        F.avg(F.when(good, F.col("avg_loss"))).alias("_loss"),
    )
    shards = shards.withColumn("_received", F.lit(1))
    total = F.count(F.lit(1)) if isinstance(expected, DataFrame) else F.lit(expected)
    if isinstance(expected, DataFrame):
        known = expected.select("round", "shard_id").distinct()
        shards = known.join(shards, ["round", "shard_id"], "left").na.fill(0, ["_good"])
    valid = F.sum("_good")
    return shards.groupBy("round").agg(
        F.count("_received").alias("received"),
        valid.cast("bigint").alias("valid"),
        (total - valid).cast("bigint").alias("failed"),
        F.array_join(
            F.array_sort(F.collect_list(F.when(F.col("_good") == 0, F.col("shard_id")))), ","
        ).alias("failed_ids"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total_samples"),
        F.avg("_lr").alias("mean_lr"),
        F.avg("_loss").alias("mean_loss"),
    )


def vector_sum_mean(updates: DataFrame, denominator: str = "selected", selected: DataFrame | None = None) -> DataFrame:
    """Element-wise sum divided by the number selected, or the number received."""
    sums = _positions(updates.filter(F.col("weights").isNotNull()))
    keys = _group(updates)
    summed = sums.groupBy(*keys, "pos").agg(
        F.sum("value").alias("_sum"), F.count(F.lit(1)).alias("_received")
    )
    if denominator == "received":
        return summed.select(*keys, "pos", (F.col("_sum") / F.col("_received")).alias("value"))
    if denominator != "selected" or selected is None:
        raise ValueError("denominator is 'received', or 'selected' with a selected table")
    by = [c for c in keys if c in selected.columns]
    if not by:
        n_selected = selected.agg(F.count(F.lit(1))).scalar()
        return summed.select(*keys, "pos", (F.col("_sum") / n_selected).alias("value"))
    counts = selected.groupBy(*by).agg(F.count(F.lit(1)).alias("_selected"))
    return join_on(summed, counts, by).select(
        *keys, "pos", (F.col("_sum") / F.col("_selected")).alias("value")
    )


def average_runs(ledgers: DataFrame, values: Sequence[str] = ("timestamp", "accuracy", "loss")) -> DataFrame:
    """Mean over repeated runs, per method and round."""
    return ledgers.groupBy("method", "round").agg(
        F.count(F.lit(1)).alias("n_runs"), *[F.avg(v).alias(v) for v in values]
    )


def as_vector(model: DataFrame, *by: str) -> DataFrame:
    """(.., pos, value) rows back to one array per group; bounded by the model size."""
    packed = F.array_sort(F.collect_list(F.struct("pos", "value")))
    values = F.transform(packed, lambda p: p.getField("value"))
    return model.groupBy(*by).agg(values.alias("weights"))


