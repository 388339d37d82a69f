"""Joins whose sides are checked: broadcast what proved small, spread hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 100_000
# Parts a hot key is spread over when the other side is too large for that.
SALTS = 16


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """The side as a broadcast if it has at most ``max_rows`` rows, else None.

    The size of an aggregate is unknown when a plan is made, and the large side
    would be shuffled on what may be a hot key before the small size shows. So
    the side is read first, up to the limit.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], nulls: bool) -> Column:
    tests = [
        left[k].eqNullSafe(right[f"__{k}"]) if nulls else left[k] == right[f"__{k}"] for k in keys
    ]
    cond = tests[0]
    for t in tests[1:]:
        cond = cond & t
    return cond


def join_on(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", nulls: bool = True
) -> DataFrame:
    """Equi-join in which a null key matches a null key; no side is forced."""
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns]
    )
    joined = left.join(renamed, _same(left, renamed, keys, nulls), how)
    return joined.drop(*[f"__{k}" for k in keys])


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    nulls: bool = False,
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join a large left side, some of whose keys may be hot, to a smaller right.

    A right side that proves small is broadcast and the left stays where it is.
    Otherwise each right row is repeated once per salt and the left rows of a
    key are spread over the salts by a hash of the row, which tells rows of one
    key apart by their id.
    """
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns]
    )
    small = small_side(renamed, max_rows)
    if small is not None:
        return left.join(small, _same(left, small, keys, nulls), how).drop(
            *[f"__{k}" for k in keys]
        )
    hashable = [c for c, kind in left.dtypes if "map<" not in kind]
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(salts)))
    repeated = renamed.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    )
    cond = _same(salted, repeated, keys, nulls) & (salted["_salt"] == repeated["__salt"])
    return salted.join(repeated, cond, how).drop("_salt", "__salt", *[f"__{k}" for k in keys])
