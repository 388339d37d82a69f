"""Dense positions and exact cut keys of an ordered table, without sending
all rows, or all rows of one hot group, through a single task.

The order keys are cut into cells at sampled quantiles. The cell of a row is
a function of its key alone, so it is the same in every scan and after a lost
task is recomputed. Cell counts give each cell's starting position; only the
inside of a cell is ordered by a window. A hot group is spread over the cells
like every other row, so no window sees more than about one cell of rows.

``order_by`` must be a total order: end it with a unique column.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this many rows one task may order a whole table.
ROWS_PER_CELL = 100_000
# A larger table is cut into at least so many cells, to spread the ordering.
MIN_CELLS = 32
MAX_CELLS = 32_768
# Sampled keys per cell: the driver sees at most MAX_CELLS times this many.
SAMPLED_PER_CELL = 32


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}L"
    if isinstance(value, float):
        return f"double('{value!r}')"
    if isinstance(value, decimal.Decimal):
        return f"{value}BD"
    if isinstance(value, (dt.datetime, dt.date)):
        return f"'{value.isoformat(sep=' ') if isinstance(value, dt.datetime) else value.isoformat()}'"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def _literal_array(values: Sequence, type_name: str) -> Column:
    body = ", ".join(_literal(v) for v in values)
    return F.expr(f"cast(array({body}) as array<{type_name}>)")


def count_reached(df: DataFrame, order_by: Sequence[str], bounds: Sequence[tuple]) -> Column:
    """How many of the sorted ``bounds`` are at or below the row's key.

    A binary search written as a fold over the step sizes: log2(len(bounds))
    comparisons a row inside the JVM, and nothing is shuffled. Bounds may be
    prefixes of the key.
    """
    n = len(bounds)
    if n == 0:
        return F.lit(0)
    order_by = list(order_by)[: len(bounds[0])]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    arrays = [_literal_array([b[j] for b in bounds], types[c]) for j, c in enumerate(order_by)]
    steps = F.array(*[F.lit(1 << p) for p in range(n.bit_length() - 1, -1, -1)])

    def packed(values: list[Column]) -> Column:
        if len(values) == 1:
            return values[0]
        return F.struct(*[v.alias(f"k{j}") for j, v in enumerate(values)])

    def search(own: Column) -> Column:
        return F.aggregate(
            steps,
            F.lit(0),
            lambda done, step: F.when(
                (done + step <= F.lit(n))
                & (own >= packed([F.get(a, done + step - 1) for a in arrays])),
                done + step,
            ).otherwise(done),
        )

    # The one-element array makes the key a lambda variable: a key that is an
    # md5 is computed once a row, not once a comparison.
    return F.get(F.transform(F.array(packed([F.col(c) for c in order_by])), search), F.lit(0))


def hashed_cell(df: DataFrame, key: str) -> Column:
    """Cell of a 60-bit random order key: its leading bits.

    Hashes are spread evenly, so no sampling is needed; the number of cells
    follows the shuffle width.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(15, max(6, (8 * width).bit_length() - 1))
    return F.shiftright(F.col(key), 60 - bits).cast("int")


def _in_spark_order(key: tuple) -> tuple:
    """Sort key for Python: nulls first and NaN last, as Spark orders them."""
    return tuple((v is not None, v != v, v) for v in key)


def sampled_bounds(
    df: DataFrame, order_by: Sequence[str], rows_per_cell: int = ROWS_PER_CELL
) -> tuple[int, list[tuple]]:
    """Row count and the sorted keys that start the second and later cells.

    Two passes over the key columns only. The sample that reaches the driver
    is bounded by ``MAX_CELLS * SAMPLED_PER_CELL`` keys, whatever the table.
    Bounds are cut to the shortest prefix of the key that tells them apart.
    """
    keys = df.select(*order_by)
    n = keys.count()
    if n <= rows_per_cell:
        return n, []
    cells = min(MAX_CELLS, max(MIN_CELLS, math.ceil(n / rows_per_cell)))
    fraction = min(1.0, cells * SAMPLED_PER_CELL / n)
    sample = sorted((tuple(r) for r in keys.sample(False, fraction, seed=17).collect()), key=_in_spark_order)
    picks = {sample[i * len(sample) // cells] for i in range(1, cells)} if sample else set()
    for width in range(1, len(order_by) + 1):
        prefixes = {p[:width] for p in picks}
        if len(prefixes) == len(picks):
            return n, sorted(prefixes, key=_in_spark_order)
    return n, sorted(picks, key=_in_spark_order)


def with_position(
    df: DataFrame,
    order_by: Sequence[str],
    within: Sequence[str] = (),
    name: str = "position",
    total: str | None = None,
    cell: Column | None = None,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Add the 0-based position of each row, overall or ``within`` a group.

    The key columns of ``df`` are read up to three times before the one pass
    that moves rows: hand in a table, or a checkpoint of an expensive plan.

    ``total`` names an extra column for the row count of the group. ``cell``
    may give a non-decreasing function of the order key with a known bound on
    rows per (group, cell); then no sampling job is run.
    """
    order_by, within = list(order_by), list(within)
    if cell is None:
        n, bounds = sampled_bounds(df, order_by, rows_per_cell)
        if not bounds:
            # The count proved that one cell holds the whole table.
            out = df.withColumn(
                name,
                F.row_number().over(Window.partitionBy(*within).orderBy(*order_by)).cast("bigint") - 1,
            )
            if total:
                out = out.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*within)))
            return out
        cell = count_reached(df, order_by, bounds)

    # A struct of the group columns is never null and equals itself when a field
    # is null. So counts and rows join by plain equality, on the very columns
    # the window is partitioned by: the rows are shuffled once for both.
    group = ["_group"] if within else []
    tagged = df.withColumn("_cell", cell)
    if within:
        tagged = tagged.withColumn("_group", F.struct(*within))
    counts = tagged.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = counts.select(
        *group,
        "_cell",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("bigint").alias("_start"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("_total"),
    )
    inside = Window.partitionBy(*group, "_cell").orderBy(*order_by)
    ranked = tagged.withColumn("_rank", F.row_number().over(inside) - 1)
    out = ranked.join(starts, [*group, "_cell"])
    out = out.withColumn(name, F.col("_start") + F.col("_rank"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_group", "_cell", "_rank", "_start", "_total")


def keys_at(
    df: DataFrame,
    order_by: Sequence[str],
    positions,
    rows_per_cell: int = ROWS_PER_CELL,
    cell: Column | None = None,
) -> tuple[int, list[tuple]]:
    """Row count, and the order keys found at the given 0-based positions.

    ``positions`` is a function of the row count. Only key columns are read,
    and only the cells that hold a wanted position are ordered. With the cut
    keys in hand a table is split by comparing keys: its rows never move.
    """
    order_by = list(order_by)
    keys = df.select(*order_by)
    if cell is None:
        n, bounds = sampled_bounds(keys, order_by, rows_per_cell)
        cell = count_reached(keys, order_by, bounds)
        known = None if bounds else {0: n}
    else:
        known = None
    tagged = keys.withColumn("_cell", cell)
    # one row per cell
    counts = known if known is not None else dict(tagged.groupBy("_cell").count().collect())
    n = sum(counts.values())
    wanted = sorted({p for p in positions(n) if 0 <= p < n})
    if not wanted:
        return n, []
    ranks: dict[int, list[int]] = {}
    start, todo = 0, iter(wanted)
    p = next(todo)
    for c in sorted(counts):
        while p is not None and p < start + counts[c]:
            ranks.setdefault(c, []).append(p - start)
            p = next(todo, None)
        start += counts[c]
    targets = df.sparkSession.createDataFrame(
        [(c, r) for c, rs in ranks.items() for r in rs], "_cell INT, _rank INT"
    )
    inside = Window.partitionBy("_cell").orderBy(*order_by)
    hits = (
        tagged.filter(F.col("_cell").isin(list(ranks)))
        .withColumn("_rank", F.row_number().over(inside) - 1)
        .join(targets, ["_cell", "_rank"], "left_semi")
        .select(*order_by)
    )
    return n, sorted((tuple(r) for r in hits.collect()), key=_in_spark_order)


def with_carried(
    df: DataFrame,
    within: Sequence[str],
    order_col: str,
    halo: int,
    span: int = 4096,
) -> tuple[DataFrame, list[str]]:
    """Prepare look-back windows over long groups.

    Returns rows with ``_block`` and ``_carried``, plus the window partition
    columns. A group is cut into blocks of ``span`` rows by position, and the
    last ``halo`` rows of each block are repeated at the head of the next one
    (``_carried`` = true; drop them after the window). A window over a block
    so finds the ``halo`` rows before every row of its own, and no task holds
    more than ``span + halo`` rows of a group. ``order_col`` is an integer,
    unique in its group, such as the round number.
    """
    within = list(within)
    span = max(span, halo)
    placed = with_position(
        df,
        [order_col],
        within,
        name="_pos",
        cell=F.floor(F.col(order_col) / F.lit(span)),
    )
    own = F.floor(F.col("_pos") / F.lit(span)).cast("bigint")
    tail = F.pmod(F.col("_pos"), F.lit(span)) >= F.lit(span - halo)
    out = (
        placed.withColumn("_own", own)
        .withColumn(
            "_block",
            F.explode(F.when(tail, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))),
        )
        .withColumn("_carried", F.col("_block") > F.col("_own"))
        .drop("_own")
    )
    return out, [*within, "_block"]
