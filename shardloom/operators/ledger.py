"""Round-ledger analytics: look-back windows and fault-window aggregates.

Values of single rounds are conditional aggregates, which shuffle one partial
row per run. Row-wise results look back over blocks (``with_carried``), so a
run of any length is spread over tasks. Rounds are picked by their number,
never by row position, since a ledger may miss rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_on
from .positions import with_carried, with_position

RUN = ("method", "mode")


def _run(ledger: DataFrame, by: Sequence[str] | None) -> list[str]:
    return [c for c in (by if by is not None else RUN) if c in ledger.columns]


def _look_back(ledger: DataFrame, by, halo: int, span: int, build) -> DataFrame:
    rows, partition = with_carried(ledger, _run(ledger, by), "round", halo, span)
    window = Window.partitionBy(*partition).orderBy("_pos")
    return build(rows, window).filter(~F.col("_carried")).drop("_carried", "_block", "_pos")


def round_duration(ledger: DataFrame, by=None, span: int = 4096) -> DataFrame:
    """Seconds since the previous round; the first round keeps its own time."""
    return _look_back(
        ledger, by, 1, span,
        lambda rows, w: rows.withColumn(
            "duration",
            F.col("timestamp") - F.coalesce(F.lag("timestamp").over(w), F.lit(0.0)),
        ),
    )


def round_delta(ledger: DataFrame, cols: Sequence[str] = ("accuracy", "loss"), by=None, span: int = 4096) -> DataFrame:
    """Change against the previous round, 0 in the first."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return _look_back(
        ledger, by, 1, span,
        lambda rows, w: rows.withColumns(
            {f"{c}_delta": F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) for c in cols}
        ),
    )


def rolling_mean(ledger: DataFrame, col: str = "accuracy", w: int = 3, by=None, span: int = 4096) -> DataFrame:
    """Mean of the last ``w`` rounds, null before there are ``w``."""

    def build(rows: DataFrame, window) -> DataFrame:
        frame = window.rowsBetween(-(w - 1), 0)
        full = F.count(F.lit(1)).over(frame) == w
        return rows.withColumn(f"{col}_rolling", F.when(full, F.avg(col).over(frame)))

    return _look_back(ledger, by, w - 1, span, build)


def final_metrics(ledger: DataFrame, by=None) -> DataFrame:
    return ledger.groupBy(*_run(ledger, by)).agg(
        F.count(F.lit(1)).alias("n_rounds"),
        F.max("round").alias("last_round"),
        F.max_by("accuracy", "round").alias("final_accuracy"),
        F.max_by("loss", "round").alias("final_loss"),
        F.max_by("timestamp", "round").alias("total_time"),
    )


def convergence_round(ledger: DataFrame, threshold: float = 85.0, by=None) -> DataFrame:
    """One more than the rounds below the threshold, at most the round count."""
    below = F.count_if(F.col("accuracy") < F.lit(float(threshold)))
    return ledger.groupBy(*_run(ledger, by)).agg(
        F.least(below + 1, F.count(F.lit(1))).alias("convergence_round")
    )


def _at(col: str, round_no: int) -> Column:
    return F.max(F.when(F.col("round") == round_no, F.col(col)))


def fault_window(ledger: DataFrame, fault_round: int, by=None) -> DataFrame:
    k = fault_round
    before, at, after = _at("accuracy", k - 1), _at("accuracy", k), _at("accuracy", k + 1)
    return ledger.groupBy(*_run(ledger, by)).agg(
        before.alias("before"),
        at.alias("at"),
        after.alias("after"),
        (before - at).alias("drop"),
        (after - at).alias("gain"),
        (after > before).alias("recovered"),
    )


def recovery_time(ledger: DataFrame, fault_round: int, by=None) -> DataFrame:
    """Seconds of the fault round and of the next; the time before round 1 is 0."""
    k = fault_round
    start = F.coalesce(_at("timestamp", k - 1), F.lit(0.0))
    at, after = _at("timestamp", k), _at("timestamp", k + 1)
    return ledger.groupBy(*_run(ledger, by)).agg(
        (at - start).alias("fault_round_time"),
        (after - at).alias("next_round_time"),
        F.max_by("timestamp", "round").alias("total_time"),
    )


def normal_duration(ledger: DataFrame, fault_round: int, how: str = "after", by=None) -> DataFrame:
    keys = _run(ledger, by)
    k = fault_round
    if how == "after":
        spent = F.max_by("timestamp", "round") - _at("timestamp", k)
        return ledger.groupBy(*keys).agg(
            F.try_divide(spent, F.count(F.lit(1)) - F.lit(k)).alias("normal_duration")
        )
    if how != "exclude":
        raise ValueError(f"how must be 'after' or 'exclude', not {how!r}")
    return (
        round_duration(ledger, by)
        .groupBy(*keys)
        .agg(
            F.avg(F.when(~F.col("round").isin(k, k + 1), F.col("duration"))).alias("normal_duration")
        )
    )


def duration_stats(ledger: DataFrame, by=None) -> DataFrame:
    """Interval statistics without the first round, and accuracy landmarks."""
    keys = _run(ledger, by)
    timed = round_duration(ledger, by)
    placed = with_position(
        timed, ["round"], keys, name="_at", total="_n", cell=F.floor(F.col("round") / F.lit(4096))
    )
    interval = F.when(F.col("_at") > 0, F.col("duration"))
    first, last = F.min_by("accuracy", "round"), F.max_by("accuracy", "round")
    return placed.groupBy(*keys).agg(
        F.avg(interval).alias("mean_duration"),
        F.min(interval).alias("min_duration"),
        F.max(interval).alias("max_duration"),
        F.stddev_pop(interval).alias("std_duration"),
        F.max("accuracy").alias("peak_accuracy"),
        F.min("accuracy").alias("lowest_accuracy"),
        first.alias("first_accuracy"),
        F.max(
            F.when(F.col("_at") == F.floor(F.col("_n") / 2), F.col("accuracy"))
        ).alias("middle_accuracy"),
        last.alias("last_accuracy"),
        (last - first).alias("improvement"),
    )



def compare_methods(ledger: DataFrame, a: str, b: str) -> DataFrame:
    """Final results of two methods in one row; one pass over both."""
    m = F.col("method")

    def last(col: str, method: str) -> Column:
        return F.max_by(F.when(m == method, F.col(col)), F.when(m == method, F.col("round")))

    def rounds(method: str) -> Column:
        return F.count_if(m == method)

    both = ledger.filter(m.isin(a, b)).agg(
        last("accuracy", a).alias("accuracy_a"),
        last("accuracy", b).alias("accuracy_b"),
        last("timestamp", a).alias("time_a"),
        last("timestamp", b).alias("time_b"),
        rounds(a).alias("rounds_a"),
        rounds(b).alias("rounds_b"),
    )
    ta, tb = F.col("time_a"), F.col("time_b")
    return both.select(
        "*",
        (F.col("accuracy_b") - F.col("accuracy_a")).alias("accuracy_diff"),
        F.when(tb > 0, ta / tb).otherwise(F.lit(0.0)).alias("time_ratio"),
        (F.col("rounds_b") - F.col("rounds_a")).alias("rounds_diff"),
        F.when(ta > 0, (ta - tb) / ta * 100).otherwise(F.lit(0.0)).alias("time_advantage"),
    )


def compare_fault(ledger: DataFrame, a: str, b: str, fault_round: int) -> DataFrame:
    """Fault-round figures of two methods, one row per figure."""
    k = fault_round
    m = F.col("method")

    def at(col: str, r: int, method: str) -> Column:
        return F.max(F.when((m == method) & (F.col("round") == r), F.col(col)))

    def figures(method: str, side: str) -> list[Column]:
        start = F.coalesce(at("timestamp", k - 1, method), F.lit(0.0))
        return [
            (at("timestamp", k, method) - start).alias(f"time_{side}"),
            (at("accuracy", k - 1, method) - at("accuracy", k, method)).alias(f"drop_{side}"),
            (at("timestamp", k + 1, method) - at("timestamp", k, method)).alias(f"delay_{side}"),
        ]

    both = ledger.filter(m.isin(a, b)).agg(*figures(a, "a"), *figures(b, "b"))
    return both.selectExpr(
        "stack(3, 'fault_round_time', time_a, time_b, 'accuracy_drop', drop_a, drop_b, "
        "'recovery_delay', delay_a, delay_b) as (metric, a, b)"
    )


def align_rounds(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two ledgers side by side; a round may be missing on either."""
    cols = ["accuracy", "loss", "timestamp"]
    left = a.select("round", *[F.col(c).alias(f"{c}_a") for c in cols])
    right = b.select("round", *[F.col(c).alias(f"{c}_b") for c in cols])
    return left.join(right, "round", "full_outer")


def tolerated(ledger: DataFrame, fault_round: int, limit: float = 1.0, by=None) -> DataFrame:
    keys = _run(ledger, by)
    return fault_window(ledger, fault_round, by).select(
        *keys, "drop", (F.abs("drop") < F.lit(float(limit))).alias("tolerated")
    )


def last_rounds(ledger: DataFrame, n: int = 5, by=None) -> DataFrame:
    """The last ``n`` rows of each run, with the run's round count.

    The rank filter is pushed into a per-task group limit before the shuffle.
    """
    keys = _run(ledger, by)
    newest = Window.partitionBy(*keys).orderBy(F.col("round").desc())
    top = ledger.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= n)
    counts = ledger.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rounds"))
    return join_on(top, counts, keys)


def comparison_report(ledger: DataFrame, a: str, b: str, fault_round: int) -> DataFrame:
    """The summary table of two methods: metric, a, b, change (b - a)."""
    final = compare_methods(ledger, a, b).selectExpr(
        "stack(3, 'final_accuracy', accuracy_a, accuracy_b, 'total_time', time_a, time_b, "
        "'rounds', cast(rounds_a as double), cast(rounds_b as double)) as (metric, a, b)"
    )
    fault = compare_fault(ledger, a, b, fault_round)
    return final.unionByName(fault).withColumn("change", F.col("b") - F.col("a"))
