"""I: round-ledger analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.operators import ledger as L

from .views import ledger, with_views

# Times are whole microseconds: six digits never round at a tie.
_DOUBLES = 6


def _rounded(df):
    return df.withColumns(
        {f.name: F.round(f.name, _DOUBLES) for f in df.schema if f.dataType.typeName() == "double"}
    )


def _runs(df):
    return _rounded(df.drop("mode"))


def i1(spark, d):
    return _runs(L.round_duration(ledger(spark, d))).select("round", "method", "duration")


def i2(spark, d):
    rows = L.round_delta(ledger(spark, d), ["accuracy", "loss"])
    return _runs(rows).select("round", "method", "accuracy_delta", "loss_delta")


def i3(spark, d):
    rows = L.rolling_mean(ledger(spark, d), "accuracy", 3)
    return _runs(rows).select("round", "method", "accuracy_rolling")


def i4(spark, d):
    return _runs(L.final_metrics(ledger(spark, d)))


def i5(spark, d):
    return _runs(L.convergence_round(ledger(spark, d), 80.0))


def i6(spark, d):
    return _runs(L.fault_window(ledger(spark, d), 8))


def i7(spark, d):
    return _runs(L.recovery_time(ledger(spark, d), 8))


def i8_after(spark, d):
    return _runs(L.normal_duration(ledger(spark, d), 8, "after"))


def i8_exclude(spark, d):
    return _runs(L.normal_duration(ledger(spark, d), 8, "exclude"))


def i9(spark, d):
    return _runs(L.duration_stats(ledger(spark, d)))


def i10(spark, d):
    return _rounded(L.compare_methods(ledger(spark, d), "a", "b"))


def i11(spark, d):
    return _rounded(L.compare_fault(ledger(spark, d), "a", "b", 8))


def i13(spark, d):
    rows = ledger(spark, d)
    # rounds missing on either side
    a = rows.filter("method = 'a' AND accuracy < 80.3")
    b = rows.filter("method = 'b' AND accuracy > 79.7")
    return _rounded(L.align_rounds(a, b))


def i14(spark, d):
    return _runs(L.tolerated(ledger(spark, d), 8, limit=1.0))


def i15(spark, d):
    return _runs(L.last_rounds(ledger(spark, d), 5))


QUERIES = {
    "i1_round_duration": i1,
    "i2_round_delta": i2,
    "i3_rolling_mean": i3,
    "i4_final_metrics": i4,
    "i5_convergence_round": i5,
    "i6_fault_window": i6,
    "i7_recovery_time": i7,
    "i8_normal_duration_after": i8_after,
    "i8_normal_duration_exclude": i8_exclude,
    "i9_duration_stats": i9,
    "i10_compare_methods": i10,
    "i11_compare_fault": i11,
    "i13_align_rounds": i13,
    "i14_tolerated": i14,
    "i15_last_rounds": i15,
}

_W = "OVER (PARTITION BY method ORDER BY round)"
_TIMED = f"""SELECT *, timestamp - coalesce(lag(timestamp) {_W}, 0) AS duration,
    row_number() {_W} - 1 AS i, count(*) OVER (PARTITION BY method) AS n FROM ledger"""


def _sql(query: str, **extra: str) -> str:
    return with_views(query, "ledger", timed=_TIMED, **extra)


def _at(col: str, r: int) -> str:
    return f"max({col}) FILTER (round = {r})"


def _side(col: str, r: int, m: str) -> str:
    return f"max({col}) FILTER (round = {r} AND method = '{m}')"


def _figure(name: str, col: str, plus: int, minus: int) -> str:
    a, b = (f"{_side(col, plus, m)} - {_side(col, minus, m)}" for m in "ab")
    return f"SELECT '{name}' AS metric, round({a}, 6) AS a, round({b}, 6) AS b FROM ledger"


ORACLE = {
    "i1_round_duration": _sql("SELECT round, method, round(duration, 6) AS duration FROM timed"),
    "i2_round_delta": _sql(
        f"""SELECT round, method, round(coalesce(accuracy - lag(accuracy) {_W}, 0), 6) AS accuracy_delta,
        round(coalesce(loss - lag(loss) {_W}, 0), 6) AS loss_delta FROM ledger"""
    ),
    "i3_rolling_mean": _sql(
        """SELECT round, method, round(CASE WHEN i >= 2 THEN avg(accuracy) OVER (PARTITION BY method
        ORDER BY round ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END, 6) AS accuracy_rolling FROM timed"""
    ),
    "i4_final_metrics": _sql(
        """SELECT method, count(*) AS n_rounds, max(round) AS last_round,
        round(max_by(accuracy, round), 6) AS final_accuracy, round(max_by(loss, round), 6) AS final_loss,
        round(max_by(timestamp, round), 6) AS total_time FROM ledger GROUP BY 1"""
    ),
    "i5_convergence_round": _sql(
        """SELECT method, least(count(*) FILTER (accuracy < 80) + 1, count(*)) AS convergence_round
        FROM ledger GROUP BY 1"""
    ),
    "i6_fault_window": _sql(
        f"""SELECT method, round({_at('accuracy', 7)}, 6) AS before, round({_at('accuracy', 8)}, 6) AS at,
        round({_at('accuracy', 9)}, 6) AS after, round({_at('accuracy', 7)} - {_at('accuracy', 8)}, 6) AS drop,
        round({_at('accuracy', 9)} - {_at('accuracy', 8)}, 6) AS gain,
        {_at('accuracy', 9)} > {_at('accuracy', 7)} AS recovered FROM ledger GROUP BY 1"""
    ),
    "i7_recovery_time": _sql(
        f"""SELECT method, round({_at('timestamp', 8)} - {_at('timestamp', 7)}, 6) AS fault_round_time,
        round({_at('timestamp', 9)} - {_at('timestamp', 8)}, 6) AS next_round_time,
        round(max_by(timestamp, round), 6) AS total_time FROM ledger GROUP BY 1"""
    ),
    "i8_normal_duration_after": _sql(
        f"""SELECT method, round((max_by(timestamp, round) - {_at('timestamp', 8)}) / (count(*) - 8), 6)
        AS normal_duration FROM ledger GROUP BY 1"""
    ),
    "i8_normal_duration_exclude": _sql(
        """SELECT method, round(avg(duration) FILTER (round NOT IN (8, 9)), 6) AS normal_duration
        FROM timed GROUP BY 1"""
    ),
    "i9_duration_stats": _sql(
        """SELECT method, round(avg(duration) FILTER (i > 0), 6) AS mean_duration,
        round(min(duration) FILTER (i > 0), 6) AS min_duration,
        round(max(duration) FILTER (i > 0), 6) AS max_duration,
        round(stddev_pop(duration) FILTER (i > 0), 6) AS std_duration,
        round(max(accuracy), 6) AS peak_accuracy, round(min(accuracy), 6) AS lowest_accuracy,
        round(min_by(accuracy, round), 6) AS first_accuracy,
        round(max(accuracy) FILTER (i = n // 2), 6) AS middle_accuracy,
        round(max_by(accuracy, round), 6) AS last_accuracy,
        round(max_by(accuracy, round) - min_by(accuracy, round), 6) AS improvement
        FROM timed GROUP BY 1"""
    ),
    "i10_compare_methods": _sql(
        """SELECT round(a.acc, 6) AS accuracy_a, round(b.acc, 6) AS accuracy_b, round(a.t, 6) AS time_a,
        round(b.t, 6) AS time_b, a.n AS rounds_a, b.n AS rounds_b, round(b.acc - a.acc, 6) AS accuracy_diff,
        round(a.t / b.t, 6) AS time_ratio, b.n - a.n AS rounds_diff,
        round((a.t - b.t) / a.t * 100, 6) AS time_advantage
        FROM (SELECT * FROM final WHERE method = 'a') a, (SELECT * FROM final WHERE method = 'b') b""",
        final="""SELECT method, max_by(accuracy, round) AS acc, max_by(timestamp, round) AS t,
        count(*) AS n FROM ledger GROUP BY 1""",
    ),
    "i11_compare_fault": _sql(
        " UNION ALL ".join(
            [
                _figure("fault_round_time", "timestamp", 8, 7),
                _figure("accuracy_drop", "accuracy", 7, 8),
                _figure("recovery_delay", "timestamp", 9, 8),
            ]
        )
    ),
    "i13_align_rounds": _sql(
        """SELECT coalesce(a.round, b.round) AS round, round(a.accuracy, 6) AS accuracy_a,
        round(a.loss, 6) AS loss_a, round(a.timestamp, 6) AS timestamp_a, round(b.accuracy, 6) AS accuracy_b,
        round(b.loss, 6) AS loss_b, round(b.timestamp, 6) AS timestamp_b
        FROM (SELECT * FROM ledger WHERE method = 'a' AND accuracy < 80.3) a
        FULL OUTER JOIN (SELECT * FROM ledger WHERE method = 'b' AND accuracy > 79.7) b ON a.round = b.round"""
    ),
    "i14_tolerated": _sql(
        f"""SELECT method, round({_at('accuracy', 7)} - {_at('accuracy', 8)}, 6) AS drop,
        abs({_at('accuracy', 7)} - {_at('accuracy', 8)}) < 1 AS tolerated FROM ledger GROUP BY 1"""
    ),
    "i15_last_rounds": _sql(
        """SELECT round, method, round(timestamp, 6) AS timestamp, round(accuracy, 6) AS accuracy,
        round(loss, 6) AS loss, CAST(n - i AS INTEGER) AS recency, n AS n_rounds FROM timed WHERE n - i <= 5"""
    ),
}
