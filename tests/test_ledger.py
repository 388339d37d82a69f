"""Ledger figures of two recorded 20-round runs with a fault in round 8."""

import pytest
from pyspark.sql import functions as F

from shardloom.operators import ledger as L
from shardloom.operators.averaging import average_runs

# Recorded timestamps and accuracies, rounds 1 to 20.
RUNS = {
    "tasks": (
        "6.86 11.76 16.65 21.59 26.46 31.34 36.28 65.38 70.34 75.18 "
        "79.84 84.59 89.50 94.37 99.26 104.16 109.04 113.88 118.81 123.65",
        "97.30 98.20 98.58 98.84 98.93 98.97 99.02 98.82 99.05 99.07 "
        "99.07 99.06 99.07 99.13 99.12 99.15 99.12 99.12 99.14 99.14",
    ),
    "sockets": (
        "18.71 28.51 38.54 48.52 58.56 68.55 78.58 112.25 122.30 132.31 "
        "142.34 152.33 162.35 171.38 181.42 191.45 201.45 211.43 221.46 231.52",
        "96.50 97.98 98.46 98.67 98.84 98.88 99.01 98.98 98.97 98.99 "
        "99.04 99.14 99.09 99.13 99.12 99.16 99.12 99.17 99.16 99.17",
    ),
}


@pytest.fixture(scope="module")
def ledger(spark):
    rows = [
        (method, i + 1, float(t), float(a), 0.1 * (i + 1))
        for method, (ts, accs) in RUNS.items()
        for i, (t, a) in enumerate(zip(ts.split(), accs.split()))
    ]
    return spark.createDataFrame(
        rows, "method STRING, round INT, timestamp DOUBLE, accuracy DOUBLE, loss DOUBLE"
    ).cache()


def per_method(df):
    return {r["method"]: r for r in df.collect()}


def near(x, digits=4):
    return pytest.approx(x, abs=0.6 * 10**-digits)


def test_fault_window(ledger):
    got = per_method(L.fault_window(ledger, 8))
    assert (got["tasks"]["drop"], got["tasks"]["gain"]) == near((0.20, 0.23))
    assert (got["sockets"]["drop"], got["sockets"]["gain"]) == near((0.03, -0.01))
    assert got["tasks"]["recovered"] and not got["sockets"]["recovered"]


def test_recovery_time(ledger):
    got = per_method(L.recovery_time(ledger, 8))
    assert (got["tasks"]["fault_round_time"], got["tasks"]["next_round_time"]) == near((29.10, 4.96))
    assert (got["sockets"]["fault_round_time"], got["sockets"]["next_round_time"]) == near((33.67, 10.05))
    first = per_method(L.recovery_time(ledger, 1))
    assert first["tasks"]["fault_round_time"] == near(6.86)


def test_normal_duration(ledger):
    after = per_method(L.normal_duration(ledger, 8, "after"))
    exclude = per_method(L.normal_duration(ledger, 8, "exclude"))
    assert [after[m]["normal_duration"] for m in RUNS] == near([4.8558, 9.9392])
    assert [exclude[m]["normal_duration"] for m in RUNS] == near([4.9772, 10.4333])
    with pytest.raises(ValueError):
        L.normal_duration(ledger, 8, "before")


def test_duration_stats(ledger):
    got = per_method(L.duration_stats(ledger))
    cols = ("mean_duration", "min_duration", "max_duration", "std_duration")
    assert [got["tasks"][c] for c in cols] == near([6.1468, 4.66, 29.10, 5.4105])
    assert [got["sockets"][c] for c in cols] == near([11.2005, 9.03, 33.67, 5.3008])
    cols = ("peak_accuracy", "lowest_accuracy", "middle_accuracy")
    assert [got["tasks"][c] for c in cols] == [99.15, 97.30, 99.07]
    assert [got["sockets"][c] for c in cols] == [99.17, 96.50, 99.04]


@pytest.mark.parametrize("span", [2, 3, 4096])
def test_rolling_mean_over_any_block_size(ledger, span):
    got = {(r["method"], r["round"]): r["accuracy_rolling"] for r in L.rolling_mean(ledger, span=span).collect()}
    assert [got["tasks", r] for r in (3, 4, 5)] == near([98.0267, 98.5400, 98.7833])
    assert [got["sockets", r] for r in (3, 4, 5)] == near([97.6467, 98.3700, 98.6567])
    assert got["tasks", 1] is None and got["tasks", 2] is None and len(got) == 40


@pytest.mark.parametrize("span", [2, 4096])
def test_durations_and_deltas(ledger, span):
    d = {(r["method"], r["round"]): r["duration"] for r in L.round_duration(ledger, span=span).collect()}
    assert d["tasks", 1] == 6.86 and d["tasks", 8] == near(29.10) and len(d) == 40
    a = {(r["method"], r["round"]): r for r in L.round_delta(ledger, span=span).collect()}
    assert a["sockets", 1]["accuracy_delta"] == 0.0 and a["sockets", 2]["accuracy_delta"] == near(1.48)
    assert a["sockets", 9]["loss_delta"] == near(0.1)


def test_compare_methods(ledger):
    r = L.compare_methods(ledger, "sockets", "tasks").first()
    assert r["time_ratio"] == near(1.8724) and r["time_advantage"] == near(46.5921)
    assert r["rounds_diff"] == 0 and r["accuracy_diff"] == near(-0.03)
    alone = L.compare_methods(ledger.filter("method = 'tasks'"), "tasks", "none").first()
    assert alone["time_ratio"] == 0.0


def test_compare_fault(ledger):
    got = {r["metric"]: (r["a"], r["b"]) for r in L.compare_fault(ledger, "sockets", "tasks", 8).collect()}
    assert got["fault_round_time"] == near((33.67, 29.10)) and got["accuracy_drop"] == near((0.03, 0.20))
    report = {r["metric"]: r["change"] for r in L.comparison_report(ledger, "sockets", "tasks", 8).collect()}
    assert report["total_time"] == near(-107.87) and report["rounds"] == 0.0


def test_convergence_counts_rounds_below(spark, ledger):
    rows = [("m", r, a) for r, a in enumerate((70.0, 80.0, 84.0, 85.6, 84.3, 88.0), 1)]
    dip = spark.createDataFrame(rows, "method STRING, round INT, accuracy DOUBLE")
    assert L.convergence_round(dip, 85).first()["convergence_round"] == 5
    assert L.convergence_round(dip, 99).first()["convergence_round"] == 6
    assert L.convergence_round(dip, 10).first()["convergence_round"] == 1


def test_rounds_are_found_by_number(ledger):
    gap = ledger.filter("round <> 3")
    assert per_method(L.fault_window(gap, 8))["tasks"]["drop"] == near(0.20)
    d = {(r["method"], r["round"]): r["duration"] for r in L.round_duration(gap).collect()}
    assert d["tasks", 4] == near(21.59 - 11.76)
    pairs = L.align_rounds(gap.filter("method = 'tasks'"), ledger.filter("method = 'sockets'"))
    assert pairs.count() == 20 and pairs.filter("round = 3").first()["accuracy_a"] is None


def test_tolerated_and_last_rounds(ledger):
    assert all(r["tolerated"] for r in L.tolerated(ledger, 8).collect())
    assert not per_method(L.tolerated(ledger, 8, limit=0.1))["tasks"]["tolerated"]
    last = L.last_rounds(ledger, 5).collect()
    assert len(last) == 10 and min(r["round"] for r in last) == 16 and last[0]["n_rounds"] == 20
    final = per_method(L.final_metrics(ledger))["tasks"]
    assert (final["final_accuracy"], final["total_time"], final["n_rounds"]) == (99.14, 123.65, 20)


def test_average_of_runs(ledger):
    twice = ledger.unionByName(ledger.withColumn("accuracy", F.col("accuracy") - 1))
    r = average_runs(twice).filter("method = 'tasks' AND round = 8").first()
    assert r["accuracy"] == near(98.32) and r["n_runs"] == 2
