import datetime as dt

from pyspark.sql import functions as F

from shardloom.operators import control as J
from shardloom.operators.features import exclude_unavailable


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_admission(spark):
    rows = [
        (0, at(5), 3, 1), (1, at(1), 3, 1), (2, at(2), 2, 2), (3, at(3), None, 3), (4, at(5), 3, 1),
    ]
    requests = spark.createDataFrame(rows, "request_id INT, ts TIMESTAMP_NTZ, round INT, participant_id INT")
    got = {r["request_id"]: r for r in J.admit(requests, 3).collect()}
    assert [got[i]["status"] for i in range(5)] == ["rejected", "accepted", "rejected", "refused", "rejected"]
    assert [got[i]["reason"] for i in range(5)] == [
        "duplicate_connection", None, "round_mismatch", "invalid_request", "duplicate_connection"
    ]
    assert got[2]["sync_required"] and got[2]["resume_round"] == 3 and got[2]["expected"] == 3
    assert not got[0]["sync_required"]


def test_one_busy_participant(spark):
    requests = spark.range(5000).select(
        F.col("id").alias("request_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"),
        F.lit(1).alias("round"), F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("participant_id"),
    )
    replies = J.admit(requests, 1, rows_per_cell=100)
    got = {r["status"]: r["count"] for r in replies.groupBy("status").count().collect()}
    assert got == {"accepted": 1001, "rejected": 3999}


def test_deadline(spark):
    starts = spark.createDataFrame([(1, at(0))], "round INT, ts TIMESTAMP_NTZ")
    rows = spark.createDataFrame(
        [(1, at(s), s) for s in (-1, 0, 30, 31)], "round INT, ts TIMESTAMP_NTZ, id INT"
    )
    assert sorted(r["id"] for r in J.within_deadline(rows, starts, 30).collect()) == [0, 30]


def test_completeness_and_missing(spark):
    u = spark.createDataFrame(
        [(1, 0, "success", [1.0]), (1, 1, "success", [1.0]), (2, 0, "success", [1.0]), (2, 1, "failed", None)],
        "round INT, shard_id INT, status STRING, weights ARRAY<DOUBLE>",
    )
    done = {r["round"]: r["complete"] for r in J.round_complete(u, 2).collect()}
    assert done == {1: True, 2: False}
    expected = spark.createDataFrame([(r, s) for r in (1, 2) for s in (0, 1)], "round INT, shard_id INT")
    assert [(r["round"], r["participant_id"]) for r in J.detect_short_round(u, expected).collect()] == [(2, 1)]


def test_recovery(spark):
    saved = spark.createDataFrame([(4, "w", 0, 1.5)], "round INT, layer STRING, pos INT, value DOUBLE")
    current = spark.createDataFrame([("w", 0, 9.0)], "layer STRING, pos INT, value DOUBLE")
    rows = lambda df: [(r["value"], r["source"], r["resume_round"]) for r in df.collect()]
    assert rows(J.recover(saved, 5)) == rows(J.recover(saved, 5, current)) == [(1.5, "checkpoint", 5)]
    assert rows(J.recover(saved, 8)) == []
    assert rows(J.recover(saved, 8, current)) == [(9.0, "current", 8)]


def test_status_after_recovery(spark):
    ev = spark.createDataFrame(
        [(1, at(1), 0, "failure"), (1, at(2), 1, "recovery"), (2, at(3), 2, "recovery"), (2, at(3), 3, "failure")],
        "participant_id INT, ts TIMESTAMP_NTZ, event_id INT, event STRING",
    )
    got = {r["participant_id"]: r["status"] for r in J.participant_status(ev).collect()}
    assert got == {1: "active", 2: "failed"}


def test_outages(spark):
    shards = spark.createDataFrame([(0,), (1,)], "shard_id INT")
    out = spark.createDataFrame([(5, 0), (8, 0), (8, 1)], "round INT, shard_id INT")
    left = lambda r: sorted(x[0] for x in exclude_unavailable(shards, out, r).collect())
    assert (left(4), left(5), left(8)) == ([0, 1], [1], [])
