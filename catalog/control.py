"""J: round control."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.operators import control as J
from shardloom.operators.averaging import average_weighted
from shardloom.session import fresh_path
from shardloom.sources import checkpoints

from .views import requests, shard_updates, table, with_views


def j1(spark, d, **cells):
    rows = J.admit(requests(spark, d), F.col("day"), **cells)
    none = F.lit(-1)
    return rows.select(
        "request_id", "participant_id", F.coalesce("round", none).alias("round"), "expected", "status",
        F.coalesce("reason", F.lit("")).alias("reason"), "sync_required",
        F.coalesce("resume_round", none).alias("resume_round"),
    )


def j1_cells(spark, d):
    return j1(spark, d, rows_per_cell=500)


def j1_fixed(spark, d):
    """All requests of the month against one expected round."""
    rows = J.admit(requests(spark, d), 15)
    return rows.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _starts(spark, d):
    return requests(spark, d).groupBy(F.col("day")).agg(F.min("ts").alias("ts"))


def j2(spark, d):
    rows = requests(spark, d).select("request_id", "ts", "day", "participant_id")
    return J.within_deadline(rows, _starts(spark, d), 7200, by=("day",)).select(
        "request_id", "day", "participant_id"
    )


def j3(spark, d):
    return J.round_complete(shard_updates(spark, d), 4)


def j3_requests(spark, d):
    """Rounds of participants by day: a purchase stands for a sent update."""
    rows = table(spark, d, "events").select(
        F.dayofmonth("ts").alias("round"),
        F.pmod("user_id", F.lit(150)).cast("int").alias("shard_id"),
        F.when(F.col("event_type") == "purchase", "success").otherwise("failed").alias("status"),
    )
    return J.round_complete(rows, 50)


def _saved(spark, d):
    path = fresh_path(spark, "checkpoints")
    model = average_weighted(shard_updates(spark, d)).withColumn("layer", F.lit("body"))
    checkpoints.save_checkpoint(model.filter("round <= 6"), path)
    return checkpoints.read_checkpoints(spark, path)


def _rounded(df):
    return df.select("pos", F.round("value", 6).alias("value"), "source", "resume_round")


def j4(spark, d):
    return _rounded(J.recover(_saved(spark, d), 5))


def j4_fallback(spark, d):
    """No checkpoint of round 8: the current model is kept."""
    current = average_weighted(shard_updates(spark, d)).filter("round = 9").select(
        F.lit("body").alias("layer"), "pos", (F.col("value") * 2).alias("value")
    )
    return _rounded(J.recover(_saved(spark, d), 9, current))


def j5(spark, d):
    rows = table(spark, d, "events").filter("event_type IN ('error', 'signup')").select(
        F.col("user_id").alias("participant_id"), "ts", "event_id",
        F.when(F.col("event_type") == "error", "failure").otherwise("recovery").alias("event"),
    )
    return J.participant_status(rows)


def j6(spark, d):
    """Participants expected on every day; an error event is no valid update."""
    e = table(spark, d, "events").select(
        F.dayofmonth("ts").alias("round"),
        F.col("user_id").cast("int").alias("shard_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.array(F.col("value")).alias("weights"),
    )
    return J.detect_short_round(e, e.select("round", "shard_id").distinct())


QUERIES = {
    "j1_admit": j1,
    "j1_admit_one_round": j1_fixed,
    "j1_admit_cells": j1_cells,
    "j2_within_deadline": j2,
    "j3_round_complete": j3,
    "j3_round_complete_requests": j3_requests,
    "j4_recover": j4,
    "j4_recover_fallback": j4_fallback,
    "j5_participant_status": j5,
    "j6_detect_short_round": j6,
}


def _admitted(expected: str) -> dict[str, str]:
    return dict(
        asked=f"SELECT *, {expected} AS expected FROM requests",
        first="""SELECT round, participant_id, arg_min(request_id, (ts, request_id)) AS first_id
        FROM asked WHERE round = expected GROUP BY 1, 2""",
        replies="""SELECT a.*, CASE WHEN a.round IS NULL THEN 'refused' WHEN a.round <> a.expected THEN 'rejected'
        WHEN a.request_id = f.first_id THEN 'accepted' ELSE 'rejected' END AS status,
        CASE WHEN a.round IS NULL THEN 'invalid_request' WHEN a.round <> a.expected THEN 'round_mismatch'
        WHEN a.request_id = f.first_id THEN '' ELSE 'duplicate_connection' END AS reason,
        a.round IS NOT NULL AND a.round <> a.expected AS sync_required
        FROM asked a LEFT JOIN first f ON a.round = f.round AND a.participant_id = f.participant_id""",
    )


_MODEL = """SELECT round, CAST(pos AS INTEGER) AS pos, sum(n_samples * value) / sum(n_samples) AS value
    FROM shard_updates WHERE status = 'success' GROUP BY 1, 2"""

ORACLE = {
    "j1_admit": with_views(
        """SELECT request_id, participant_id, coalesce(round, -1) AS round, expected, status, reason,
        sync_required, CASE WHEN sync_required THEN expected ELSE -1 END AS resume_round FROM replies""",
        "requests", **_admitted("day"),
    ),
    "j1_admit_one_round": with_views(
        "SELECT status, reason, count(*) AS n FROM replies GROUP BY 1, 2", "requests", **_admitted("15")
    ),
    "j2_within_deadline": with_views(
        """SELECT request_id, day, participant_id FROM (SELECT *, min(ts) OVER (PARTITION BY day) AS s
        FROM requests) WHERE ts <= s + INTERVAL 7200 SECONDS""",
        "requests",
    ),
    "j3_round_complete": with_views(
        """SELECT round, count(*) AS processed, count(*) FILTER (status = 'success') AS received,
        count(*) >= 4 AND count(*) FILTER (status = 'success') >= 4 AS complete FROM update_heads GROUP BY 1""",
        "update_heads",
    ),
    "j3_round_complete_requests": """SELECT CAST(day(ts) AS INTEGER) AS round,
        count(DISTINCT user_id % 150) AS processed,
        count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id % 150 END) AS received,
        count(DISTINCT user_id % 150) >= 50 AND
        count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id % 150 END) >= 50 AS complete
        FROM events GROUP BY 1""",
    "j4_recover": with_views(
        """SELECT pos, round(value, 6) AS value, 'checkpoint' AS source, 5 AS resume_round FROM model
        WHERE round = 4""",
        "shard_updates", model=_MODEL,
    ),
    "j4_recover_fallback": with_views(
        """SELECT pos, round(2 * value, 6) AS value, 'current' AS source, 9 AS resume_round FROM model
        WHERE round = 9""",
        "shard_updates", model=_MODEL,
    ),
    "j5_participant_status": """SELECT user_id AS participant_id,
        arg_max(CASE WHEN event_type = 'error' THEN 'failed' ELSE 'active' END, (ts, event_id)) AS status,
        max(ts) AS since, count(*) FILTER (event_type = 'error') AS n_failures
        FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1""",
    "j6_detect_short_round": """SELECT CAST(day(ts) AS INTEGER) AS round, 'update_missing' AS event,
        CAST(user_id AS INTEGER) AS participant_id, 'participant_offline' AS value
        FROM events GROUP BY 1, 3 HAVING count(*) FILTER (event_type <> 'error') = 0""",
}
ORACLE["j1_admit_cells"] = ORACLE["j1_admit"]
