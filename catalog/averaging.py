"""F: aggregation of updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions.vectors import vector_norm
from shardloom.operators import averaging as A

from .views import label_updates, layered_updates, ledger, participants, samples, shard_updates, with_views


def _value(df, digits=6):
    return df.withColumn("value", F.round("value", digits))


def f1(spark, d):
    return _value(A.average_weighted(shard_updates(spark, d)))


def f1_samples(spark, d):
    """Every sample as an update of weight ``sample_id % 5 + 1``, averaged per label."""
    rows = samples(spark, d).select(
        F.col("label").alias("round"),
        (F.pmod("sample_id", F.lit(5)) + 1).alias("n_samples"),
        F.lit("success").alias("status"),
        F.col("features").alias("weights"),
    )
    return _value(A.average_weighted(rows))


def f2(spark, d):
    return _value(A.average_unweighted(layered_updates(spark, d), ["body", "head"]))


def f3(spark, d):
    return _value(A.average_stacked(layered_updates(spark, d)))


def f4(spark, d):
    u = layered_updates(spark, d).withColumn("weights", F.transform("weights", lambda x: x * 1000))
    types = spark.createDataFrame([("body", "float64"), ("head", "int64")], "layer STRING, dtype STRING")
    return _value(A.average_typed(u, types), 4)


def previous_model(spark, d):
    """A model per round to fall back on: the round number at every position."""
    return spark.range(64).select(
        F.explode(F.sequence(F.lit(1), F.lit(9))).alias("round"),
        F.col("id").cast("int").alias("pos"),
    ).withColumn("value", F.col("round").cast("double"))


def f5_any(spark, d):
    return _value(A.apply_quorum(shard_updates(spark, d), previous_model(spark, d), "any"))


def f5_all(spark, d):
    return _value(A.apply_quorum(shard_updates(spark, d), previous_model(spark, d), "all", 4))


def f6(spark, d):
    rows = A.round_accounting(shard_updates(spark, d), 4)
    return rows.withColumns({c: F.round(c, 6) for c in ("mean_lr", "mean_loss")})


def f6_expected(spark, d):
    """Rounds 4 to 11 of four shards are expected; shard 3 sends nothing in even rounds, and nobody from round 10."""
    sent = shard_updates(spark, d).filter("NOT (shard_id = 3 AND round % 2 = 0)")
    expected = spark.range(4, 12).selectExpr("CAST(id AS INT) AS round", "explode(sequence(0, 3)) AS shard_id")
    rows = A.round_accounting(sent, expected)
    return rows.withColumns({c: F.round(c, 6) for c in ("mean_lr", "mean_loss")})


def f7(spark, d):
    selected = participants(spark, d).select("participant_id").distinct()
    return _value(A.vector_sum_mean(label_updates(spark, d), "selected", selected))


def f7_received(spark, d):
    return _value(A.vector_sum_mean(label_updates(spark, d), "received"))


def f8(spark, d):
    return samples(spark, d).select("sample_id", F.round(vector_norm("features"), 6).alias("norm"))


def f9(spark, d):
    runs = ledger(spark, d).withColumn("round", F.pmod("round", F.lit(10)).cast("int"))
    rows = A.average_runs(runs)
    return rows.withColumns({c: F.round(c, 6) for c in ("timestamp", "accuracy", "loss")})


QUERIES = {
    "f1_average_weighted": f1,
    "f1_average_weighted_samples": f1_samples,
    "f2_average_unweighted": f2,
    "f3_average_stacked": f3,
    "f4_average_typed": f4,
    "f5_apply_quorum_any": f5_any,
    "f5_apply_quorum_all": f5_all,
    "f6_round_accounting": f6,
    "f6_accounting_of_expected": f6_expected,
    "f7_vector_sum_mean": f7,
    "f7_vector_mean_received": f7_received,
    "f8_vector_norm": f8,
    "f9_average_runs": f9,
}

_PREVIOUS = """SELECT CAST(r AS INTEGER) AS round, CAST(p AS INTEGER) AS pos, CAST(r AS DOUBLE) AS value
    FROM (SELECT unnest(range(1, 10)) AS r), (SELECT unnest(range(64)) AS p)"""
_MEAN = """SELECT round, CAST(pos AS INTEGER) AS pos, sum(n_samples * value) / sum(n_samples) AS value
    FROM shard_updates WHERE status = 'success' GROUP BY 1, 2"""


def _quorum(rule: str) -> str:
    return with_views(
        """SELECT round, pos, round(value, 6) AS value, 'averaged' AS source FROM mean
        WHERE round IN (SELECT round FROM met)
        UNION ALL SELECT round, pos, round(value, 6), 'kept' FROM previous
        WHERE round NOT IN (SELECT round FROM met)""",
        "update_heads", mean=_MEAN, previous=_PREVIOUS,
        met=f"""SELECT round FROM update_heads GROUP BY 1
        HAVING {rule} AND sum(CASE WHEN status = 'success' THEN n_samples ELSE 0 END) > 0""",
    )


ORACLE = {
    "f1_average_weighted": with_views(
        "SELECT round, pos, round(value, 6) AS value FROM mean", "shard_updates", mean=_MEAN
    ),
    "f1_average_weighted_samples": with_views(
        """SELECT label AS round, CAST(pos AS INTEGER) AS pos,
        round(sum((sample_id % 5 + 1) * x) / sum(sample_id % 5 + 1), 6) AS value
        FROM sample_cells GROUP BY 1, 2""",
        "sample_cells",
    ),
    "f2_average_unweighted": with_views(
        """SELECT round, layer, CAST(pos AS INTEGER) AS pos, round(avg(value), 6) AS value FROM layered
        WHERE shard_id <> 3 AND value IS NOT NULL GROUP BY 1, 2, 3""",
        "layered",
    ),
    "f3_average_stacked": with_views(
        """SELECT round, layer, CAST(pos AS INTEGER) AS pos, round(avg(value), 6) AS value FROM layered
        WHERE value IS NOT NULL GROUP BY 1, 2, 3""",
        "layered",
    ),
    "f4_average_typed": with_views(
        """SELECT round, layer, CAST(pos AS INTEGER) AS pos,
        CASE WHEN layer = 'head' THEN trunc(round(v, 9)) ELSE round(v, 4) END AS value,
        CASE WHEN layer = 'head' THEN 'int64' ELSE 'float64' END AS dtype FROM (
        SELECT round, layer, pos, sum(n_samples * value * 1000) / sum(n_samples) AS v FROM layered
        WHERE status = 'success' GROUP BY 1, 2, 3)""",
        "layered",
    ),
    "f5_apply_quorum_any": _quorum("count(*) FILTER (status = 'success') >= 1"),
    "f5_apply_quorum_all": _quorum("count(*) FILTER (status = 'success') >= 4"),
    "f6_round_accounting": with_views(
        """SELECT round, count(*) AS received, count(*) FILTER (status = 'success') AS valid,
        4 - count(*) FILTER (status = 'success') AS failed,
        coalesce(string_agg(CAST(shard_id AS VARCHAR), ',' ORDER BY shard_id)
        FILTER (status <> 'success'), '') AS failed_ids,
        CAST(sum(n_samples) AS BIGINT) AS total_samples,
        round(avg(lr) FILTER (status = 'success'), 6) AS mean_lr,
        round(avg(avg_loss) FILTER (status = 'success'), 6) AS mean_loss FROM update_heads GROUP BY 1""",
        "update_heads",
    ),
    "f6_accounting_of_expected": with_views(
        """SELECT e.round, count(u.status) AS received, count(*) FILTER (u.status = 'success') AS valid,
        4 - count(*) FILTER (u.status = 'success') AS failed,
        coalesce(string_agg(CAST(e.shard_id AS VARCHAR), ',' ORDER BY e.shard_id)
        FILTER (coalesce(u.status, '') <> 'success'), '') AS failed_ids,
        CAST(coalesce(sum(u.n_samples), 0) AS BIGINT) AS total_samples,
        round(avg(u.lr) FILTER (u.status = 'success'), 6) AS mean_lr,
        round(avg(u.avg_loss) FILTER (u.status = 'success'), 6) AS mean_loss
        FROM (SELECT CAST(r AS INTEGER) AS round, CAST(s AS INTEGER) AS shard_id
            FROM (SELECT unnest(range(4, 12)) AS r), (SELECT unnest(range(4)) AS s)) e
        LEFT JOIN (SELECT * FROM update_heads WHERE NOT (shard_id = 3 AND round % 2 = 0)) u
        ON u.round = e.round AND u.shard_id = e.shard_id GROUP BY 1""",
        "update_heads",
    ),
    "f7_vector_sum_mean": with_views(
        """SELECT CAST(pos AS INTEGER) AS pos, round(sum(value) / (SELECT count(DISTINCT user_id)
        FROM events), 6) AS value FROM label_means GROUP BY 1""",
        "label_means",
    ),
    "f7_vector_mean_received": with_views(
        "SELECT CAST(pos AS INTEGER) AS pos, round(avg(value), 6) AS value FROM label_means GROUP BY 1",
        "label_means",
    ),
    "f8_vector_norm": with_views(
        "SELECT sample_id, round(sqrt(list_sum(list_transform(features, lambda x: x * x))), 6) AS norm FROM samples",
        "samples",
    ),
    "f9_average_runs": with_views(
        """SELECT method, CAST(round % 10 AS INTEGER) AS round, count(*) AS n_runs,
        round(avg(timestamp), 6) AS timestamp, round(avg(accuracy), 6) AS accuracy,
        round(avg(loss), 6) AS loss FROM ledger GROUP BY 1, 2""",
        "ledger",
    ),
}
