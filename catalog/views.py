"""Views over the given tables, once for Spark and once as SQL text.

Both sides define the same rows, so a registered query and its SQL differ only
in how the operator under test is expressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.vectors import predict
from shardloom.operators.averaging import as_vector
from shardloom.schemas import OUTAGES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- Spark side ---------------------------------------------------------------

def samples(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        "label",
        F.pmod("vec_id", F.lit(4)).cast("int").alias("shard_id"),
    )


def taught_samples(spark, d) -> DataFrame:
    """Samples labelled by the largest of their first ten features.

    The labels of the table itself do not depend on the features; these can be
    learned, so that training has something to show.
    """
    return samples(spark, d).withColumn("label", predict(F.slice("features", 1, 10)))


def order_samples(spark, d) -> DataFrame:
    """Orders as labelled samples: a larger table with a unique id."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("sample_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("label"),
        F.array(F.col("o_totalprice")).alias("features"),
        F.col("o_custkey").alias("owner"),
        F.col("o_orderstatus").alias("state"),
    )


LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def line_samples(spark, d) -> DataFrame:
    """Line items as samples with four features."""
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.array(
            F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, "l_discount", "l_tax"
        ).alias("features"),
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("label"),
        F.pmod("l_suppkey", F.lit(8)).cast("int").alias("shard_id"),
    )


def participants(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").cast("int").alias("participant_id"),
        F.col("event_id").alias("sample_id"),
        F.col("event_type").alias("label"),
    )


def resources(spark, d) -> DataFrame:
    share = lambda kind: F.lit(100.0) * F.avg((F.col("event_type") == kind).cast("int"))
    return (
        table(spark, d, "events")
        .groupBy(F.col("user_id").cast("int").alias("participant_id"))
        .agg(
            share("error").alias("cpu_percent"),
            share("view").alias("memory_percent"),
            share("click").alias("disk_usage"),
        )
    )


def _mean_vectors(df: DataFrame, by: str) -> DataFrame:
    cells = (
        df.select(by, F.posexplode("features").alias("pos", "x"))
        .groupBy(by, "pos")
        .agg(F.avg("x").alias("value"))
    )
    return as_vector(cells, by)


def shard_updates(spark, d) -> DataFrame:
    """One update per shard and round 1..9; shard 0 failed in round 5."""
    s = samples(spark, d)
    counts = s.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_samples"))
    rounds = counts.join(_mean_vectors(s, "shard_id"), "shard_id").withColumn(
        "round", F.explode(F.sequence(F.lit(1), F.lit(9)))
    )
    bad = (F.col("round") == 5) & (F.col("shard_id") == 0)
    return rounds.select(
        "round",
        "shard_id",
        F.when(bad, F.lit(0)).otherwise(F.col("n_samples")).cast("bigint").alias("n_samples"),
        F.when(bad, "failed").otherwise("success").alias("status"),
        (F.lit(1.0) / (F.col("shard_id") + F.col("round"))).alias("avg_loss"),
        (F.lit(0.001) * F.col("round")).alias("lr"),
        F.when(~bad, F.col("weights")).alias("weights"),
    )


def layered_updates(spark, d) -> DataFrame:
    """``shard_updates`` cut into two layers; shard 3 lacks the second one."""
    u = shard_updates(spark, d)
    head = u.withColumns({"layer": F.lit("body"), "weights": F.slice("weights", 1, 60)})
    tail = u.withColumns({"layer": F.lit("head"), "weights": F.slice("weights", 61, 4)}).filter(
        "shard_id <> 3"
    )
    return head.unionByName(tail)


def label_updates(spark, d) -> DataFrame:
    """Ten vectors: the mean features of each label."""
    return _mean_vectors(samples(spark, d), "label").withColumnRenamed("label", "participant_id")


def day_of(ts: Column) -> Column:
    return (F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date")) + 1).cast("int")


def ledger(spark, d) -> DataFrame:
    """A ledger from events: one round per day, two methods."""
    e = table(spark, d, "events").select(
        day_of(F.col("ts")).alias("round"),
        F.when(F.pmod("user_id", F.lit(2)) == 0, "a").otherwise("b").alias("method"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        (F.col("event_type") != "error").cast("int").alias("ok"),
        "value",
    )
    daily = e.groupBy("round", "method").agg(
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        (F.lit(100.0) * F.avg("ok")).alias("accuracy"),
        F.avg("value").alias("loss"),
    )
    starts = daily.groupBy("method").agg(F.min("first_us").alias("start_us"))
    return daily.join(starts, "method").select(
        "round",
        ((F.col("last_us") - F.col("start_us")) / 1e6).alias("timestamp"),
        "accuracy",
        "loss",
        F.lit("normal").alias("mode"),
        "method",
    )


def requests(spark, d) -> DataFrame:
    """Admission requests from events: some late by a round, some without one."""
    day = day_of(F.col("ts"))
    return table(spark, d, "events").select(
        F.col("event_id").alias("request_id"),
        "ts",
        day.alias("day"),
        F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("int"))
        .when(F.col("event_id") % 7 == 0, day - 1)
        .otherwise(day)
        .alias("round"),
        F.pmod("user_id", F.lit(20)).cast("int").alias("participant_id"),
    )


def outages(spark) -> DataFrame:
    return spark.createDataFrame([(5, 0), (8, 0), (8, 1)], OUTAGES)


def centroids(spark, d):
    """Nearest-centroid linear model: class means, and biases -|mean|^2 / 2.

    Classes x features values, so it may come to the driver.
    """
    import numpy as np

    rows = _mean_vectors(samples(spark, d), "label").orderBy("label").collect()
    means = np.array([r["weights"] for r in rows])
    return means, -0.5 * (means * means).sum(axis=1)


def digest(col: str = "features") -> list[Column]:
    """Scalars that pin down a vector: length, sum, position-weighted sum, range."""
    weighted = F.transform(F.col(col), lambda x, i: x * (i + 1))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return [
        F.size(col).cast("bigint").alias("v_len"),
        F.round(total(F.col(col)), 5).alias("v_sum"),
        F.round(total(weighted), 4).alias("v_wsum"),
        F.round(F.array_min(col), 6).alias("v_min"),
        F.round(F.array_max(col), 6).alias("v_max"),
    ]


# -- SQL side -----------------------------------------------------------------

_CTES = {
    "samples": """SELECT vec_id AS sample_id, CAST(embedding AS DOUBLE[]) AS features, label,
        CAST(vec_id % 4 AS INTEGER) AS shard_id FROM embeddings""",
    "order_samples": """SELECT o_orderkey AS sample_id,
        CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS label, o_custkey AS owner,
        o_orderstatus AS state, [o_totalprice] AS features FROM orders""",
    "line_samples": """SELECT l_orderkey, l_linenumber,
        [l_quantity / 50, l_extendedprice / 100000, l_discount, l_tax] AS features,
        CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
        CAST(l_suppkey % 8 AS INTEGER) AS shard_id FROM lineitem""",
    "participants": """SELECT CAST(user_id AS INTEGER) AS participant_id, event_id AS sample_id,
        event_type AS label FROM events""",
    "resources": """SELECT CAST(user_id AS INTEGER) AS participant_id,
        100.0 * avg(CAST(event_type = 'error' AS INTEGER)) AS cpu_percent,
        100.0 * avg(CAST(event_type = 'view' AS INTEGER)) AS memory_percent,
        100.0 * avg(CAST(event_type = 'click' AS INTEGER)) AS disk_usage
        FROM events GROUP BY 1""",
    "sample_cells": """SELECT sample_id, label, shard_id, unnest(features) AS x,
        unnest(range(len(features))) AS pos FROM samples""",
    "shard_means": """SELECT shard_id, pos, avg(x) AS value, count(*) AS n
        FROM sample_cells GROUP BY 1, 2""",
    "shard_updates": """SELECT r.round, m.shard_id, m.pos,
        CASE WHEN r.round = 5 AND m.shard_id = 0 THEN 0 ELSE m.n END AS n_samples,
        CASE WHEN r.round = 5 AND m.shard_id = 0 THEN 'failed' ELSE 'success' END AS status,
        1.0 / (m.shard_id + r.round) AS avg_loss, CAST(0.001 AS DOUBLE) * r.round AS lr,
        CASE WHEN r.round = 5 AND m.shard_id = 0 THEN NULL ELSE m.value END AS value
        FROM shard_means m, (SELECT CAST(unnest(range(1, 10)) AS INTEGER) AS round) r""",
    "update_heads": """SELECT DISTINCT round, shard_id, n_samples, status, avg_loss, lr
        FROM shard_updates""",
    "layered": """SELECT round, shard_id, n_samples, status, value,
        CASE WHEN pos < 60 THEN 'body' ELSE 'head' END AS layer,
        CASE WHEN pos < 60 THEN pos ELSE pos - 60 END AS pos
        FROM shard_updates WHERE pos < 60 OR shard_id <> 3""",
    "label_means": """SELECT label AS participant_id, pos, avg(x) AS value
        FROM sample_cells GROUP BY 1, 2""",
    "daily": """SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS round,
        CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS method,
        min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us,
        100.0 * avg(CAST(event_type <> 'error' AS INTEGER)) AS accuracy, avg(value) AS loss
        FROM events GROUP BY 1, 2""",
    "ledger": """SELECT round, method, 'normal' AS mode, accuracy, loss,
        (last_us - min(first_us) OVER (PARTITION BY method)) / 1e6 AS timestamp FROM daily""",
    "requests": """SELECT event_id AS request_id, ts, day,
        CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 7 = 0 THEN day - 1 ELSE day END AS round,
        participant_id FROM (SELECT event_id, ts, CAST(user_id % 20 AS INTEGER) AS participant_id,
        CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS day FROM events)""",
    "outages": "SELECT * FROM (VALUES (5, 0), (8, 0), (8, 1)) AS t(round, shard_id)",
    "class_means": """SELECT label, pos, avg(x) AS w FROM sample_cells GROUP BY 1, 2""",
    "class_bias": "SELECT label, -0.5 * sum(w * w) AS b FROM class_means GROUP BY 1",
    "score_rows": """SELECT s.sample_id, s.label, s.shard_id, m.label AS class,
        sum(s.x * m.w) + any_value(b.b) AS score
        FROM sample_cells s JOIN class_means m ON s.pos = m.pos JOIN class_bias b ON b.label = m.label
        GROUP BY 1, 2, 3, 4""",
    "scored": """SELECT sample_id, label, shard_id, list(score ORDER BY class) AS scores
        FROM score_rows GROUP BY 1, 2, 3""",
    "predicted": """SELECT *, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS prediction,
        list_max(scores) + ln(list_sum(list_transform(scores, lambda s: exp(s - list_max(scores))))) AS log_z
        FROM scored""",
}

# Order in which a view may rely on earlier ones.
_NEEDS = {
    "sample_cells": ["samples"],
    "shard_means": ["sample_cells"],
    "shard_updates": ["shard_means"],
    "update_heads": ["shard_updates"],
    "layered": ["shard_updates"],
    "label_means": ["sample_cells"],
    "ledger": ["daily"],
    "class_means": ["sample_cells"],
    "class_bias": ["class_means"],
    "score_rows": ["class_means", "class_bias"],
    "scored": ["score_rows"],
    "predicted": ["scored"],
}


def with_views(sql: str, *names: str, **extra: str) -> str:
    """Put the named views, and what they rely on, in front of a query."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS ({_CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


def hash60(*parts: str, seed) -> str:
    """SQL for the 60-bit order key."""
    text = " || '|' || ".join([f"CAST({p} AS VARCHAR)" for p in parts] + [f"'{seed}'"])
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def hash32(*parts: str, seed, at: int = 1) -> str:
    text = " || '|' || ".join([f"CAST({p} AS VARCHAR)" for p in parts] + [f"'{seed}'"])
    return f"CAST('0x' || substr(md5({text}), {at}, 8) AS BIGINT)"


def normal(pos: str, *parts: str, seed) -> str:
    """SQL for the normal at ``pos``: Box-Muller over the md5 of its pair."""
    pair = f"({pos}) // 2"
    r = f"sqrt(-2.0 * ln(({hash32(*parts, pair, seed=seed)} + 1) / 4294967297.0::DOUBLE))"
    a = f"(2 * pi() * ({hash32(*parts, pair, seed=seed, at=9)} / 4294967296.0::DOUBLE))"
    return f"({r} * CASE WHEN ({pos}) % 2 = 0 THEN cos({a}) ELSE sin({a}) END)"


def sql_digest(col: str = "features") -> str:
    return f"""CAST(len({col}) AS BIGINT) AS v_len, round(list_sum({col}), 5) AS v_sum,
        round(list_sum(list_transform({col}, lambda x, i: x * i)), 4) AS v_wsum,
        round(list_min({col}), 6) AS v_min, round(list_max({col}), 6) AS v_max"""
