"""C: projections, filters, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions import vectors as V
from shardloom.operators import features as O
from shardloom.operators.evaluation import score_linear
from shardloom.sources.ledgers import clean_ledger
from shardloom.sources.messages import parse_messages, to_messages

from .views import (
    centroids,
    digest,
    hash32,
    ledger,
    line_samples,
    normal,
    outages,
    samples,
    shard_updates,
    sql_digest,
    table,
    with_views,
)


def _lines(spark, d, column):
    rows = line_samples(spark, d).withColumn("features", column)
    # decimal inputs end before the 9th digit, so rounding there never meets a tie
    values = [F.round(F.get("features", F.lit(i)), 9).alias(f"f{i}") for i in range(4)]
    return rows.select("l_orderkey", "l_linenumber", *values)


def c1(spark, d):
    return _lines(spark, d, V.scale("features", 255))


def c2(spark, d):
    return _lines(spark, d, V.standardize("features", 0.1307, 0.3081))


def c3(spark, d):
    return _lines(
        spark, d, V.standardize_channels("features", [0.5, 0.25], [0.2, 0.4], channel_size=2)
    )


def c4(spark, d):
    return _lines(spark, d, V.clip("features", 0.05, 0.5))


def c5(spark, d):
    noisy = O.add_feature_noise(samples(spark, d), sigma=0.1, seed="noise")
    return noisy.select("sample_id", "label", *digest())


def c6(spark, d):
    people = table(spark, d, "supplier").select(F.col("s_suppkey").alias("participant_id"))
    drawn = O.sample_per_participant(samples(spark, d), people, 20, seed=5)
    return drawn.select("participant_id", "draw", "sample_id", "label")


def c6_most(spark, d):
    """Three samples of five for each of the participants."""
    people = table(spark, d, "supplier").select(F.col("s_suppkey").alias("participant_id"))
    rows = samples(spark, d)
    drawn = O.sample_per_participant(rows, people, 3 * rows.count() // 5, seed=6)
    return drawn.select("participant_id", "draw", "sample_id")


def messages(spark, d):
    """Samples of each shard as messages, and two texts that are none."""
    own = samples(spark, d).withColumnRenamed("shard_id", "participant_id")
    bad = spark.createDataFrame([("bad",), ("{}",)], "value STRING")
    return to_messages(own).select("value").unionByName(bad)


def c7(spark, d):
    return parse_messages(messages(spark, d)).select("participant_id", "label", *digest())


def c8(spark, d):
    nested = F.array(F.slice("features", 1, 30), F.slice("features", 31, 34))
    rows = samples(spark, d).withColumn("features", V.flatten_features(nested))
    return rows.select("sample_id", *digest())


def raw_ledger(spark, d):
    """The ledger as texts, with 1 mistyped as l, and unreadable values."""
    r = F.col("round")
    return ledger(spark, d).select(
        r.cast("string").alias("Round"),
        F.round("timestamp", 2).cast("string").alias("Timestamp"),
        F.when(r % 10 == 0, F.lit("")).otherwise(F.round("accuracy", 2).cast("string")).alias("Accuracy"),
        F.when(r % 7 == 0, F.lit("abc"))
        .otherwise(F.replace(F.round("loss", 4).cast("string"), F.lit("1"), F.lit("l")))
        .alias("Loss"),
        "method",
    )


def c9(spark, d):
    return clean_ledger(raw_ledger(spark, d)).select(
        "round", "method", "timestamp", "accuracy", "loss"
    )


def _scored(spark, d):
    return score_linear(samples(spark, d), *centroids(spark, d))


def c10(spark, d):
    return _scored(spark, d).select("sample_id", V.predict("scores").alias("prediction"))


def c11(spark, d):
    rows = _scored(spark, d).withColumn("features", V.log_softmax("scores"))
    return rows.select("sample_id", *digest())


def c12_valid(spark, d):
    return O.valid_updates(shard_updates(spark, d)).select("round", "shard_id", "n_samples")


def c12_failed(spark, d):
    return O.failed_updates(shard_updates(spark, d)).select("round", "shard_id", "status")


def c13(spark, d):
    rows = table(spark, d, "events").select(
        "event_id",
        (F.pmod("event_id", F.lit(10)) + 1).cast("int").alias("round"),
        F.pmod("user_id", F.lit(4)).cast("int").alias("shard_id"),
    )
    return O.exclude_unavailable(rows, outages(spark))


def c13_round(spark, d):
    rows = samples(spark, d).select("sample_id", "shard_id")
    return O.exclude_unavailable(rows, outages(spark), round_no=8)


def c15(spark, d):
    return O.format_ledger(ledger(spark, d)).select("round", "method", "timestamp", "accuracy", "loss")


QUERIES = {
    "c1_scale": c1,
    "c2_standardize": c2,
    "c3_standardize_channels": c3,
    "c4_clip": c4,
    "c5_add_feature_noise": c5,
    "c6_sample_per_participant": c6,
    "c6_sample_most": c6_most,
    "c7_parse_messages": c7,
    "c8_flatten_features": c8,
    "c9_clean_ledger": c9,
    "c10_predict": c10,
    "c11_log_softmax": c11,
    "c12_valid_updates": c12_valid,
    "c12_failed_updates": c12_failed,
    "c13_exclude_unavailable": c13,
    "c13_exclude_in_round": c13_round,
    "c15_format_ledger": c15,
}


def _line_sql(expr: str) -> str:
    return with_views(
        f"""SELECT l_orderkey, l_linenumber, {', '.join(f'round(f[{i + 1}], 9) AS f{i}' for i in range(4))}
        FROM (SELECT *, list_transform(features, lambda x, i: {expr}) AS f FROM line_samples)""",
        "line_samples",
    )



def _draws_sql(k: str, seed: int, columns: str) -> str:
    """Draws by a Feistel network over a x b, walking on while a place is outside."""
    return with_views(
        f"""SELECT {columns} FROM (SELECT p AS participant_id, draw, x FROM walk, size WHERE steps > 0 AND x < n) d
        JOIN placed s ON s.spot = d.x""",
        "samples",
        placed="SELECT sample_id, label, row_number() OVER (ORDER BY sample_id) - 1 AS spot FROM samples",
        size="""SELECT n, a, CAST(ceil(n / CAST(a AS DOUBLE)) AS BIGINT) AS b
        FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM samples)""",
        walk=f"""SELECT s_suppkey AS p, draw, CAST(draw - 1 AS BIGINT) AS x, 0 AS steps
        FROM supplier, (SELECT CAST(unnest(range(1, {k} + 1)) AS INTEGER) AS draw FROM size)
        UNION ALL SELECT p, draw, l2 * b + r2, steps + 1 FROM (
            SELECT *, (r1 + {hash32('p', '3', 'l2', seed=seed)}) % b AS r2 FROM (
            SELECT *, (l1 + {hash32('p', '2', 'r1', seed=seed)}) % a AS l2 FROM (
            SELECT *, (r0 + {hash32('p', '1', 'l1', seed=seed)}) % b AS r1 FROM (
            SELECT *, (l0 + {hash32('p', '0', 'r0', seed=seed)}) % a AS l1 FROM (
            SELECT walk.*, a, b, x // b AS l0, x % b AS r0 FROM walk, size WHERE steps = 0 OR x >= n)))))""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLE = {
    "c1_scale": _line_sql("x / 255"),
    "c2_standardize": _line_sql("(x - 0.1307::DOUBLE) / 0.3081::DOUBLE"),
    "c3_standardize_channels": _line_sql(
        "CASE WHEN i <= 2 THEN (x - 0.5::DOUBLE) / 0.2::DOUBLE ELSE (x - 0.25::DOUBLE) / 0.4::DOUBLE END"
    ),
    "c4_clip": _line_sql("greatest(0.05::DOUBLE, least(0.5::DOUBLE, x))"),
    "c5_add_feature_noise": with_views(
        f"""SELECT sample_id, label, {sql_digest('f')} FROM (SELECT sample_id, label,
        list(greatest(0.0::DOUBLE, least(1.0::DOUBLE, x + 0.1::DOUBLE * {normal('pos', 'sample_id', seed='noise')}))
        ORDER BY pos) AS f FROM sample_cells GROUP BY 1, 2)""",
        "sample_cells",
    ),
    "c6_sample_per_participant": _draws_sql("20", 5, "d.participant_id, d.draw, s.sample_id, s.label"),
    "c6_sample_most": _draws_sql("3 * n // 5", 6, "d.participant_id, d.draw, s.sample_id"),
    "c7_parse_messages": with_views(
        f"SELECT shard_id AS participant_id, label, {sql_digest()} FROM samples", "samples"
    ),
    "c8_flatten_features": with_views(f"SELECT sample_id, {sql_digest()} FROM samples", "samples"),
    "c9_clean_ledger": with_views(
        """SELECT round, method, round(timestamp, 2) AS timestamp, round(accuracy, 2) AS accuracy,
        round(loss, 4) AS loss FROM ledger WHERE round % 10 <> 0 AND round % 7 <> 0""",
        "ledger",
    ),
    "c10_predict": with_views("SELECT sample_id, prediction FROM predicted", "predicted"),
    "c11_log_softmax": with_views(
        f"""SELECT sample_id, {sql_digest('f')} FROM (SELECT sample_id,
        list_transform(scores, lambda s: s - log_z) AS f FROM predicted)""",
        "predicted",
    ),
    "c12_valid_updates": with_views(
        "SELECT round, shard_id, n_samples FROM update_heads WHERE status = 'success'", "update_heads"
    ),
    "c12_failed_updates": with_views(
        "SELECT round, shard_id, status FROM update_heads WHERE status <> 'success'", "update_heads"
    ),
    "c13_exclude_unavailable": with_views(
        """SELECT * FROM (SELECT event_id, CAST(event_id % 10 + 1 AS INTEGER) AS round,
        CAST(user_id % 4 AS INTEGER) AS shard_id FROM events) e
        WHERE NOT EXISTS (SELECT 1 FROM outages o WHERE o.round = e.round AND o.shard_id = e.shard_id)""",
        "outages",
    ),
    "c13_exclude_in_round": with_views(
        """SELECT sample_id, shard_id FROM samples
        WHERE shard_id NOT IN (SELECT shard_id FROM outages WHERE round = 8)""",
        "samples", "outages",
    ),
    "c15_format_ledger": with_views(
        """SELECT round, method, round(timestamp, 2) AS timestamp, round(accuracy, 2) AS accuracy,
        round(loss, 4) AS loss FROM ledger""",
        "ledger",
    ),
}
