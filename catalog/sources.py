"""A: sources and sinks. Each query writes a new folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.operators.averaging import average_weighted
from shardloom.operators.control import detect_short_round
from shardloom.operators.ledger import comparison_report
from shardloom.operators.sharding import shard_contiguous, train_test_split
from shardloom.session import fresh_path
from shardloom.sources import checkpoints, ledgers, messages, samples as sample_files

from .features import raw_ledger
from .views import digest, hash60, ledger, samples, shard_updates, sql_digest, with_views


def a1(spark, d):
    path = fresh_path(spark, "samples")
    samples(spark, d).select("sample_id", "features", "label").write.parquet(path)
    return sample_files.read_samples(spark, path).select("sample_id", "label", *digest())


def a2(spark, d):
    path = fresh_path(spark, "label-csv")
    sample_files.write_label_csv(samples(spark, d), path, 64)
    return sample_files.read_label_csv(spark, path, 64).select("label", *digest())


def a3(spark, d):
    path = fresh_path(spark, "ledger-csv")
    raw_ledger(spark, d).filter("method = 'a'").drop("method").write.option("header", True).csv(path)
    return ledgers.read_ledger(spark, path, method="a")


def a4(spark, d):
    path = fresh_path(spark, "history")
    ledgers.save_history(ledger(spark, d).filter("method = 'b'"), path)
    return ledgers.load_history(spark, path).select("Round", F.round("Accuracy", 6).alias("Accuracy"))


def own_messages(spark, d):
    return messages.to_messages(samples(spark, d).withColumnRenamed("shard_id", "participant_id"))


def a5(spark, d):
    path, out = fresh_path(spark, "topic"), fresh_path(spark, "received")
    messages.write_messages(own_messages(spark, d), "text", path)
    stream = messages.parse_messages(messages.read_message_stream(spark, "text", path))
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", fresh_path(spark, "stream"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select("participant_id", "label", *digest())


def a6(spark, d):
    path = fresh_path(spark, "messages")
    messages.write_messages(own_messages(spark, d), "text", path)
    texts = spark.read.text(path)
    size = F.size(F.from_json("value", "participant_id INT, label ARRAY<INT>")["label"])
    who = F.get_json_object("value", "$.participant_id").cast("int")
    return texts.groupBy(who.alias("participant_id"), size.cast("bigint").alias("n_samples")).agg(
        F.count(F.lit(1)).alias("n_messages")
    )


def a7(spark, d):
    path = fresh_path(spark, "ledger")
    rows = ledger(spark, d)
    for method in ("a", "b"):
        ledgers.append_ledger(rows.filter(F.col("method") == method), path)
    return spark.read.schema(rows.schema).parquet(path)


def a8(spark, d):
    path = fresh_path(spark, "history")
    rows = ledger(spark, d).filter("method = 'a'")
    newest = rows.agg(F.max("round")).scalar()
    ledgers.save_history(rows.filter(F.col("round") < newest), path)
    ledgers.save_history(rows, path, mode="append")
    return ledgers.load_history(spark, path).select("Round", F.round("Accuracy", 6).alias("Accuracy"))


def a8_both(spark, d):
    """A history for each method."""
    found = None
    for method in ("a", "b"):
        path = fresh_path(spark, "history")
        ledgers.save_history(ledger(spark, d).filter(F.col("method") == method), path)
        rows = ledgers.load_history(spark, path).select(
            F.lit(method).alias("method"), "Round", F.round("Accuracy", 6).alias("Accuracy")
        )
        found = rows if found is None else found.unionByName(rows)
    return found


def _checkpoints(spark, d) -> str:
    path = fresh_path(spark, "checkpoints")
    updates = shard_updates(spark, d)
    model = average_weighted(updates).withColumn("layer", F.lit("body"))
    status = updates.groupBy("round", F.col("shard_id").alias("participant_id")).agg(
        F.max(F.when(F.col("status") == "failed", "failed").otherwise("active")).alias("status")
    )
    checkpoints.save_checkpoint(model, path, status=status)
    # Saving a round again replaces that round only.
    checkpoints.save_checkpoint(
        model.filter("round = 4").withColumn("value", F.col("value") * 2), path
    )
    return path


def a9(spark, d):
    rows = checkpoints.read_checkpoints(spark, _checkpoints(spark, d))
    return rows.select("round", "layer", "pos", F.round("value", 6).alias("value"))


def a10(spark, d):
    rows = checkpoints.load_checkpoint(spark, _checkpoints(spark, d), 4)
    return rows.select("round", "pos", F.round("value", 6).alias("value"))


def a10_status(spark, d):
    rows = checkpoints.load_checkpoint(spark, _checkpoints(spark, d), 5, part="status")
    return rows.select("round", "participant_id", "status")


def a11(spark, d):
    path = fresh_path(spark, "failures")
    updates = shard_updates(spark, d)
    ledgers.append_failure_event(
        detect_short_round(updates, updates.select("round", "shard_id")), path
    )
    return ledgers.read_failure_log(spark, path).drop("ts")


def _written_shards(spark, d) -> str:
    path = fresh_path(spark, "shards")
    rows = train_test_split(samples(spark, d).drop("shard_id"), 50, seed=6)
    test, train = (rows.filter(c).drop("is_test") for c in ("is_test", "NOT is_test"))
    sample_files.write_shards(shard_contiguous(train, 3), path, test, rows_per_file=100)
    return path


def a12(spark, d):
    path = _written_shards(spark, d)
    return sample_files.read_shard(spark, path).select("sample_id", "shard_id", "label", *digest())


def a12_pruned(spark, d):
    path = _written_shards(spark, d)
    test = sample_files.read_samples(spark, f"{path}/test").withColumn("part", F.lit("test"))
    one = sample_files.read_shard(spark, path, 1).drop("shard_id").withColumn("part", F.lit("shard 1"))
    return test.unionByName(one).select("sample_id", "part", "label")


def a13(spark, d):
    rows = comparison_report(ledger(spark, d), "a", "b", 8)
    return rows.withColumns({c: F.round(c, 6) for c in ("a", "b", "change")})


QUERIES = {
    "a1_read_samples": a1,
    "a2_label_csv": a2,
    "a3_read_ledger": a3,
    "a4_load_history": a4,
    "a5_read_message_stream": a5,
    "a6_write_messages": a6,
    "a7_append_ledger": a7,
    "a8_save_history": a8,
    "a8_save_history_both": a8_both,
    "a9_save_checkpoint": a9,
    "a10_load_checkpoint": a10,
    "a10_load_status": a10_status,
    "a11_append_failure_event": a11,
    "a12_write_shards": a12,
    "a12_read_one_shard": a12_pruned,
    "a13_comparison_report": a13,
}

_MODEL = """SELECT round, CAST(pos AS INTEGER) AS pos, sum(n_samples * value) / sum(n_samples)
    * CASE WHEN round = 4 THEN 2 ELSE 1 END AS value
    FROM shard_updates WHERE status = 'success' GROUP BY 1, 2"""
_SPLIT = f"SELECT *, row_number() OVER (ORDER BY {hash60('sample_id', seed=6)}, sample_id) <= 50 AS is_test FROM samples"
_TRAIN = """SELECT *, row_number() OVER (ORDER BY sample_id) - 1 AS pos, count(*) OVER () AS n
    FROM split WHERE NOT is_test"""
_SHARD = "CAST(least(pos // (n // 3), 2) AS INTEGER)"

ORACLE = {
    "a1_read_samples": with_views(f"SELECT sample_id, label, {sql_digest()} FROM samples", "samples"),
    "a2_label_csv": with_views(f"SELECT label, {sql_digest()} FROM samples", "samples"),
    "a3_read_ledger": with_views(
        """SELECT round, method, round(timestamp, 2) AS timestamp, round(accuracy, 2) AS accuracy,
        round(loss, 4) AS loss FROM ledger WHERE method = 'a' AND round % 10 <> 0 AND round % 7 <> 0""",
        "ledger",
    ),
    "a4_load_history": with_views(
        """SELECT round AS "Round", round(accuracy, 6) AS "Accuracy" FROM ledger WHERE method = 'b'""",
        "ledger",
    ),
    "a5_read_message_stream": with_views(
        f"SELECT shard_id AS participant_id, label, {sql_digest()} FROM samples", "samples"
    ),
    "a6_write_messages": with_views(
        """SELECT shard_id AS participant_id, n AS n_samples, count(*) AS n_messages FROM (
        SELECT shard_id, i // 100 AS m, count(*) AS n FROM (SELECT shard_id,
        row_number() OVER (PARTITION BY shard_id ORDER BY sample_id) - 1 AS i FROM samples)
        GROUP BY 1, 2) GROUP BY 1, 2""",
        "samples",
    ),
    "a7_append_ledger": with_views(
        """SELECT round, method, mode, round(timestamp, 2) AS timestamp, round(accuracy, 2) AS accuracy,
        round(loss, 4) AS loss FROM ledger""",
        "ledger",
    ),
    "a8_save_history_both": with_views(
        "SELECT method, round AS Round, round(accuracy, 6) AS Accuracy FROM ledger", "ledger"
    ),
    "a8_save_history": with_views(
        """SELECT round AS "Round", round(accuracy, 6) AS "Accuracy" FROM ledger WHERE method = 'a'""",
        "ledger",
    ),
    "a9_save_checkpoint": with_views(
        "SELECT round, 'body' AS layer, pos, round(value, 6) AS value FROM model",
        "shard_updates", model=_MODEL,
    ),
    "a10_load_checkpoint": with_views(
        "SELECT round, pos, round(value, 6) AS value FROM model WHERE round = 4",
        "shard_updates", model=_MODEL,
    ),
    "a10_load_status": with_views(
        """SELECT round, shard_id AS participant_id,
        CASE WHEN status = 'failed' THEN 'failed' ELSE 'active' END AS status
        FROM update_heads WHERE round = 5""",
        "update_heads",
    ),
    "a11_append_failure_event": with_views(
        """SELECT round, 'update_missing' AS event, shard_id AS participant_id,
        'participant_offline' AS value FROM update_heads WHERE status <> 'success'""",
        "update_heads",
    ),
    "a12_write_shards": with_views(
        f"SELECT sample_id, {_SHARD} AS shard_id, label, {sql_digest()} FROM train",
        "samples", split=_SPLIT, train=_TRAIN,
    ),
    "a12_read_one_shard": with_views(
        f"""SELECT sample_id, 'shard 1' AS part, label FROM train WHERE {_SHARD} = 1
        UNION ALL SELECT sample_id, 'test', label FROM split WHERE is_test""",
        "samples", split=_SPLIT, train=_TRAIN,
    ),
    "a13_comparison_report": with_views(
        """SELECT metric, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS change FROM (
        SELECT 'final_accuracy' AS metric, max_by(accuracy, round) FILTER (method = 'a') AS a,
        max_by(accuracy, round) FILTER (method = 'b') AS b FROM ledger
        UNION ALL SELECT 'total_time', max_by(timestamp, round) FILTER (method = 'a'),
        max_by(timestamp, round) FILTER (method = 'b') FROM ledger
        UNION ALL SELECT 'rounds', count(*) FILTER (method = 'a'), count(*) FILTER (method = 'b') FROM ledger
        UNION ALL SELECT 'fault_round_time',
        max(timestamp) FILTER (method = 'a' AND round = 8) - max(timestamp) FILTER (method = 'a' AND round = 7),
        max(timestamp) FILTER (method = 'b' AND round = 8) - max(timestamp) FILTER (method = 'b' AND round = 7) FROM ledger
        UNION ALL SELECT 'accuracy_drop',
        max(accuracy) FILTER (method = 'a' AND round = 7) - max(accuracy) FILTER (method = 'a' AND round = 8),
        max(accuracy) FILTER (method = 'b' AND round = 7) - max(accuracy) FILTER (method = 'b' AND round = 8) FROM ledger
        UNION ALL SELECT 'recovery_delay',
        max(timestamp) FILTER (method = 'a' AND round = 9) - max(timestamp) FILTER (method = 'a' AND round = 8),
        max(timestamp) FILTER (method = 'b' AND round = 9) - max(timestamp) FILTER (method = 'b' AND round = 8) FROM ledger)""",
        "ledger",
    ),
}
