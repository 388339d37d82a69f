import pytest
from pyspark.sql import functions as F

from shardloom.session import fresh_path
from shardloom.sources import checkpoints, ledgers, messages
from shardloom.sources import samples as files


def write_text(spark, name, *lines):
    path = fresh_path(spark, name)
    spark.createDataFrame([("\n".join(lines),)], "value STRING").coalesce(1).write.text(path)
    return path


def test_dirty_ledger(spark):
    path = write_text(
        spark, "dirty",
        "Round,Timestamp,Accuracy,Loss", "1,1.5,90,0.0l", "2,2.5,91,abc", "3,3.5,92,", "x,4.5,93,0.1",
        "5.0,6.5,94,NaN",
    )
    got = ledgers.read_ledger(spark, path).collect()
    assert [(r["round"], r["timestamp"], r["accuracy"], r["loss"]) for r in got] == [(1, 1.5, 90.0, 0.01)]


def test_wide_ledger_columns(spark):
    path = write_text(
        spark, "wide",
        "Round,Timestamp,Accuracy,Loss,Active_Partitions,Failed_Partitions,Mode", "5,9.5,84.3,0.5,1,1,exp1",
    )
    r = ledgers.read_ledger(spark, path, "rdd").first()
    assert (r["active"], r["failed"], r["mode"], r["method"]) == (1, 1, "exp1", "rdd")


def test_history_headers(spark):
    good = write_text(spark, "good", "Round,Accuracy", "1,90.5", "2,91.5")
    assert [tuple(r) for r in ledgers.load_history(spark, good).collect()] == [(1, 90.5), (2, 91.5)]
    other = write_text(spark, "other", "round,acc", "1,90.5")
    assert ledgers.load_history(spark, other).count() == 0
    assert ledgers.load_history(spark, fresh_path(spark, "none")).count() == 0


def test_csv_round_trip(spark):
    path = fresh_path(spark, "csv")
    df = spark.createDataFrame([(3, [0.1, 1e-7])], "label INT, features ARRAY<DOUBLE>")
    files.write_label_csv(df, path, 2)
    assert files.read_label_csv(spark, path, 2).collect() == df.collect()


def test_broken_messages(spark):
    good = spark.range(250).select(
        F.lit(4).alias("participant_id"), F.col("id").alias("sample_id"),
        F.array(F.col("id") / 2).alias("features"), F.pmod("id", F.lit(10)).cast("int").alias("label"),
    )
    texts = messages.to_messages(good, 100)
    assert sorted(r["message_no"] for r in texts.collect()) == [0, 1, 2]
    bad = spark.createDataFrame([("bad",), ("{}",), (None,), ('{"participant_id": 3}',)], "value STRING")
    assert messages.parse_messages(bad).count() == 0
    both = messages.parse_messages(texts.select("value").unionByName(bad)).collect()
    assert sorted((r["features"][0], r["label"]) for r in both) == [(i / 2, i % 10) for i in range(250)]


def test_many_messages_of_one_participant(spark):
    hot = spark.range(2000).select(
        F.when(F.col("id") < 1800, 1).otherwise(2).alias("participant_id"), F.col("id").alias("sample_id"),
        F.array(F.lit(1.0)).alias("features"), F.lit(0).alias("label"),
    )
    texts = messages.to_messages(hot, 50, rows_per_cell=100)
    counts = {r["participant_id"]: r["count"] for r in texts.groupBy("participant_id").count().collect()}
    assert counts == {1: 36, 2: 4}
    assert messages.parse_messages(texts).count() == 2000


def test_checkpoint_of_one_round_is_replaced_alone(spark):
    path = fresh_path(spark, "cp")
    model = lambda v: spark.createDataFrame([("w", 0, v)], "layer STRING, pos INT, value DOUBLE")
    for r, v in ((1, 1.0), (2, 2.0), (1, 5.0)):
        checkpoints.save_checkpoint(model(v), path, r)
    got = {r["round"]: r["value"] for r in checkpoints.read_checkpoints(spark, path).collect()}
    assert got == {1: 5.0, 2: 2.0}
    plan = checkpoints.read_checkpoints(spark, path).filter("round = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(round" in plan


def test_reading_one_shard_prunes(spark):
    path = fresh_path(spark, "shards")
    df = spark.range(90).select(
        F.col("id").alias("sample_id"), F.array(F.lit(1.0)).alias("features"), F.lit(0).alias("label"),
        F.pmod("id", F.lit(3)).cast("int").alias("shard_id"),
    )
    files.write_shards(df, path, rows_per_file=10)
    one = files.read_shard(spark, path, 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 30 and "PartitionFilters: [isnotnull(shard_id" in plan
    assert files.read_shard(spark, path).count() == 90


def test_history_append_adds_the_last_round(spark):
    path = fresh_path(spark, "hist")
    df = spark.createDataFrame([(1, 50.0), (2, 60.0)], "round INT, accuracy DOUBLE")
    ledgers.save_history(df.filter("round = 1"), path)
    ledgers.save_history(df, path, "append")
    assert sorted(tuple(r) for r in ledgers.load_history(spark, path).collect()) == [(1, 50.0), (2, 60.0)]


def test_failure_log_time_is_now(spark):
    import time

    path = fresh_path(spark, "log")
    ev = spark.createDataFrame([(3, "node_failure", 7, "offline")], "round INT, event STRING, participant_id INT, value STRING")
    ledgers.append_failure_event(ev, path)
    ledgers.append_failure_event(ev.withColumn("ts", F.lit(1.0)), path)
    times = sorted(r["ts"] for r in ledgers.read_failure_log(spark, path).collect())
    assert times[0] == 1.0 and abs(times[1] - time.time()) < 600


def test_missing_checkpoint(spark):
    path = fresh_path(spark, "cp")
    checkpoints.save_checkpoint(
        spark.createDataFrame([("w", 0, 1.0)], "layer STRING, pos INT, value DOUBLE"), path, 1
    )
    with pytest.raises(LookupError):
        checkpoints.load_checkpoint(spark, path, 2)
