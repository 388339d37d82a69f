import pytest
from pyspark.sql import functions as F

from shardloom.operators.privacy import PrivacyConfig
from shardloom.session import fresh_path
from shardloom.sources.messages import read_message_stream, to_messages, write_messages
from shardloom.streaming import training as K


@pytest.fixture(scope="module")
def texts(spark):
    """Six participants with 40 samples of two classes each."""
    rows = spark.range(240).select(
        F.pmod("id", F.lit(6)).cast("int").alias("participant_id"), F.col("id").alias("sample_id"),
        F.array(F.sin("id"), F.cos("id")).alias("features"),
        F.pmod(F.floor(F.col("id") / 6), F.lit(2)).cast("int").alias("label"),
    )
    return to_messages(rows, 10).select("value").cache()


@pytest.fixture(scope="module")
def resources(spark):
    return spark.range(6).select(
        F.col("id").cast("int").alias("participant_id"), (F.col("id") * 10.0).alias("cpu_percent"),
        F.lit(50.0).alias("memory_percent"), F.lit(10.0).alias("disk_usage"),
    )


def state(spark, path):
    return {
        t: sorted((tuple(r) for r in K.read_state(spark, path, t).collect()), key=repr)
        for t in ("model", "budget", "metrics")
    }


def test_replayed_batch_changes_nothing(spark, texts, resources):
    path = fresh_path(spark, "state")
    run = K.train_batch(K.StreamConfig(path, n_classes=2), resources)
    run(texts, 0)
    run(texts, 1)
    before = state(spark, path)
    run(texts, 1)
    assert state(spark, path) == before
    # half of six participants, budget 1 each, in two batches
    metrics = {r[-1]: r for r in before["metrics"]}
    assert metrics[0][0] == metrics[0][1] == 3 and metrics[0][4] == 3.0 and metrics[1][4] == 6.0
    spent = [r["spent"] for r in K.budget_spent(spark, path).orderBy("batch_id").collect()]
    assert spent == [3.0, 6.0]
    assert {r["batch_id"] for r in K.global_model(spark, path).collect()} == {1}


def test_selected_are_the_least_loaded(spark, texts, resources):
    path = fresh_path(spark, "state")
    K.train_batch(K.StreamConfig(path, n_classes=2), resources)(texts, 0)
    assert {r["participant_id"] for r in K.read_state(spark, path, "budget").collect()} == {0, 1, 2}


def test_empty_batch_is_skipped(spark, texts, resources):
    path = fresh_path(spark, "state")
    K.train_batch(K.StreamConfig(path, n_classes=2), resources)(texts.limit(0), 0)
    assert K.read_state(spark, path, "metrics").count() == 0


def test_without_noise_nothing_is_spent(spark, texts, resources):
    path = fresh_path(spark, "state")
    cfg = K.StreamConfig(path, n_classes=2, privacy=None, denominator="received")
    K.train_batch(cfg, resources)(texts, 0)
    m = K.read_state(spark, path, "metrics").first()
    assert m["privacy_spent"] == 0.0 and 0 < m["weights_norm"] <= 1.0


def test_stream_of_several_batches(spark, texts, resources):
    topic, path = fresh_path(spark, "topic"), fresh_path(spark, "state")
    write_messages(texts.repartition(6), "text", topic)
    stream = read_message_stream(spark, "text", topic, maxFilesPerTrigger=2)
    run = K.train_batch(K.StreamConfig(path, n_classes=2, privacy=PrivacyConfig(epsilon=0.5)), resources)
    offsets = fresh_path(spark, "offsets")
    K.start_stream(stream, run, offsets, available_now=True).awaitTermination()
    metrics = K.read_state(spark, path, "metrics").orderBy("batch_id").collect()
    assert [m["batch_id"] for m in metrics] == [0, 1, 2]
    spent = [m["privacy_spent"] for m in metrics]
    assert spent == sorted(spent) and spent[-1] == 0.5 * sum(m["n_updates"] for m in metrics)
    # nothing new: a restarted stream runs no batch, and the session is still up
    K.start_stream(stream, run, offsets, available_now=True).awaitTermination()
    assert K.read_state(spark, path, "metrics").count() == 3


def test_processing_time_stream_stops(spark, texts):
    topic, seen = fresh_path(spark, "topic"), []
    write_messages(texts.coalesce(1), "text", topic)
    query = K.start_stream(
        read_message_stream(spark, "text", topic), lambda df, i: seen.append(df.count()),
        fresh_path(spark, "offsets"), interval=0.2,
    )
    query.processAllAvailable()
    query.stop()
    assert sum(seen) == texts.count() and spark.range(3).count() == 3
