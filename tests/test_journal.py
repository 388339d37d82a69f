"""A run that stops and goes on from its folder equals a run that never stopped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.operators.models import ModelSpec, TrainConfig
from shardloom.plans.journal import Journal, flat_model, model_table, shard_status
from shardloom.plans.rounds import RoundConfig, run_rounds
from shardloom.schemas import OUTAGES
from shardloom.session import fresh_path
from shardloom.sources.checkpoints import load_checkpoint, save_checkpoint

SPEC = ModelSpec(3, 3)


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    rows = [(i, x[i].tolist(), int(x[i].argmax()), i % 3) for i in range(300)]
    return spark.createDataFrame(rows, "sample_id long, features array<double>, label int, shard_id int").cache()


def config(path=None, rounds=4, **more):
    return RoundConfig(SPEC, TrainConfig(epochs=1), rounds, journal=path, **more)


@pytest.mark.parametrize("policy", ["any", "all"])
def test_stop_and_go_on(spark, samples, policy):
    """A shard is lost in round 2, the run stops after it, and round 3 had begun when it stopped."""
    away = spark.createDataFrame([(2, 1), (9, 0), (2, 77)], OUTAGES)
    path = fresh_path(spark, "journal")
    whole = run_rounds(samples, samples, config(policy=policy), away)
    run_rounds(samples, samples, config(path, 2, policy=policy), away)
    # what an interrupted third round leaves: everything but its commit
    broken = model_table(spark, SPEC, np.full(SPEC.size, 9.0))
    lost = spark.createDataFrame([(0, "failed")], "participant_id int, status string")
    save_checkpoint(broken, path, 3, lost)
    journal = Journal(spark, path)
    assert journal.last()["round"] == 2 and journal.last()["quorum_met"] == (policy == "any")
    result = run_rounds(samples, samples, config(path, policy=policy), away)
    assert np.allclose(result.weights, whole.weights, rtol=1e-12, atol=1e-14)
    got, want = (x.ledger.drop("timestamp").orderBy("round").collect() for x in (result, whole))
    assert [r["round"] for r in got] == [1, 2, 3, 4]
    for a, b in zip(got, want, strict=True):
        assert (a["active"], a["failed"]) == (b["active"], b["failed"]) and a["loss"] == pytest.approx(b["loss"], rel=1e-12)
    times = [r["timestamp"] for r in result.ledger.orderBy("round").collect()]
    assert times == sorted(times)
    status = {(r, s["participant_id"]): s["status"] for r in range(1, 5) for s in journal.status(r).collect()}
    assert status == {(r, s): "offline" if (r, s) == (2, 1) else "active" for r in range(1, 5) for s in range(3)}
    events = sorted((e["round"], e["event"], e["participant_id"], e["value"]) for e in journal.events().collect())
    assert events == [(2, "failure", 1, "offline"), (3, "recovery", 1, "active")]


def test_a_finished_run_is_only_read(spark, samples):
    path = fresh_path(spark, "journal")
    one = run_rounds(samples, samples, config(path, 2))
    again = run_rounds(samples, samples, config(path, 2))
    assert (one.weights == again.weights).all() and again.ledger.count() == 2


def test_failed_shard_is_marked(spark, samples):
    bad = samples.withColumn("label", F.when(F.col("sample_id") == 4, 50).otherwise(F.col("label")))
    path = fresh_path(spark, "journal")
    result = run_rounds(bad, samples, config(path, 1, units_per_shard=4))
    without = run_rounds(samples.filter("shard_id <> 1"), samples, config(None, 1, units_per_shard=4))
    assert np.allclose(result.weights, without.weights, rtol=1e-12)
    events = Journal(spark, path).events().collect()
    assert [(e["event"], e["participant_id"], e["value"]) for e in events] == [("failure", 1, "failed")]
    assert result.ledger.first()["active"] == 2


def test_silent_shard_is_offline(spark):
    shards = spark.createDataFrame([(0,), (1,), (2,), (3,)], "shard_id int")
    marks = spark.createDataFrame([(0, "success"), (1, "success"), (1, "failed"), (3, "success")], "shard_id int, status string")
    away = spark.createDataFrame([(3,)], "shard_id int")
    got = {r["participant_id"]: r["status"] for r in shard_status(shards, marks, away).collect()}
    assert got == {0: "active", 1: "failed", 2: "offline", 3: "offline"}


def test_many_shards_and_a_hot_one(spark):
    """Units spread by hash beyond the slots; a shard with a third of the rows in units of its own."""
    rows = spark.range(3000).select(
        F.col("id").alias("sample_id"), F.array(F.rand(1), F.rand(2), F.rand(3)).alias("features"),
        F.pmod("id", F.lit(3)).cast("int").alias("label"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.pmod("id", F.lit(400))).cast("int").alias("shard_id"),
    ).cache()
    few = run_rounds(rows, rows, config(None, 1, unit_rows=100, partitions=3))
    many = run_rounds(rows, rows, config(None, 1, unit_rows=100))
    assert np.allclose(few.weights, many.weights, rtol=1e-10)
    assert few.ledger.first()["active"] == rows.select("shard_id").distinct().count()


def test_model_needs_all_its_values(spark):
    path = fresh_path(spark, "journal")
    table = model_table(spark, SPEC, np.arange(SPEC.size))
    assert (flat_model(table.orderBy(F.rand(3)), SPEC) == np.arange(SPEC.size)).all()
    save_checkpoint(table.filter("pos > 0"), path, 1)
    with pytest.raises(LookupError):
        flat_model(load_checkpoint(spark, path, 1), SPEC)
