"""Shards that pass through their task batch by batch train like shards that fit it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.operators import training as E
from shardloom.operators.models import ModelSpec, TrainConfig


@pytest.fixture(scope="module")
def samples(spark):
    """A third of the rows in shard 0, 28 shards, one of a single row."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 4))
    rows = [
        (i, x[i].tolist(), int(x[i, :3].argmax()), 0 if i % 3 == 0 else 99 if i == 1 else i % 39) for i in range(3000)
    ]
    return spark.createDataFrame(rows, "sample_id long, features array<double>, label int, shard_id int").cache()


def collect(df):
    return {r["shard_id"]: r for r in df.collect()}


@pytest.mark.parametrize("kind, opt", [("softmax", "sgd"), ("mlp", "sgd"), ("mlp", "adam")])
@pytest.mark.parametrize("batch, arrow", [(64, 10_000), (17, 50)])
def test_stream_equals_group(spark, samples, kind, opt, batch, arrow):
    """Also with Arrow batches smaller than the shards, and mini-batches across their borders."""
    spec = ModelSpec(4, 3, kind, hidden=8)
    cfg = TrainConfig(opt=opt, lr=0.05, epochs=3, batch=batch, order="keyed", weight_decay=0.01)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, arrow)
    try:
        got = collect(E.train_stream(samples, spec, cfg, round_no=2, partitions=5))
    finally:
        spark.conf.set(name, before)
    want = collect(E.train_local(samples, spec, cfg, round_no=2))
    assert set(got) == set(want) and len(got) == 28
    for shard, row in want.items():
        assert got[shard]["n_samples"] == row["n_samples"] and got[shard]["status"] == "success"
        assert np.allclose(got[shard]["weights"], row["weights"], rtol=1e-9, atol=1e-12)
        assert np.allclose(got[shard]["epoch_losses"], row["epoch_losses"], rtol=1e-9)


def test_memory_is_a_batch(spark, samples, monkeypatch):
    """However long a shard is, no more rows wait than a mini-batch and an Arrow batch have."""
    import pyarrow as pa

    spec, cfg = ModelSpec(4, 3), TrainConfig(epochs=1, batch=64, order="keyed")
    model = E._Sequence(0, spec, cfg, 0.01, spec.initial(), 1, "raise")
    most = 0
    for _ in range(200):
        x = pa.array(np.random.default_rng(1).normal(size=(100, 4)).tolist())
        model.add(0, x, pa.array([0] * 100, pa.int32()))
        most = max(most, len(model.y))
    assert most < 64 and model.update(1)["n_samples"] == 20_000


def test_bad_shards_fail_alone(spark, samples):
    spec, cfg = ModelSpec(4, 3), TrainConfig(epochs=2, order="keyed")
    bad = samples.withColumn("label", F.when(F.col("sample_id") == 4, 7).otherwise(F.col("label"))).withColumn(
        "features", F.when(F.col("sample_id") == 5, F.array(F.lit(1.0))).otherwise(F.col("features"))
    )
    got, want = collect(E.train_stream(bad, spec, cfg)), collect(E.train_local(samples, spec, cfg))
    assert {s for s, r in got.items() if r["status"] == "failed"} == {4, 5}
    assert got[4]["error"] == "ValueError: label outside 0..2" and got[5]["weights"] is None and got[4]["n_samples"] == 0
    assert np.allclose(got[0]["weights"], want[0]["weights"])
    with pytest.raises(Exception, match="label outside"):
        E.train_stream(bad, spec, cfg, on_failure="raise").collect()
    with pytest.raises(ValueError):
        E.train_stream(samples, spec, TrainConfig())


def test_no_rows_and_no_shard(spark, samples):
    spec, cfg = ModelSpec(4, 3), TrainConfig(epochs=1, order="keyed")
    assert E.train_stream(samples.limit(0), spec, cfg).collect() == []
    lost = samples.withColumn("shard_id", F.when(F.col("shard_id") > 0, F.col("shard_id")))
    got = collect(E.train_stream(lost, spec, cfg))
    assert None in got and got[None]["n_samples"] == 1000 and 0 not in got


def test_an_epoch_does_not_copy_the_unit():
    """Training holds an order and some mini-batches of it besides the samples, not all of them once more."""
    import tracemalloc

    from shardloom.operators.models import train

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(400_000, 4)), rng.integers(0, 3, 400_000)
    spec, cfg = ModelSpec(4, 3), TrainConfig(epochs=1, batch=256)
    tracemalloc.start()
    got, losses = train(spec, cfg, 0.1, spec.initial(), x, y, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6 < x.nbytes + y.nbytes
    order = np.random.default_rng(5).permutation(len(y))  # as a whole
    want, same = train(spec, cfg, 0.1, spec.initial(), x, y, 5, [order])
    assert (got == want).all() and losses == same


@pytest.mark.parametrize("n", [0, 1, 63, 5000])
def test_rows_beyond_memory_lie_in_files(monkeypatch, n):
    from shardloom.operators import models

    rng = np.random.default_rng(n)
    x, y = rng.normal(size=(n, 4)), rng.integers(0, 3, n).astype(np.int32)
    found = []
    for most in (models.IN_MEMORY, 1000):
        monkeypatch.setattr(models, "IN_MEMORY", most)
        rows = models.Rows(4)
        for a in range(0, n, 17):
            rows.add(x[a : a + 17], y[a : a + 17])
        assert (rows.files is None) == (n < 40 or most > 1000)
        a, b = rows.arrays()
        assert (a == x).all() and (b == y).all() and len(b) == n
        found.append(models.permutation(np.random.default_rng(2), n))
    assert (found[0] == found[1]).all()


@pytest.mark.parametrize("kind", ["softmax", "mlp"])
@pytest.mark.parametrize("most, arrow", [(64 << 20, 10_000), (2000, 70)])
def test_rounds_train_units_as_they_pass(spark, samples, monkeypatch, kind, most, arrow):
    """A round gives the mean of the shards' own models, with units in memory or in files, in small Arrow batches
    or large; a unit with a vector too short, a label missing or out of range fails its shard, and only that."""
    from shardloom.operators import models
    from shardloom.plans.rounds import RoundConfig, run_rounds

    monkeypatch.setattr(models, "IN_MEMORY", most)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, arrow)
    label = F.when(F.col("sample_id") == 4, 7).when(F.col("sample_id") != 7, F.col("label"))
    short = F.when(F.col("sample_id") == 5, F.array(F.lit(1.0))).otherwise(F.col("features"))
    bad = samples.withColumn("label", label).withColumn("features", short)
    spec, cfg = ModelSpec(4, 3, kind, hidden=8), TrainConfig(epochs=2)
    try:
        got = run_rounds(bad, samples, RoundConfig(spec, cfg, 1))
    finally:
        spark.conf.set(name, before)
    own = [r for s, r in collect(E.train_local(samples, spec, cfg)).items() if s not in (4, 5, 7)]
    want = np.average([r["weights"] for r in own], axis=0, weights=[r["n_samples"] for r in own])
    assert np.allclose(got.weights, want, rtol=1e-10, atol=1e-12)
    row = got.ledger.first()
    assert (row["active"], row["failed"]) == (25, 3)
