import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.operators import training as E
from shardloom.operators.averaging import average_weighted
from shardloom.operators.evaluation import (
    accuracy,
    cross_entropy,
    evaluate,
    evaluate_model,
    score,
    score_linear,
)
from shardloom.operators.models import ModelSpec, TrainConfig, loss_and_gradient, train, unpack
from shardloom.operators.sharding import colocate, shard_contiguous
from shardloom.plans.rounds import RoundConfig, run_rounds
from shardloom.session import fresh_path
from shardloom.sources.checkpoints import load_checkpoint

SPEC = ModelSpec(n_features=4, n_classes=3)


@pytest.fixture(scope="module")
def samples(spark):
    """Learnable: the class is the largest of the first three features."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = x[:, :3].argmax(axis=1)
    data = [(i, [float(v) for v in x[i]], int(y[i]), i % 3) for i in range(600)]
    return spark.createDataFrame(
        data, "sample_id BIGINT, features ARRAY<DOUBLE>, label INT, shard_id INT"
    ).cache()


@pytest.mark.parametrize("kind", ["softmax", "mlp"])
def test_gradient_matches_finite_differences(kind):
    spec = ModelSpec(5, 3, kind, hidden=6)
    rng = np.random.default_rng(3)
    w, x, y = spec.initial(1), rng.normal(size=(7, 5)), rng.integers(0, 3, 7)
    _, g = loss_and_gradient(spec, w, x, y)
    for i in range(spec.size):
        step = np.zeros(spec.size)
        step[i] = 1e-6
        up, down = (loss_and_gradient(spec, w + s, x, y)[0] for s in (step, -step))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_momentum_and_adam_steps():
    x, y = np.array([[1.0]]), np.array([0])
    spec, start = ModelSpec(1, 2), np.zeros(4)
    w, _ = train(spec, TrainConfig(epochs=1, momentum=0.5), 0.1, start, x, y, 0)
    assert w == pytest.approx([0.05, -0.05, 0.05, -0.05])
    w, _ = train(spec, TrainConfig(opt="adam", epochs=1), 0.1, start, x, y, 0)
    assert w == pytest.approx([0.1, -0.1, 0.1, -0.1], abs=1e-6)


def collect(df):
    return {r["shard_id"]: r for r in df.collect()}


def test_same_seed_same_weights_in_any_layout(spark, samples):
    a = collect(E.train_local(samples, SPEC, TrainConfig(epochs=2)))
    b = collect(E.train_local(samples.repartition(7), SPEC, TrainConfig(epochs=2)))
    assert {s: r["weights"] for s, r in a.items()} == {s: r["weights"] for s, r in b.items()}
    assert all(r["n_samples"] == 200 and len(r["epoch_losses"]) == 2 for r in a.values())


def test_whole_shard_is_one_sequence_of_batches(spark, samples):
    """Below the unit limit a shard's update is the plain local training."""
    cfg = TrainConfig(epochs=3, batch=16)
    start = SPEC.initial(5)
    got = collect(E.train_local(samples, SPEC, cfg, start))[1]
    rows = samples.filter("shard_id = 1").orderBy("sample_id").collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows])
    import zlib

    w, losses = train(SPEC, cfg, cfg.lr, start, x, y, [cfg.seed, 1, zlib.crc32(b"1|0")])
    assert got["weights"] == pytest.approx(list(w), rel=1e-12)
    assert got["epoch_losses"] == pytest.approx(losses)
    assert got["avg_loss"] == pytest.approx(np.mean(losses))


def test_update_of_a_large_shard_is_the_mean_of_its_units(spark, samples):
    cfg, start = TrainConfig(epochs=1), SPEC.initial(5)
    units = E.train_units(E.with_unit(samples, 40), SPEC, cfg, start).cache()
    merged = collect(E.train_local(samples, SPEC, cfg, start, unit_rows=40))
    for s in range(3):
        rows = units.filter(F.col("shard_id") == s).collect()
        assert len(rows) == 5
        n = np.array([r["n_samples"] for r in rows])
        w = np.array([r["weights"] for r in rows])
        assert merged[s]["n_samples"] == n.sum() == 200
        assert merged[s]["weights"] == pytest.approx(list((n[:, None] * w).sum(0) / n.sum()))


def test_mean_over_units_is_mean_over_shards(spark, samples):
    cfg, start = TrainConfig(epochs=1), SPEC.initial(5)
    units = E.train_units(E.with_unit(samples, 40), SPEC, cfg, start).cache()
    shards = E.train_local(samples, SPEC, cfg, start, unit_rows=40)
    a, b = (
        [r["value"] for r in average_weighted(df.drop("round")).orderBy("pos").collect()]
        for df in (units, shards)
    )
    assert a == pytest.approx(b, rel=1e-9)


def test_failure_is_captured_per_shard(spark, samples):
    broken = samples.withColumn(
        "label", F.when(F.col("sample_id") == 4, 77).otherwise(F.col("label"))
    )
    got = collect(E.train_local(broken, SPEC, TrainConfig(epochs=1), unit_rows=50))
    assert [got[s]["status"] for s in range(3)] == ["success", "failed", "success"]
    assert got[1]["n_samples"] == 0 and got[1]["weights"] is None and "label" in got[1]["error"]
    with pytest.raises(Exception, match="label outside"):
        E.train_local(broken, SPEC, TrainConfig(epochs=1), on_failure="raise").collect()


def test_wrong_width_fails(spark, samples):
    got = collect(E.train_local(samples, ModelSpec(9, 3), TrainConfig(epochs=1)))
    assert {r["status"] for r in got.values()} == {"failed"}


def test_logistic_step(spark, samples):
    rows = samples.withColumnRenamed("shard_id", "participant_id")
    got = {r["participant_id"]: r for r in E.train_logistic(rows, 3).collect()}
    mine = rows.filter("participant_id = 2").collect()
    x = np.array([r["features"] for r in mine])
    y = np.array([r["label"] for r in mine])
    _, g = loss_and_gradient(SPEC, np.zeros(SPEC.size), x, y)
    w, b = unpack(SPEC, -g / np.linalg.norm(g))
    assert got[2]["weights"] == pytest.approx(list(w.ravel()))
    assert got[2]["n_samples"] == 200


def test_logistic_binary_step(spark, samples):
    rows = samples.withColumnRenamed("shard_id", "participant_id").withColumn(
        "label", (F.col("label") == 2).cast("int")
    )
    got = E.train_logistic(rows, 2).filter("participant_id = 0").first()
    mine = rows.filter("participant_id = 0").collect()
    x = np.array([[1.0, *r["features"]] for r in mine])
    y = np.array([r["label"] for r in mine])
    g = ((0.5 - y)[:, None] * x).mean(0)
    assert got["weights"] == pytest.approx(list((-g / np.linalg.norm(g))[1:]))


def test_one_class_participant_fails_alone(spark):
    df = spark.createDataFrame(
        [(1, [1.0], 0), (1, [2.0], 0), (2, [1.0], 0), (2, [3.0], 1), (3, [1.0], 0), (3, [1.0], 7)],
        "participant_id INT, features ARRAY<DOUBLE>, label INT",
    )
    got = {r["participant_id"]: r for r in E.train_logistic(df, 3).collect()}
    assert (got[1]["status"], got[1]["weights"], got[1]["n_samples"]) == ("failed", None, 0)
    assert got[3]["status"] == "failed" and "outside" in got[3]["error"]
    assert got[2]["status"] == "success" and len(got[2]["weights"]) == 3
    assert got[2]["weights"][2] == 0.0  # a class the participant does not have


def test_minibatches_cover_every_sample_each_epoch(spark, samples):
    got = E.minibatches(samples, 64, epochs=2).collect()
    assert len(got) == 1200
    sizes = {}
    for r in got:
        sizes.setdefault((r["shard_id"], r["epoch"], r["batch"]), set()).add(r["sample_id"])
    assert sorted(len(s) for s in sizes.values()) == [8] * 6 + [64] * 18
    assert sizes[(0, 1, 0)] != sizes[(0, 2, 0)]


def test_scores_agree(spark, samples):
    w = SPEC.initial(3)
    a = score(samples, SPEC, w).orderBy("sample_id").collect()
    b = score_linear(samples, *unpack(SPEC, w)).orderBy("sample_id").collect()
    assert [r["prediction"] for r in a] == [r["prediction"] for r in b]
    assert np.allclose([r["scores"] for r in a], [r["scores"] for r in b])


def test_loss_modes(spark):
    """Losses 1, 1, 4 in batches of two: batch means 1 and 4."""
    rows = [(i, 0, [0.0, float(np.log(np.expm1(loss)))]) for i, loss in enumerate((1.0, 1.0, 4.0))]
    pred = spark.createDataFrame(rows, "sample_id BIGINT, label INT, scores ARRAY<DOUBLE>")
    assert cross_entropy(pred).first()["loss"] == pytest.approx(2.0)
    assert cross_entropy(pred, "batch_mean", 2).first()["loss"] == pytest.approx(2.5)


@pytest.fixture(scope="module")
def outages(spark):
    return spark.createDataFrame([(2, 0)], "round INT, shard_id INT")


@pytest.mark.parametrize("kind", ["softmax", "mlp"])
def test_rounds_learn(spark, samples, kind):
    spec = ModelSpec(4, 3, kind, hidden=16)
    cfg = RoundConfig(spec, TrainConfig(lr=0.1), rounds=3)
    result = run_rounds(samples, samples, cfg)
    ledger = result.ledger.orderBy("round").collect()
    assert [r["round"] for r in ledger] == [1, 2, 3]
    assert ledger[-1]["accuracy"] > 85 and ledger[-1]["loss"] < ledger[0]["loss"] + 1e-9
    assert all(r["active"] == 3 and r["failed"] == 0 for r in ledger)
    assert result.model.count() == spec.size


def test_quorum_all_keeps_the_model_bit_for_bit(spark, samples, outages):
    run = lambda rounds, policy: run_rounds(
        samples, samples, RoundConfig(SPEC, TrainConfig(epochs=1), rounds, policy), outages
    )
    one, two, any_two = run(1, "all"), run(2, "all"), run(2, "any")
    assert (one.weights == two.weights).all()
    assert not (one.weights == any_two.weights).all()
    ledger = two.ledger.orderBy("round").collect()
    assert (ledger[1]["active"], ledger[1]["failed"]) == (2, 1)
    assert ledger[0]["loss"] == ledger[1]["loss"]


def test_shard_with_one_failed_unit_is_left_out(spark, samples):
    broken = samples.withColumn(
        "label", F.when(F.col("sample_id") == 4, 77).otherwise(F.col("label"))
    )
    cfg = RoundConfig(SPEC, TrainConfig(epochs=1), 1, unit_rows=50)
    got = run_rounds(broken, samples, cfg)
    without = run_rounds(samples.filter("shard_id <> 1"), samples, cfg)
    assert np.allclose(got.weights, without.weights, rtol=1e-12)
    row = got.ledger.first()
    assert (row["active"], row["failed"]) == (2, 1)


def test_evaluation_in_the_batch_agrees(spark, samples):
    w = SPEC.initial(3)
    a, b = evaluate(score(samples, SPEC, w)).first(), evaluate_model(samples, SPEC, w).first()
    assert a["accuracy"] == b["accuracy"] and a["loss"] == pytest.approx(b["loss"])
    none = evaluate_model(samples.limit(0), SPEC, w).first()
    assert none["loss"] is None


def test_all_shards_out_keeps_the_model(spark, samples):
    out = spark.createDataFrame([(1, s) for s in range(3)], "round INT, shard_id INT")
    cfg = RoundConfig(SPEC, TrainConfig(epochs=1), 1)
    result = run_rounds(samples, samples, cfg, out)
    assert (result.weights == SPEC.initial(cfg.train.seed)).all()
    assert result.ledger.first()["failed"] == 3


def test_resume_from_checkpoint_equals_one_run(spark, samples):
    path = fresh_path(spark, "rounds")
    cfg = RoundConfig(SPEC, TrainConfig(epochs=1), 3, checkpoint_path=path, ledger_path=f"{path}-l")
    whole = run_rounds(samples, samples, cfg)
    saved = load_checkpoint(spark, path, 2).toPandas()
    start = np.concatenate(
        [saved[saved.layer == name].sort_values("pos")["value"].to_numpy() for name, _ in SPEC.layers]
    )
    rest = run_rounds(
        samples, samples, RoundConfig(SPEC, TrainConfig(epochs=1), 1, start_round=3), start=start
    )
    assert np.allclose(rest.weights, whole.weights, rtol=1e-9, atol=1e-12)
    assert spark.read.parquet(f"{path}-l").count() == 3
    with pytest.raises(LookupError):
        load_checkpoint(spark, path, 9)


def test_training_rounds_do_not_shuffle_samples(spark, samples):
    laid = colocate(samples, 8, unit_rows=100).cache()
    laid.count()
    plan = E.train_units(laid, SPEC, TrainConfig(), SPEC.initial())._jdf.queryExecution().executedPlan().toString()
    head = plan.split("InMemoryRelation")[0]
    assert "Exchange" not in head and "Sort" not in head


def test_metrics_of_shard_models(spark, samples):
    updates = E.train_local(shard_contiguous(samples.drop("shard_id"), 2), SPEC, TrainConfig(lr=0.2))
    w = updates.filter("shard_id = 0").first()["weights"]
    pred = score(samples, SPEC, w)
    assert accuracy(pred).first()["accuracy"] == evaluate(pred).first()["accuracy"] > 80


@pytest.mark.parametrize("units", [1, 3])
def test_the_unit_plan_does_not_look_at_sizes(spark, samples, units):
    """A shard's update stays the same when other shards grow far beyond it."""
    grown = samples.unionByName(
        samples.filter("shard_id = 1").crossJoin(spark.range(1, 300)).withColumn(
            "sample_id", F.col("sample_id") + F.col("id") * 1_000_000
        ).drop("id")
    )
    cfg = TrainConfig(epochs=1)
    small, large = (collect(E.train_local(x, SPEC, cfg, units_per_shard=units)) for x in (samples, grown))
    assert large[1]["n_samples"] == 60_000
    for s in (0, 2):
        assert small[s]["weights"] == large[s]["weights"]
    sizes = E.with_equal_units(grown, units).groupBy("shard_id").agg(F.count_distinct("unit").alias("n"))
    assert {r["n"] for r in sizes.collect()} == {units}
