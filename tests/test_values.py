"""Hand-computed fixtures for scalar functions, quality, averaging and privacy."""

import math

import pytest
from pyspark.sql import functions as F

from shardloom import functions as fn
from shardloom.operators import averaging as A
from shardloom.operators import features as C
from shardloom.operators import privacy as P
from shardloom.operators import quality as Q


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_vector_functions(spark):
    assert one(spark, fn.scale(arr(255, 51), 255)) == [1.0, 0.2]
    assert one(spark, fn.clip(arr(-1, 0.5, 2))) == [0.0, 0.5, 1.0]
    assert one(spark, fn.standardize_channels(arr(1, 2, 3, 4), [1, 3], [1, 2], 2)) == [0.0, 1.0, 0.0, 0.5]
    assert one(spark, fn.predict(arr(1, 3, 3))) == 1
    assert one(spark, fn.vector_norm(arr(3, 4))) == 5.0
    logp = one(spark, fn.log_softmax(arr(1000, 1000)))
    assert logp == pytest.approx([-math.log(2)] * 2)
    assert sum(map(math.exp, one(spark, fn.log_softmax(arr(0.1, -3, 2))))) == pytest.approx(1)


def test_clip_norm(spark):
    assert one(spark, fn.clip_l2(arr(3, 4), 1)) == pytest.approx([0.6, 0.8])
    assert one(spark, fn.clip_l2(arr(0.3, 0.4), 1)) == [0.3, 0.4]


def test_sigma(spark):
    assert fn.gaussian_sigma_value(1, 1e-5, 1) == pytest.approx(4.844805262605389, abs=1e-12)
    assert one(spark, fn.gaussian_sigma(1, 1e-5, 1)) == pytest.approx(4.844805262605389, abs=1e-12)


def test_lr_schedule(spark):
    got = [r["lr"] for r in spark.range(1, 12).select(fn.lr_schedule("id", 1.0).alias("lr")).collect()]
    assert got == pytest.approx([1.0] * 5 + [0.8] * 5 + [0.64])
    assert got == pytest.approx([fn.lr_at(r, 1.0) for r in range(1, 12)])


def test_normals_are_standard_and_seeded(spark):
    z = spark.range(500).select(F.explode(fn.normals(F.lit(41), F.col("id"), seed="s")).alias("z"))
    n, mean, std = z.agg(F.count("z"), F.avg("z"), F.stddev("z")).first()
    assert n == 500 * 41 and abs(mean) < 0.03 and abs(std - 1) < 0.03
    a, b, c = (
        one(spark, fn.normals(F.lit(3), F.lit(7), seed=s)) for s in (1, 1, 2)
    )
    assert a == b != c
    assert one(spark, fn.normals(F.lit(0), F.lit(7), seed=1)) == []


def test_entropy(spark):
    df = spark.createDataFrame(
        [(1, x) for x in "aabb"] + [(2, "a")] * 3, "participant_id INT, label STRING"
    )
    got = {r["participant_id"]: r["entropy"] for r in Q.label_entropy(df).collect()}
    assert got == pytest.approx({1: 1.0, 2: 0.0})


@pytest.mark.parametrize("n, k", [(1, 1), (2, 2), (3, 2), (10, 5)])
def test_selection_floor(spark, n, k):
    scored = spark.range(n).select(
        F.col("id").cast("int").alias("participant_id"), (F.col("id") * 1.0).alias("score")
    )
    got = Q.select_participants(scored, 0.5).orderBy("rank").collect()
    assert [r["participant_id"] for r in got] == list(range(n))[::-1][:k]


def test_selection_ties_follow_the_seed(spark):
    scored = spark.range(50).select(F.col("id").alias("participant_id"), F.lit(1.0).alias("score"))
    pick = lambda s: {r[0] for r in Q.select_participants(scored, 0.5, seed=s).select("participant_id").collect()}
    assert pick(1) == pick(1) != pick(2)


def test_sample_per_participant(spark):
    samples = spark.range(30).select(F.col("id").alias("sample_id"))
    people = spark.range(4).select(F.col("id").alias("participant_id"))
    for k in (1, 15, 29, 30):
        got = C.sample_per_participant(samples, people, k).collect()
        per = {}
        for r in got:
            per.setdefault(r["participant_id"], set()).add(r["sample_id"])
        assert len(got) == 4 * k and all(len(s) == k for s in per.values())
    with pytest.raises(ValueError):
        C.sample_per_participant(samples, people, 31)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 100, 101, 1000])
def test_permutation_is_one(spark, n):
    """Every place once for each key, other keys otherwise, and no window in the plan of a draw."""
    from shardloom.functions.random import permuted

    rows = spark.range(n).selectExpr("id", "explode(array(1, 2)) AS key")
    got = rows.select("key", permuted(F.col("id"), n, F.col("key"), seed=3).alias("x")).collect()
    by_key = [[r["x"] for r in got if r["key"] == k] for k in (1, 2)]
    assert all(sorted(x) == list(range(n)) for x in by_key)
    assert n < 10 or by_key[0] != by_key[1]


def test_draws_are_spread(spark):
    """Each sample is drawn about as often as any other, half of them by every participant."""
    samples = spark.range(40).select(F.col("id").alias("sample_id"))
    people = spark.range(400).select(F.col("id").alias("participant_id"))
    times = [r["count"] for r in C.sample_per_participant(samples, people, 20).groupBy("sample_id").count().collect()]
    assert len(times) == 40 and sum(times) == 8000 and 140 < min(times) and max(times) < 260


def test_many_draws_go_to_all_tasks_once(spark):
    """Draws of participants that lie in one file, more than a broadcast takes: none is repeated to meet the samples."""
    samples = spark.range(1500).selectExpr("id * 3 AS sample_id", "id AS label")
    people = spark.range(0, 100, 1, 1).select(F.col("id").alias("participant_id"))
    got = C.sample_per_participant(samples, people, 1200, seed=4)
    assert got.columns == ["sample_id", "label", "participant_id", "draw"]
    assert "salt" not in got._jdf.queryExecution().analyzed().toString()
    per = got.groupBy("participant_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("sample_id").alias("ids"), F.countDistinct("draw").alias("draws"),
        F.max("draw").alias("last"), F.sum((F.col("sample_id") != 3 * F.col("label")).cast("int")).alias("wrong"),
    ).collect()
    assert len(per) == 100 and {tuple(r)[1:] for r in per} == {(1200, 1200, 1200, 1200, 0)}
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_draws_of_repeated_and_null_ids(spark):
    """A draw of a repeated id gives all its rows, one of a null id none; a null participant draws by its own key."""
    samples = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "sample_id LONG, label STRING")
    people = spark.createDataFrame([(7,), (None,)], "participant_id INT")
    got = C.sample_per_participant(samples, people, 4).select("participant_id", "sample_id", "label").collect()
    each = [(1, "a"), (1, "a"), (1, "b"), (1, "b"), (2, "d")]
    assert sorted(map(tuple, got), key=repr) == sorted([(p, *x) for p in (7, None) for x in each], key=repr)


@pytest.mark.parametrize("n", [12, 1000])
def test_permutation_by_hand(spark, n):
    """Each place as a plain loop of one md5 a round sends it; null places stay null, a null key leaves no bar."""
    from hashlib import md5
    from math import ceil, isqrt

    from shardloom.functions.random import permuted

    a = isqrt(n - 1) + 1
    b = ceil(n / a)

    def sent(x, key):
        l, r = divmod(x, b)
        for i in range(4):
            text = "|".join([*key, str(i), str(l if i % 2 else r), "5"])
            h = int(md5(text.encode()).hexdigest()[:8], 16)
            l, r = (l, (r + h) % b) if i % 2 else ((l + h) % a, r)
        return l * b + r if l * b + r < n else sent(l * b + r, key)

    keys = spark.createDataFrame([("x", 1), (None, 2), (None, None)], "p STRING, q INT")
    places = spark.range(n).selectExpr("id").union(spark.sql("SELECT CAST(NULL AS BIGINT) AS id"))
    got = places.crossJoin(keys).select("id", "p", "q", permuted(F.col("id"), n, F.col("p"), F.col("q"), seed=5).alias("to"))
    for x, p, q, to in got.collect():
        assert to == (None if x is None else sent(x, [str(k) for k in (p, q) if k is not None]))


def updates(spark, data):
    return spark.createDataFrame(
        data,
        "round INT, shard_id INT, layer STRING, n_samples BIGINT, status STRING, weights ARRAY<DOUBLE>",
    )


def values(df):
    return [r["value"] for r in df.orderBy("layer", "pos").collect()]


def test_weighted_and_plain_mean(spark):
    u = updates(spark, [(1, 0, "w", 1, "success", [0.0, 4.0]), (1, 1, "w", 3, "success", [4.0, 0.0])])
    assert values(A.average_weighted(u)) == [3.0, 1.0]
    assert values(A.average_stacked(u)) == [2.0, 2.0]


def test_mean_of_equal_updates_is_the_update(spark):
    w = [0.1, -2.5, 1e-9]
    u = updates(spark, [(1, s, "w", s + 1, "success", w) for s in range(5)])
    assert values(A.average_weighted(u)) == pytest.approx(w, rel=1e-12)


def test_updates_with_other_layers_are_skipped(spark):
    u = updates(
        spark,
        [
            (1, 0, "a", 1, "success", [2.0]), (1, 0, "b", 1, "success", [2.0]),
            (1, 1, "a", 1, "success", [4.0]), (1, 1, "b", 1, "success", [4.0]),
            (1, 2, "a", 1, "success", [90.0]),
            (1, 3, "a", 1, "success", [90.0]), (1, 3, "c", 1, "success", [90.0]),
        ],
    )
    assert values(A.average_unweighted(u, ["a", "b"])) == [3.0, 3.0]


def test_integer_layers_are_truncated_once(spark):
    u = updates(
        spark,
        [(1, 0, "n", 1, "success", [3.0, -1.0]), (1, 1, "n", 1, "success", [3.0, -2.0])],
    )
    types = spark.createDataFrame([("n", "int64")], "layer STRING, dtype STRING")
    assert values(A.average_typed(u, types)) == [3.0, -1.0]


def test_quorum(spark):
    u = updates(
        spark,
        [
            (1, 0, "w", 2, "success", [1.0]), (1, 1, "w", 0, "failed", None),
            (2, 0, "w", 0, "failed", None), (2, 1, "w", 0, "failed", None),
            (3, 0, "w", 1, "success", [2.0]), (3, 1, "w", 3, "success", [6.0]),
        ],
    )
    before = spark.createDataFrame(
        [(r, "w", 0, 0.1) for r in (1, 2, 3, 4)], "round INT, layer STRING, pos INT, value DOUBLE"
    )
    result = lambda policy: {
        r["round"]: (r["value"], r["source"]) for r in A.apply_quorum(u, before, policy, 2).collect()
    }
    assert result("any") == {
        1: (1.0, "averaged"), 2: (0.1, "kept"), 3: (5.0, "averaged"), 4: (0.1, "kept")
    }
    assert result("all") == {
        1: (0.1, "kept"), 2: (0.1, "kept"), 3: (5.0, "averaged"), 4: (0.1, "kept")
    }


def test_missing_shard_counts_as_failed(spark):
    u = updates(spark, [(1, 0, "w", 2, "success", [1.0]), (1, 1, "w", 0, "failed", None)])
    r = A.round_accounting(u, expected=4).first()
    assert (r["received"], r["valid"], r["failed"], r["failed_ids"], r["total_samples"]) == (2, 1, 3, "1", 2)


def test_sum_is_divided_by_selected_or_received(spark):
    u = spark.createDataFrame([([2.0],), ([4.0],)], "weights ARRAY<DOUBLE>")
    selected = spark.range(4)
    assert A.vector_sum_mean(u, "selected", selected).first()["value"] == 1.5
    assert A.vector_sum_mean(u, "received").first()["value"] == 3.0


def test_budget_runs_over_rounds(spark):
    u = updates(spark, [(r, s, "w", 1, "success", [1.0]) for r in (1, 2, 4) for s in range(r)])
    got = [(r["round"], r["epsilon"], r["spent"]) for r in P.privacy_ledger(u, 0.5).orderBy("round").collect()]
    assert got == [(1, 0.5, 0.5), (2, 1.0, 1.5), (4, 2.0, 3.5)]
    m = P.privacy_metrics(P.PrivacyConfig(epsilon=0.5, sensitivity=2), P.privacy_ledger(u, 0.5)).first()
    assert (m["privacy_spent"], m["noise_scale"]) == (3.5, 4.0)
