"""Positions, cut keys and look-back blocks against brute force, with many
small cells and with one group that holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shardloom.operators.joins import join_on, small_side, spread_join
from shardloom.operators.positions import (
    count_reached,
    keys_at,
    sampled_bounds,
    with_carried,
    with_position,
)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    data = []
    for i in range(3000):
        group = "hot" if rng.random() < 0.6 else rng.choice("abcd")
        data.append((group, rng.randrange(40), float(rng.randrange(5)), i))
    rng.shuffle(data)
    return spark.createDataFrame(data, "g STRING, k INT, x DOUBLE, id BIGINT").repartition(6).cache()


def test_bounds_cover_many_cells(table):
    n, bounds = sampled_bounds(table, ["k", "id"], rows_per_cell=50)
    assert n == 3000 and len(bounds) > 20 and bounds == sorted(bounds)


def test_bounds_use_the_shortest_prefix(table):
    _, by_id = sampled_bounds(table, ["id", "k"], rows_per_cell=50)
    assert all(len(b) == 1 for b in by_id)
    _, by_x = sampled_bounds(table, ["x", "id"], rows_per_cell=50)
    assert all(len(b) == 2 for b in by_x)


@pytest.mark.parametrize("order", [["id"], ["k", "id"], ["x", "k", "id"], ["g", "id"]])
def test_global_position(table, order):
    got = with_position(table, order, total="n", rows_per_cell=50).collect()
    expected = {r["id"]: i for i, r in enumerate(sorted(table.collect(), key=lambda r: tuple(r[c] for c in order)))}
    assert len(got) == 3000
    assert all(r["position"] == expected[r["id"]] and r["n"] == 3000 for r in got)


def test_position_within_hot_group(table):
    got = with_position(table, ["k", "id"], ["g"], total="n", rows_per_cell=50).collect()
    groups = {}
    for r in table.collect():
        groups.setdefault(r["g"], []).append((r["k"], r["id"]))
    assert len(got) == 3000
    for r in got:
        members = sorted(groups[r["g"]])
        assert members[r["position"]] == (r["k"], r["id"]) and r["n"] == len(members)


def test_position_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g STRING, id INT")
    got = {r["id"]: r["position"] for r in with_position(df, ["id"], ["g"], cell=F.lit(0)).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_no_window_holds_the_hot_group(table):
    _, bounds = sampled_bounds(table, ["id"], rows_per_cell=50)
    cells = table.groupBy("g", count_reached(table, ["id"], bounds).alias("c")).count()
    assert cells.agg(F.max("count")).first()[0] < 400  # the hot group has about 1800


@pytest.mark.parametrize("rows_per_cell", [50, 100_000])
def test_keys_at(table, rows_per_cell):
    ordered = sorted((r["k"], r["id"]) for r in table.collect())
    n, keys = keys_at(table, ["k", "id"], lambda n: [0, 7, 1500, n - 1, n], rows_per_cell)
    assert n == 3000 and keys == [ordered[i] for i in (0, 7, 1500, 2999)]


@pytest.mark.parametrize("n_bounds", [0, 1, 2, 3, 7, 8, 100])
def test_count_reached(spark, n_bounds):
    df = spark.range(-5, 320)
    bounds = [(3 * i,) for i in range(n_bounds)]
    got = df.select("id", count_reached(df, ["id"], bounds).alias("c")).collect()
    assert all(r["c"] == sum(b[0] <= r["id"] for b in bounds) for r in got)


def test_count_reached_of_texts_and_times(spark):
    df = spark.sql(
        "SELECT * FROM VALUES ('it''s', TIMESTAMP_NTZ'2024-01-01 00:00:00.5'), "
        "('zz', TIMESTAMP_NTZ'2024-01-02') AS t(s, ts)"
    )
    bounds = [tuple(r) for r in df.orderBy("s").collect()]
    got = df.select("s", count_reached(df, ["s", "ts"], bounds).alias("c")).collect()
    assert {r["s"]: r["c"] for r in got} == {"it's": 1, "zz": 2}
    by_time = [(r[1],) for r in df.orderBy("ts").collect()]
    got = df.select(count_reached(df, ["ts"], by_time).alias("c")).collect()
    assert sorted(r["c"] for r in got) == [1, 2]


@pytest.mark.parametrize("span", [3, 10, 4096])
def test_look_back_blocks(spark, span):
    rng = random.Random(1)
    rounds = sorted(rng.sample(range(1, 200), 60))
    df = spark.createDataFrame(
        [(m, r, float(r * r % 17)) for m in "ab" for r in rounds], "m STRING, round INT, v DOUBLE"
    )
    blocks, partition = with_carried(df, ["m"], "round", halo=2, span=span)
    w = Window.partitionBy(*partition).orderBy("_pos").rowsBetween(-2, 0)
    got = blocks.withColumn("s", F.sum("v").over(w)).filter(~F.col("_carried")).collect()
    assert len(got) == 120
    values = [float(r * r % 17) for r in rounds]
    for r in got:
        i = rounds.index(r["round"])
        assert r["s"] == sum(values[max(0, i - 2) : i + 1])


def test_small_side_is_checked(spark):
    small = small_side(spark.range(10), max_rows=10)
    assert "ResolvedHint (strategy=broadcast)" in small._jdf.queryExecution().analyzed().toString()
    assert small_side(spark.range(11), max_rows=10) is None


@pytest.mark.parametrize("max_rows", [3, 1000])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join(spark, table, max_rows, how):
    right = table.filter("g IN ('hot', 'a')").groupBy("g", "k").agg(F.max("x").alias("top"))
    got = spread_join(table, right, ["g", "k"], how, max_rows=max_rows)
    expected = table.join(right, ["g", "k"], how)
    assert sorted(map(repr, got.select(expected.columns).collect())) == sorted(map(repr, expected.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("_salt" in plan) == (max_rows == 3)


def test_rows_are_shuffled_once(spark, table):
    """Window and join of a position share one exchange of the rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for within in ([], ["g"]):
            placed = with_position(table, ["id"], within, rows_per_cell=50)
            plan = placed._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
            wide = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
            assert len(wide) == 1, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_join_on_matches_nulls(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k STRING, a INT")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k STRING, b INT")
    got = sorted((r["a"], r["b"]) for r in join_on(a, b, ["k"]).collect())
    assert got == [(1, 10), (2, 20)]


def test_null_and_nan_keys_keep_their_place_at_every_cell_size(spark):
    keys = [None, None, float("nan"), 2.0, None, -1.0, 7.5, float("nan"), 2.0, 0.0] * 30
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k double").repartition(4)
    whole, cut = (
        {r["id"]: r["position"] for r in with_position(df, ["k", "id"], rows_per_cell=n).collect()} for n in (1000, 7)
    )
    assert whole == cut and sorted(cut.values()) == list(range(300))
    assert keys_at(df, ["k", "id"], lambda n: [0, 89, 90, n - 1], rows_per_cell=7)[1][:3] == [(None, 0), (None, 294), (-1.0, 5)]
