from collections import Counter

import pytest
from pyspark.sql import functions as F

from shardloom.operators import sharding as S


def make(spark, n, labels=6):
    return spark.range(n).select(
        F.col("id").alias("sample_id"),
        F.array(F.col("id").cast("double")).alias("features"),
        F.pmod("id", F.lit(labels)).cast("int").alias("label"),
    )


def sizes(df):
    return {r["shard_id"]: r["count"] for r in df.groupBy("shard_id").count().collect()}


def test_remainder_goes_last_or_is_dropped(spark):
    df = make(spark, 10)
    assert sizes(S.shard_contiguous(df, 3)) == {0: 3, 1: 3, 2: 4}
    assert sizes(S.shard_contiguous(df, 3, "drop")) == {0: 3, 1: 3, 2: 3}


def test_fewer_rows_than_shards(spark):
    df = make(spark, 2)
    assert sizes(S.shard_contiguous(df, 3)) == {2: 2}
    assert S.shard_contiguous(df, 3, "drop").count() == 0


def test_many_cells_equal_one_cell(spark):
    df = make(spark, 2000).repartition(5)
    for cut in (S.shard_contiguous, S.shard_noniid):
        one = {r["sample_id"]: r["shard_id"] for r in cut(df, 7).collect()}
        many = {r["sample_id"]: r["shard_id"] for r in cut(df, 7, rows_per_cell=60).collect()}
        assert one == many


def test_iid_is_seeded_and_equal(spark):
    df = make(spark, 100)
    a = S.shard_iid(df, 4, seed=1)
    assert sizes(a) == {0: 25, 1: 25, 2: 25, 3: 25}
    again = {r["sample_id"]: r["shard_id"] for r in S.shard_iid(df.repartition(3), 4, seed=1).collect()}
    assert again == {r["sample_id"]: r["shard_id"] for r in a.collect()}
    other = {r["sample_id"]: r["shard_id"] for r in S.shard_iid(df, 4, seed=2).collect()}
    assert other != again


def test_noniid_deals_two_blocks_each(spark):
    got = S.shard_noniid(make(spark, 24), 3, seed=0).collect()
    assert len({r["sample_id"] for r in got}) == len(got) == 24
    blocks = {}
    for r in got:
        blocks.setdefault(r["shard_id"], Counter())[r["block_id"]] += 1
    assert all(sorted(c.values()) == [4, 4] for c in blocks.values()) and len(blocks) == 3


def test_noniid_with_one_label_for_most_rows(spark):
    df = make(spark, 1000).withColumn("label", F.when(F.col("sample_id") < 700, 0).otherwise(1))
    got = S.shard_noniid(df, 5, rows_per_cell=30)
    assert set(sizes(got).values()) == {200}


def test_modulo_by_label_or_index(spark):
    df = make(spark, 10)
    assert all(r["shard_id"] == r["label"] % 3 for r in S.shard_modulo(df, 3).collect())
    assert all(r["shard_id"] == r["sample_id"] % 3 for r in S.shard_modulo(df, 3, "index").collect())
    with pytest.raises(ValueError):
        S.shard_modulo(df, 3, "color")


@pytest.mark.parametrize("size", [0, 1, 137, 500])
def test_split_is_exact(spark, size):
    got = S.train_test_split(make(spark, 500), size)
    assert got.count() == 500 and got.filter("is_test").count() == size


def test_split_larger_than_the_table(spark):
    with pytest.raises(ValueError):
        S.train_test_split(make(spark, 5), 6)


def test_local_index_drops_unowned(spark):
    df = make(spark, 10)
    own = df.filter("sample_id % 2 = 0").select("sample_id", F.lit(1).alias("shard_id"))
    got = sorted((r["sample_id"], r["local_index"]) for r in S.to_local_index(df, own).collect())
    assert got == [(0, 0), (2, 1), (4, 2), (6, 3), (8, 4)]


def test_verify_shards(spark):
    df = S.shard_contiguous(make(spark, 10), 3)
    expected = spark.range(3).select(F.col("id").cast("int").alias("shard_id"))
    assert all(r["valid"] for r in S.verify_shards(df, expected, 10).collect())
    assert not any(r["valid"] for r in S.verify_shards(df, expected, 11).collect())
    more = spark.range(4).select(F.col("id").cast("int").alias("shard_id"))
    got = {r["shard_id"]: (r["n_samples"], r["present"]) for r in S.verify_shards(df, more).collect()}
    assert got[3] == (0, False)


def test_hot_shard_is_split_into_units(spark):
    df = make(spark, 3000).withColumn("shard_id", F.when(F.col("sample_id") < 2000, 0).otherwise(F.col("label")))
    units = S.with_unit(df, 250)
    assert units.count() == 3000
    assert units.groupBy("shard_id", "unit").count().agg(F.max("count")).first()[0] < 400
    laid = S.colocate(df, 8, unit_rows=250).withColumn("p", F.spark_partition_id())
    spread = laid.groupBy("shard_id", "unit").agg(F.count_distinct("p").alias("n"))
    assert spread.agg(F.max("n")).first()[0] == 1
    assert laid.filter("shard_id = 0").select("p").distinct().count() > 1


def test_shard_assignment_moves_no_rows(spark):
    df = make(spark, 100)
    plan = S.shard_iid(df, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
