"""Replies and deadlines on streams against their batch forms."""

import pytest
from pyspark.sql import functions as F

from shardloom.operators.control import admit
from shardloom.session import fresh_path
from shardloom.streaming import control as C


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(C.PROVIDER, None)
    C.use_rocksdb(spark)
    yield
    spark.conf.set(C.PROVIDER, before) if before else spark.conf.unset(C.PROVIDER)


def minutes(spark, rows, schema):
    """Rows whose ``ts`` is in minutes after a fixed time."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("ts") * 60))


def drained(spark, batches, plan, out=None, offsets=None, **more):
    """The plan over a stream in which each batch is a file."""
    path, out, offsets = fresh_path(spark, "in"), out or fresh_path(spark, "out"), offsets or fresh_path(spark, "offsets")
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)
    df = plan(stream)
    df.writeStream.option("checkpointLocation", offsets).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


SCHEMA = "request_id int, ts int, round int, participant_id int, expected int"


def requests(hot=0):
    one = [(1, 5, 1, 7, 1), (2, 3, 1, 7, 1), (3, 4, None, 7, 1), (4, 4, 1, 8, 2), (5, 4, 1, None, 1), (6, 5, 1, None, 1)]
    two = [(10, 8, 1, 7, 1), (11, 9, 1, 8, 1), (12, 9, 1, 8, 1), (13, 9, 2, 7, 2), (14, 9, 2, 7, None)]
    three = [(20 + i, 10 + i % 3, 3, i % 3 and i, 3) for i in range(hot)]
    return [x for x in (one, two, three) if x]


@pytest.mark.parametrize("hot", [0, 600])
def test_replies_equal_the_batch_form(spark, rocksdb, hot):
    """Over several batches; with a third of the requests by one participant."""
    batches = [minutes(spark, x, SCHEMA) for x in requests(hot)]
    got = drained(spark, batches, lambda s: C.replies(s, "1 hour"))
    whole = batches[0]
    for x in batches[1:]:
        whole = whole.unionByName(x)
    want = admit(whole, F.col("expected"))
    columns = ["request_id", "round", "participant_id", "status", "reason", "sync_required", "resume_round"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert got.count() == sum(x.count() for x in batches)


def test_state_is_cleared_by_its_timer(spark, rocksdb):
    """A participant is remembered for an hour: the same request a day later is a first one again."""
    day = 24 * 60
    batches = [[(1, 0, 1, 1, 1), (2, 1, 1, 1, 1)], [(3, 30, 1, 1, 1)], [(4, day, 1, 2, 1)], [(5, day + 1, 1, 3, 1)], [(6, day + 2, 1, 1, 1)]]
    got = drained(spark, [minutes(spark, x, SCHEMA) for x in batches], lambda s: C.replies(s, "10 minutes", 3600.0))
    assert {r["request_id"]: r["status"] for r in got.collect()} == {
        1: "accepted", 2: "rejected", 3: "rejected", 4: "accepted", 5: "accepted", 6: "accepted"
    }


def test_replies_after_a_restart(spark, rocksdb):
    """The stream stops between two batches and goes on from its checkpoint."""
    path, out, offsets = (fresh_path(spark, x) for x in ("in", "out", "offsets"))
    for rows in requests():
        minutes(spark, rows, SCHEMA).repartition(2).write.mode("append").parquet(path)
        stream = spark.readStream.schema("request_id int, ts timestamp, round int, participant_id int, expected int").parquet(path)
        query = C.replies(stream).writeStream.option("checkpointLocation", offsets).trigger(availableNow=True).start(out)
        query.awaitTermination()
    status = {r["request_id"]: r["reason"] for r in spark.read.parquet(out).collect()}
    assert len(status) == 11 and status[10] == "duplicate_connection" and status[11] is None and status[2] is None


def test_deadlines_against_a_stream_of_starts(spark):
    """Starts that come after their updates, late updates, and rounds without a start."""
    starts = [[(1, 0), (2, 100)], [(3, 200), (None, 5)]]
    updates = [[(1, 1, 0), (2, 1, 29), (3, 1, 31), (4, 3, 201), (5, None, 6)], [(6, 2, 130), (7, 2, 131), (8, 2, 99), (9, 4, 300), (10, 1, 90)]]
    path = fresh_path(spark, "starts")
    for rows in starts:
        minutes(spark, rows, "round int, ts int").repartition(2).write.mode("append").parquet(path)
    begun = spark.readStream.schema("round int, ts timestamp").option("maxFilesPerTrigger", 2).parquet(path)
    batches = [minutes(spark, x, "update_id int, round int, ts int") for x in updates]
    got = drained(spark, batches, lambda s: C.deadlines(s, begun, 1800, 3600, "6 hours"))
    assert {(r["update_id"], r["in_time"]) for r in got.collect()} == {
        (1, True), (2, True), (3, False), (4, True), (6, True), (7, False)
    }
