"""K: micro-batch streams over messages written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.operators.privacy import PrivacyConfig
from shardloom.session import fresh_path
from shardloom.sources.messages import (
    parse_messages,
    read_message_stream,
    to_messages,
    write_messages,
)
from shardloom.streaming import control as C
from shardloom.streaming import training as K

from .control import _admitted
from .views import hash60, normal, requests, samples, table, with_views

SIGMA = PrivacyConfig(epsilon=50.0).sigma


def _topic(spark, d):
    """Messages of the samples of 10 participants, and two texts that are none."""
    path = fresh_path(spark, "topic")
    rows = samples(spark, d).withColumn(
        "participant_id", F.pmod("sample_id", F.lit(10)).cast("int")
    )
    bad = spark.createDataFrame([("bad",), ("{}",)], "value STRING")
    write_messages(to_messages(rows, 20).select("value").unionByName(bad).coalesce(4), "text", path)
    return path


def _resources(spark, d):
    """Loads of participants 0..9 from the share of their users' events."""
    share = lambda kind: F.lit(100.0) * F.avg((F.col("event_type") == kind).cast("int"))
    return (
        table(spark, d, "events")
        .groupBy(F.pmod("user_id", F.lit(10)).cast("int").alias("participant_id"))
        .agg(
            share("error").alias("cpu_percent"),
            share("view").alias("memory_percent"),
            share("click").alias("disk_usage"),
        )
    )


def _run(spark, d, privacy=None, files_per_batch: int = 100) -> str:
    path = fresh_path(spark, "stream-state")
    cfg = K.StreamConfig(path=path, n_classes=10, privacy=privacy, noise_seed="42")
    stream = read_message_stream(
        spark, "text", _topic(spark, d), maxFilesPerTrigger=files_per_batch
    )
    query = K.start_stream(
        stream, K.train_batch(cfg, _resources(spark, d)), fresh_path(spark, "offsets"),
        available_now=True,
    )
    query.awaitTermination()
    return path


def k1(spark, d):
    """Rows and labels seen, batch by batch."""
    out = fresh_path(spark, "batches")

    def keep(batch, batch_id):
        parse_messages(batch).groupBy("label").agg(F.count(F.lit(1)).alias("n")).write.mode(
            "overwrite"
        ).parquet(f"{out}/batch_id={batch_id}")

    stream = read_message_stream(spark, "text", _topic(spark, d), maxFilesPerTrigger=2)
    query = K.start_stream(stream, keep, fresh_path(spark, "offsets"), available_now=True)
    query.awaitTermination()
    return spark.read.parquet(out).groupBy("label").agg(F.sum("n").alias("n"))


def k2(spark, d):
    rows = K.read_state(spark, _run(spark, d), "model")
    return rows.select("batch_id", "pos", F.round("value", 6).alias("value"))


def k5(spark, d):
    rows = K.read_state(spark, _run(spark, d), "metrics")
    return rows.withColumn("weights_norm", F.round("weights_norm", 6))


def _run_in_three(spark, d, privacy=None) -> str:
    """A batch for each remainder of the sample id by 3, and the second batch once more, as after a failure."""
    topic, path = fresh_path(spark, "topic"), fresh_path(spark, "stream-state")
    rows = samples(spark, d).withColumn("participant_id", F.pmod("sample_id", F.lit(10)).cast("int"))
    parts = [to_messages(rows.filter(F.col("sample_id") % 3 == b), 20).select("value") for b in range(3)]
    for part in parts:
        write_messages(part.repartition(2), "text", topic)
    cfg = K.StreamConfig(path=path, n_classes=10, privacy=privacy, noise_seed="42")
    train = K.train_batch(cfg, _resources(spark, d))
    stream = read_message_stream(spark, "text", topic, maxFilesPerTrigger=2)
    K.start_stream(stream, train, fresh_path(spark, "offsets"), available_now=True).awaitTermination()
    train(parts[1], 1)
    return path


def k5_three(spark, d):
    rows = K.read_state(spark, _run_in_three(spark, d), "metrics")
    return rows.withColumn("weights_norm", F.round("weights_norm", 6))


def k7_three(spark, d):
    return K.budget_spent(spark, _run_in_three(spark, d, PrivacyConfig(epsilon=0.5)))


def k6(spark, d):
    """The global model after a noised batch."""
    path = _run(spark, d, PrivacyConfig(epsilon=50.0))
    rows = K.global_model(spark, path)
    return rows.select("pos", F.round("value", 5).alias("value"))


def k7(spark, d):
    path = _run(spark, d, PrivacyConfig(epsilon=0.5))
    return K.budget_spent(spark, path)


def j1_stream(spark, d):
    """Accepted requests found by the streaming form of admission."""
    path, out = fresh_path(spark, "requests"), fresh_path(spark, "accepted")
    rows = requests(spark, d).select(
        "request_id", F.col("ts").cast("timestamp").alias("ts"), "round", "participant_id",
        F.col("day").alias("expected"),
    )
    rows.repartitionByRange(1, "ts").sortWithinPartitions("ts").write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    query = (
        K.admit_stream(stream, "2 days")
        .writeStream.format("parquet")
        .option("checkpointLocation", fresh_path(spark, "offsets"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select("round", "participant_id")


def j2_stream(spark, d):
    path, out = fresh_path(spark, "arrivals"), fresh_path(spark, "in-time")
    rows = requests(spark, d).select("request_id", F.col("ts").cast("timestamp").alias("ts"), "day")
    starts = rows.groupBy("day").agg(F.min("ts").alias("round_start"))
    rows.join(starts, "day").write.parquet(path)
    stored = spark.read.parquet(path)
    query = (
        K.within_deadline_stream(spark.readStream.schema(stored.schema).parquet(path), 7200)
        .select("request_id", "day")
        .writeStream.format("parquet")
        .option("checkpointLocation", fresh_path(spark, "offsets"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema("request_id BIGINT, day INT").parquet(out)


def _arrivals(rows, name: str, cuts: list[int]) -> str:
    """Rows as files that come one after another, several at a time: by day, up to each cut."""
    path = fresh_path(rows.sparkSession, name)
    for low, high in zip([0, *cuts], [*cuts, 1000], strict=True):
        part = rows.filter((F.col("day") > low) & (F.col("day") <= high))
        part.repartition(4).write.mode("append").parquet(path)
    return path


def _drained(df, out: str):
    query = (
        df.writeStream.format("parquet").option("checkpointLocation", fresh_path(df.sparkSession, "offsets"))
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def j1_replies(spark, d):
    """A reply to every request, over micro-batches of four files."""
    rows = requests(spark, d).select(
        "request_id", F.col("ts").cast("timestamp").alias("ts"), "round", "participant_id",
        F.col("day").alias("expected"), "day",
    )
    path = _arrivals(rows, "requests", [10, 20])
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)
    before = spark.conf.get(C.PROVIDER, None)
    C.use_rocksdb(spark)
    try:
        found = _drained(C.replies(stream, "2 days", 10 * 86400.0), fresh_path(spark, "replies"))
    finally:
        spark.conf.set(C.PROVIDER, before) if before else spark.conf.unset(C.PROVIDER)
    return found.select(
        "request_id", "participant_id", F.coalesce("round", F.lit(-1)).alias("round"), "expected", "status",
        F.coalesce("reason", F.lit("")).alias("reason"), "sync_required", F.coalesce("resume_round", F.lit(-1)).alias("resume_round"),
    )


def j2_deadlines(spark, d):
    """Requests against a stream of round starts: each day's start is that of its first request."""
    rows = requests(spark, d).select("request_id", F.col("ts").cast("timestamp").alias("ts"), "day")
    starts = rows.groupBy("day").agg(F.min("ts").alias("ts"))
    read = lambda df, name, cuts: (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(_arrivals(df, name, cuts))
    )
    found = C.deadlines(
        read(rows, "arrivals", [9, 18]), read(starts, "starts", [9, 18]), 7200, 86400, "2 days", ("day",)
    )
    return _drained(found, fresh_path(spark, "judged")).select("request_id", "day", "in_time")


QUERIES = {
    "j1_replies_stream": j1_replies,
    "j2_deadlines_stream": j2_deadlines,
    "k1_start_stream": k1,
    "k2_train_batch": k2,
    "k5_batch_metrics": k5,
    "k5_metrics_of_three_batches": k5_three,
    "k7_budget_of_three_batches": k7_three,
    "k6_update_global_model": k6,
    "k7_budget_across_batches": k7,
    "j1_admit_stream": j1_stream,
    "j2_within_deadline_stream": j2_stream,
}

_SELECT = dict(
    people="SELECT *, CAST(sample_id % 10 AS INTEGER) AS participant_id FROM sample_cells",
    label_counts="SELECT participant_id, label, count(*) AS c FROM people WHERE pos = 0 GROUP BY 1, 2",
    shares="""SELECT participant_id, c, c / CAST(sum(c) OVER (PARTITION BY participant_id) AS DOUBLE) AS p
    FROM label_counts""",
    quality="SELECT participant_id, -sum(p * log2(p)) AS q, sum(c) AS n FROM shares GROUP BY 1",
    loads="""SELECT CAST(user_id % 10 AS INTEGER) AS participant_id,
    avg(CAST(event_type = 'error' AS INTEGER)) AS cpu, avg(CAST(event_type = 'view' AS INTEGER)) AS mem
    FROM events GROUP BY 1""",
    ranked=f"""SELECT q.participant_id, q.n, row_number() OVER (ORDER BY
    round(0.4::DOUBLE * (1 - cpu) + 0.3::DOUBLE * (1 - mem) + 0.3::DOUBLE * q, 9) DESC,
    {hash60('q.participant_id', seed=42)}, q.participant_id) AS rank, count(*) OVER () AS total
    FROM quality q JOIN loads l ON q.participant_id = l.participant_id""",
    chosen="""SELECT participant_id, n FROM ranked
    WHERE rank <= greatest(2, CAST(floor(total * 0.5) AS BIGINT))""",
    cells="""SELECT participant_id AS g, label, pos, x FROM people
    WHERE participant_id IN (SELECT participant_id FROM chosen)
    UNION ALL SELECT participant_id, label, -1, 1.0 FROM people
    WHERE pos = 0 AND participant_id IN (SELECT participant_id FROM chosen)""",
    sums="SELECT g, label, pos, sum(x) AS s FROM cells GROUP BY 1, 2, 3",
    totals="""SELECT g, pos, sum(s) AS t, count(*) AS k,
    (SELECT count(*) FROM cells c WHERE c.g = sums.g AND c.pos = -1) AS n FROM sums GROUP BY 1, 2""",
    grid="SELECT t.*, c.label FROM totals t, (SELECT CAST(unnest(range(10)) AS INTEGER) AS label) c",
    graded="""SELECT g.g, g.label, g.pos, CASE WHEN s.s IS NULL THEN 0
    ELSE (g.t / g.k - s.s) / g.n END AS v
    FROM grid g LEFT JOIN sums s ON s.g = g.g AND s.pos = g.pos AND s.label = g.label""",
    norms="SELECT g, sqrt(sum(v * v)) AS norm FROM graded GROUP BY 1",
    mean="""SELECT CAST(label * 64 + pos AS INTEGER) AS pos,
    sum(-d.v / m.norm) / (SELECT count(*) FROM chosen) AS value
    FROM graded d JOIN norms m ON m.g = d.g WHERE d.pos >= 0 GROUP BY 1""",
)

def _in_three(sql: str) -> str:
    """The query over each of three batches by the remainder of the sample id."""
    people = _SELECT["people"]
    return " UNION ALL ".join(
        "SELECT * FROM ("
        + with_views(sql.format(b=b), "sample_cells", **(_SELECT | {"people": f"{people} WHERE sample_id % 3 = {b}"}))
        + ")"
        for b in range(3)
    )


ORACLE = {
    "k1_start_stream": with_views("SELECT label, count(*) AS n FROM samples GROUP BY 1", "samples"),
    "k2_train_batch": with_views(
        "SELECT CAST(0 AS BIGINT) AS batch_id, pos, round(value, 6) AS value FROM mean",
        "sample_cells", **_SELECT,
    ),
    "k5_batch_metrics": with_views(
        """SELECT CAST(0 AS BIGINT) AS batch_id, count(*) AS n_selected, count(*) AS n_updates,
        CAST(sum(n) AS BIGINT) AS n_samples,
        (SELECT round(sqrt(sum(value * value)), 6) FROM mean) AS weights_norm,
        0.0::DOUBLE AS privacy_spent FROM chosen""",
        "sample_cells", **_SELECT,
    ),
    "k5_metrics_of_three_batches": _in_three(
        """SELECT CAST({b} AS BIGINT) AS batch_id, count(*) AS n_selected, count(*) AS n_updates,
        CAST(sum(n) AS BIGINT) AS n_samples,
        (SELECT round(sqrt(sum(value * value)), 6) FROM mean) AS weights_norm, 0.0::DOUBLE AS privacy_spent FROM chosen"""
    ),
    "k7_budget_of_three_batches": "SELECT *, sum(epsilon) OVER (ORDER BY batch_id) AS spent FROM ("
    + _in_three(
        "SELECT CAST({b} AS BIGINT) AS batch_id, count(*) AS n_updates, count(*) * 0.5::DOUBLE AS epsilon FROM chosen"
    ) + ")",
    "k6_update_global_model": with_views(
        """SELECT CAST(i AS INTEGER) AS pos, round(sum(w + z) / count(*), 5) AS value FROM noised GROUP BY 1""",
        "sample_cells", **_SELECT,
        noised=f"""SELECT g, label * 64 + pos AS i, w, {SIGMA!r}::DOUBLE * {normal('label * 64 + pos', 'g', seed='42|0')} AS z
        FROM (SELECT d.g, d.label, d.pos, -d.v / m.norm AS w FROM graded d JOIN norms m ON m.g = d.g WHERE d.pos >= 0)""",
    ),
    "k7_budget_across_batches": with_views(
        """SELECT CAST(0 AS BIGINT) AS batch_id, count(*) AS n_updates, count(*) * 0.5::DOUBLE AS epsilon,
        count(*) * 0.5::DOUBLE AS spent FROM chosen""",
        "sample_cells", **_SELECT,
    ),
    "j1_replies_stream": with_views(
        """SELECT request_id, participant_id, coalesce(round, -1) AS round, expected, status, reason,
        sync_required, CASE WHEN sync_required THEN expected ELSE -1 END AS resume_round FROM replies""",
        "requests", **_admitted("day"),
    ),
    "j2_deadlines_stream": with_views(
        """SELECT request_id, day, ts <= s + INTERVAL 7200 SECONDS AS in_time
        FROM (SELECT *, min(ts) OVER (PARTITION BY day) AS s FROM requests)""",
        "requests",
    ),
    "j1_admit_stream": with_views(
        "SELECT DISTINCT round, participant_id FROM requests WHERE round = day", "requests"
    ),
    "j2_within_deadline_stream": with_views(
        """SELECT request_id, day FROM (SELECT *, min(ts) OVER (PARTITION BY day) AS s
        FROM requests) WHERE ts <= s + INTERVAL 7200 SECONDS""",
        "requests",
    ),
}
