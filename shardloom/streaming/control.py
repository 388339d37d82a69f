"""Round control on streams: a reply to every request, and updates against the starts of their rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """``replies`` keeps its state in RocksDB; set before a stream of it starts."""
    spark.conf.set(PROVIDER, ROCKSDB)


class _FirstRequest(StatefulProcessor):
    """Of the matching requests of a participant in a round the first is accepted, the others are duplicates.

    The state of a key is whether a request was accepted. It is cleared ``keep`` seconds of event time after
    that request. Rows come in chunks; of a micro-batch only the earliest row seen so far is held back.
    """

    def __init__(self, id_column: str, keep: float):
        self.id_column, self.keep = id_column, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getValueState("taken", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken = self.taken.exists()
        first = None
        for chunk in rows:
            if not taken:
                chunk = chunk if first is None else pd.concat([first, chunk])
                chunk = chunk.sort_values(["ts", self.id_column], kind="stable")
                first, chunk = chunk.iloc[:1], chunk.iloc[1:]
            if len(chunk):
                yield chunk.drop(columns="_who", errors="ignore").assign(first=False)
        if first is not None:
            at = int(first["ts"].iloc[0].timestamp() * 1000)
            self.taken.update((at,))
            self.handle.registerTimer(at + int(self.keep * 1000))
            yield first.drop(columns="_who", errors="ignore").assign(first=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.taken.clear()
        return iter(())

    def close(self) -> None:
        pass


def replies(
    requests: DataFrame, delay: str = "10 minutes", keep: float = 3600.0, id_column: str = "request_id"
) -> DataFrame:
    """Reply to every request of a stream, in the columns of the batch form ``control.admit``.

    ``requests`` has ``id_column``, a timestamp ``ts``, ``round``, ``participant_id`` and ``expected``. Requests
    without a round are refused and those of another round rejected as they come. Of the others the first of
    a (round, participant) is accepted: the earliest of its micro-batch, where none was accepted before. A
    participant is remembered for ``keep`` seconds of event time; requests that come later than ``delay``
    behind the newest one may go unanswered, as the watermark drops them. See ``use_rocksdb``.
    """
    columns = requests.columns
    known = F.col("round").isNotNull()
    matches = F.coalesce(F.col("round") == F.col("expected"), F.lit(False))
    schema = T.StructType([*requests.schema.fields, T.StructField("first", T.BooleanType())])
    judged = (
        requests.filter(matches)
        .withColumn("_who", F.coalesce(F.col("participant_id").cast("string"), F.lit("")))
        .withWatermark("ts", delay)
        .groupBy("round", "_who")  # never null, so that requests without a participant stay together too
        .transformWithStateInPandas(_FirstRequest(id_column, keep), schema, "Append", "EventTime")
    )
    accepted = judged.select(
        *columns,
        F.when(F.col("first"), "accepted").otherwise("rejected").alias("status"),
        F.when(~F.col("first"), "duplicate_connection").alias("reason"),
        F.lit(False).alias("sync_required"),
        F.lit(None).cast("int").alias("resume_round"),
    )
    others = requests.filter(~matches).select(
        *columns,
        F.when(known, "rejected").otherwise("refused").alias("status"),
        F.when(known, "round_mismatch").otherwise("invalid_request").alias("reason"),
        known.alias("sync_required"),
        F.when(known, F.col("expected")).cast("int").alias("resume_round"),
    )
    return accepted.unionByName(others)


def deadlines(
    updates: DataFrame, starts: DataFrame, seconds: float = 30.0, horizon: float = 3600.0,
    delay: str = "10 minutes", by: tuple[str, ...] = ("round",),
) -> DataFrame:
    """Updates of a stream against the starts of their rounds, which are a stream of their own.

    An update that comes up to ``horizon`` seconds after its round's start is returned with ``round_start``
    and ``in_time``, whether it came within ``seconds``. The interval bounds the state of both sides:
    a start is forgotten when the watermark of the updates has passed its horizon, an update when
    that of the starts has passed its time. Either side may run ahead or behind by ``delay``.
    """
    limit = F.make_dt_interval(secs=F.lit(float(seconds)))
    left = updates.withWatermark("ts", delay)
    right = starts.select(*[F.col(c).alias(f"_start_{c}") for c in by], F.col("ts").alias("round_start"))
    right = right.withWatermark("round_start", delay)
    same = [F.col(c) == F.col(f"_start_{c}") for c in by]
    within = F.expr(f"ts >= round_start AND ts <= round_start + INTERVAL {float(horizon)} SECONDS")
    joined = left.join(right, [*same, within])
    in_time = F.col("ts") <= F.col("round_start") + limit
    return joined.select(*updates.columns, "round_start", in_time.alias("in_time"))
