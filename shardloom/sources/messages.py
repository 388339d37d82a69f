"""JSON sample messages: publish, subscribe, parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import ROWS_PER_CELL, with_position
from ..schemas import MESSAGE


def to_messages(
    samples: DataFrame, per_message: int = 100, rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """Samples of each participant as JSON messages of ``per_message`` samples.

    A participant of any size becomes many messages; a message is collected
    from at most ``per_message`` rows.
    """
    placed = with_position(
        samples.select("participant_id", "sample_id", "features", "label"),
        ["sample_id"], within=["participant_id"], name="_pos", rows_per_cell=rows_per_cell,
    )
    rows = F.array_sort(F.collect_list(F.struct("_pos", "features", "label")))
    return (
        placed.groupBy(
            "participant_id", F.floor(F.col("_pos") / F.lit(per_message)).alias("message_no")
        )
        .agg(rows.alias("_rows"))
        .select(
            "participant_id",
            "message_no",
            F.to_json(
                F.struct(
                    F.col("participant_id").cast("int").alias("participant_id"),
                    F.col("_rows.features").alias("features"),
                    F.col("_rows.label").alias("label"),
                )
            ).alias("value"),
        )
    )


def write_messages(messages: DataFrame, fmt: str = "text", path: str | None = None, **options) -> None:
    """Publish message values: ``kafka`` (with its options), or files."""
    writer = messages.select("value").write.format(fmt).options(**options).mode("append")
    writer.save(path) if path is not None else writer.save()


def read_message_stream(spark: SparkSession, source: str = "kafka", path: str | None = None, **options) -> DataFrame:
    """Stream of message texts in a ``value`` column.

    ``kafka`` needs its connector on the cluster. File sources serve the same
    texts: ``text``, or ``parquet`` / ``json`` with a ``value`` field.
    """
    reader = spark.readStream.format(source).options(**options)
    if source == "kafka":
        return reader.load().selectExpr("CAST(value AS STRING) AS value")
    return reader.schema("value STRING").load(path)


def parse_messages(messages: DataFrame) -> DataFrame:
    """One row per sample; texts that are no message are dropped.

    A malformed text parses to a struct of nulls, hence the filter on a field. A
    message whose arrays differ in length or hold nulls is malformed as a whole.
    """
    parsed = messages.select(F.from_json("value", MESSAGE).alias("m")).filter(
        F.col("m.participant_id").isNotNull()
        & F.col("m.features").isNotNull()
        & F.col("m.label").isNotNull()
        & (F.size("m.features") == F.size("m.label"))
        & ~F.exists("m.label", lambda y: y.isNull())
        & ~F.exists("m.features", lambda x: x.isNull() | F.exists(x, lambda v: v.isNull()))
    )
    return parsed.select(
        F.col("m.participant_id").alias("participant_id"),
        F.explode(F.arrays_zip(F.col("m.features").alias("features"), F.col("m.label").alias("label"))).alias("s"),
    ).select("participant_id", "s.features", "s.label")
