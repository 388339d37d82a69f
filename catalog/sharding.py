"""B: sharding and partitioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions.random import shuffled
from shardloom.operators import sharding as S

from .views import (
    LINE_ORDER,
    hash60,
    line_samples,
    order_samples,
    table,
    with_views,
)

_KEEP = ["sample_id", "label", "shard_id"]


def b1(spark, d):
    return S.shard_contiguous(order_samples(spark, d), 7).select(*_KEEP)


def b2(spark, d):
    return S.shard_contiguous(order_samples(spark, d), 7, remainder="drop").select(*_KEEP)


def b3(spark, d):
    return S.shard_iid(order_samples(spark, d), 6, seed=1).select(*_KEEP)


def b4(spark, d):
    return S.shard_permuted(order_samples(spark, d), 4, seed=2).select(*_KEEP)


def b5(spark, d):
    return S.shard_noniid(order_samples(spark, d), 6, seed=3).select(*_KEEP, "block_id")


def b6_label(spark, d):
    return S.shard_modulo(order_samples(spark, d), 3).select(*_KEEP)


def b6_index(spark, d):
    return S.shard_modulo(order_samples(spark, d), 3, by="index").select(*_KEEP)


def b7(spark, d):
    rows = order_samples(spark, d)
    return S.train_test_split(rows, 1000, seed=42).select("sample_id", "is_test")


def b8(spark, d):
    rows = order_samples(spark, d)
    assignment = rows.filter("state <> 'P'").select(
        "sample_id", F.pmod("owner", F.lit(5)).cast("int").alias("shard_id")
    )
    return S.to_local_index(rows.select("sample_id"), assignment)


def b9(spark, d):
    return S.shard_stats(line_samples(spark, d)).select(
        "shard_id", "n_samples", F.round("feature_min", 6).alias("feature_min"),
        F.round("feature_max", 6).alias("feature_max"), "label_min", "label_max", "n_classes",
    )


def b9_histogram(spark, d):
    return S.class_histogram(line_samples(spark, d), ["A", "N", "R"])


def b10(spark, d):
    expected = spark.range(9).select(F.col("id").cast("int").alias("shard_id"))
    return S.verify_shards(line_samples(spark, d), expected)


def b11(spark, d):
    rows = S.with_dense_index(table(spark, d, "lineitem"), LINE_ORDER)
    return rows.select("idx", "l_orderkey", "l_linenumber", "l_partkey")


def b12(spark, d):
    rows = line_samples(spark, d).select(
        "shard_id", (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("sample_id")
    )
    laid = S.colocate(rows, 8)
    return (
        laid.withColumn("_p", F.spark_partition_id())
        .groupBy("shard_id")
        .agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct("_p").alias("n_partitions"))
    )


# The same in some dozen cells and more, where the plan above has one cell up to 100,000 rows.
SMALL_CELL = 500


def b1_cells(spark, d):
    return S.shard_contiguous(order_samples(spark, d), 7, rows_per_cell=SMALL_CELL).select(*_KEEP)


def b2_cells(spark, d):
    return S.shard_contiguous(order_samples(spark, d), 7, remainder="drop", rows_per_cell=SMALL_CELL).select(*_KEEP)


def b5_cells(spark, d):
    return S.shard_noniid(order_samples(spark, d), 6, seed=3, rows_per_cell=SMALL_CELL).select(*_KEEP, "block_id")


def b8_cells(spark, d):
    rows = order_samples(spark, d)
    assignment = rows.filter("state <> 'P'").select(
        "sample_id", F.pmod("owner", F.lit(5)).cast("int").alias("shard_id")
    )
    return S.to_local_index(rows.select("sample_id"), assignment, rows_per_cell=SMALL_CELL)


def b11_cells(spark, d):
    rows = S.with_dense_index(table(spark, d, "lineitem"), LINE_ORDER, rows_per_cell=10 * SMALL_CELL)
    return rows.select("idx", "l_orderkey", "l_linenumber", "l_partkey")


QUERIES = {
    "b11_dense_index_cells": b11_cells,
    "b1_shard_contiguous_cells": b1_cells,
    "b2_shard_contiguous_drop_cells": b2_cells,
    "b5_shard_noniid_cells": b5_cells,
    "b8_to_local_index_cells": b8_cells,
    "b1_shard_contiguous": b1,
    "b2_shard_contiguous_drop": b2,
    "b3_shard_iid": b3,
    "b4_shard_permuted": b4,
    "b5_shard_noniid": b5,
    "b6_shard_modulo_label": b6_label,
    "b6_shard_modulo_index": b6_index,
    "b7_train_test_split": b7,
    "b8_to_local_index": b8,
    "b9_shard_stats": b9,
    "b9_class_histogram": b9_histogram,
    "b10_verify_shards": b10,
    "b11_dense_index": b11,
    "b12_colocate": b12,
}

_PLACED = """SELECT sample_id, label, row_number() OVER (ORDER BY {order}) - 1 AS pos,
    count(*) OVER () AS n FROM order_samples"""


def _dealt(n: int, seed) -> str:
    """Blocks of the label order and the shard each one was dealt to."""
    owner = {b: r // 2 for r, b in enumerate(shuffled(2 * n, seed))}
    return "SELECT * FROM (VALUES {}) AS t(block_id, shard_id)".format(
        ", ".join(f"({b}, {s})" for b, s in sorted(owner.items()))
    )


def _equal_parts(order: str, n: int) -> str:
    return with_views(
        f"""SELECT sample_id, label, CAST(pos // (n // {n}) AS INTEGER) AS shard_id
        FROM placed WHERE pos < {n} * (n // {n})""",
        "order_samples", placed=_PLACED.format(order=order),
    )


ORACLE = {
    "b1_shard_contiguous": with_views(
        """SELECT sample_id, label, CAST(least(pos // (n // 7), 6) AS INTEGER) AS shard_id FROM placed""",
        "order_samples", placed=_PLACED.format(order="sample_id"),
    ),
    "b2_shard_contiguous_drop": _equal_parts("sample_id", 7),
    "b3_shard_iid": _equal_parts(f"{hash60('sample_id', seed=1)}, sample_id", 6),
    "b4_shard_permuted": _equal_parts(f"{hash60('sample_id', seed=2)}, sample_id", 4),
    "b5_shard_noniid": with_views(
        """SELECT p.sample_id, p.label, d.shard_id, d.block_id FROM placed p JOIN dealt d
        ON p.pos // (p.n // 12) = d.block_id""",
        "order_samples", placed=_PLACED.format(order="label, sample_id"), dealt=_dealt(6, 3),
    ),
    "b6_shard_modulo_label": with_views(
        "SELECT sample_id, label, CAST(label % 3 AS INTEGER) AS shard_id FROM order_samples",
        "order_samples",
    ),
    "b6_shard_modulo_index": with_views(
        "SELECT sample_id, label, CAST(sample_id % 3 AS INTEGER) AS shard_id FROM order_samples",
        "order_samples",
    ),
    "b7_train_test_split": with_views(
        "SELECT sample_id, pos < 1000 AS is_test FROM placed",
        "order_samples",
        placed=_PLACED.format(order=f"{hash60('sample_id', seed=42)}, sample_id"),
    ),
    "b8_to_local_index": with_views(
        """SELECT sample_id, CAST(owner % 5 AS INTEGER) AS shard_id,
        row_number() OVER (PARTITION BY owner % 5 ORDER BY sample_id) - 1 AS local_index
        FROM order_samples WHERE state <> 'P'""",
        "order_samples",
    ),
    "b9_shard_stats": with_views(
        """SELECT shard_id, count(*) AS n_samples, round(min(list_min(features)), 6) AS feature_min,
        round(max(list_max(features)), 6) AS feature_max, min(label) AS label_min,
        max(label) AS label_max, count(DISTINCT label) AS n_classes FROM line_samples GROUP BY 1""",
        "line_samples",
    ),
    "b9_class_histogram": with_views(
        """SELECT shard_id, label, count(*) AS n_samples,
        CASE label WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS class_name
        FROM line_samples GROUP BY 1, 2""",
        "line_samples",
    ),
    "b10_verify_shards": with_views(
        """SELECT e.shard_id, coalesce(c.n, 0) AS n_samples, coalesce(c.n, 0) > 0 AS present,
        CAST(sum(coalesce(c.n, 0)) OVER () AS BIGINT) AS total_samples,
        bool_and(coalesce(c.n, 0) > 0) OVER () AS valid
        FROM (SELECT CAST(unnest(range(9)) AS INTEGER) AS shard_id) e
        LEFT JOIN (SELECT shard_id, count(*) AS n FROM line_samples GROUP BY 1) c
        ON e.shard_id = c.shard_id""",
        "line_samples",
    ),
    "b11_dense_index": f"""SELECT row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1 AS idx,
        l_orderkey, l_linenumber, l_partkey FROM lineitem""",
    "b12_colocate": with_views(
        """SELECT shard_id, count(*) AS n_samples, CAST(1 AS BIGINT) AS n_partitions
        FROM line_samples GROUP BY 1""",
        "line_samples",
    ),
}
ORACLE |= {f"{name}_cells": ORACLE[name] for name in (
    "b1_shard_contiguous", "b2_shard_contiguous_drop", "b5_shard_noniid", "b8_to_local_index", "b11_dense_index",
)}
