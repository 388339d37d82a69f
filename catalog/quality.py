"""D: participant quality and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.operators import quality as Q
from shardloom.plans.selection import choose_participants

from .views import hash60, participants, resources, table, with_views


def d1(spark, d):
    rows = Q.label_entropy(participants(spark, d))
    return rows.select("participant_id", F.round("entropy", 6).alias("entropy"), "n_samples")


def d2(spark, d):
    return Q.label_histogram(participants(spark, d))


def _metrics(spark, d):
    return Q.participant_metrics(
        Q.label_entropy(participants(spark, d)), resources(spark, d)
    )


def _rounded(df, *cols):
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


def d3(spark, d):
    return _rounded(
        _metrics(spark, d), "cpu_percent", "memory_percent", "disk_usage", "data_quality_score"
    )


def d4(spark, d):
    rows = Q.participant_score(_metrics(spark, d)).select("participant_id", "score")
    return _rounded(rows, "score")


def d5(spark, d):
    rows = choose_participants(participants(spark, d), resources(spark, d), 0.5, 2, seed=42)
    return _rounded(rows.select("participant_id", "rank", "score"), "score")


def d5_grouped(spark, d):
    """Selection per region group of suppliers, scored by account balance."""
    scored = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("participant_id"), "s_nationkey", F.col("s_acctbal").alias("score")
    )
    return Q.select_participants(scored, 0.4, 1, seed=7, by=["s_nationkey"])


def d6(spark, d):
    chosen = choose_participants(participants(spark, d), resources(spark, d), 0.5, 2, seed=42)
    return Q.restrict_to(participants(spark, d), chosen)


QUERIES = {
    "d1_label_entropy": d1,
    "d2_label_histogram": d2,
    "d3_participant_metrics": d3,
    "d4_participant_score": d4,
    "d5_select_participants": d5,
    "d5_select_per_group": d5_grouped,
    "d6_restrict_to": d6,
}

_VIEWS = dict(
    counts="SELECT participant_id, label, count(*) AS c FROM participants GROUP BY 1, 2",
    shares="""SELECT participant_id, c, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY participant_id) AS p
        FROM counts""",
    entropy="""SELECT participant_id, -sum(p * log2(p)) AS entropy, CAST(sum(c) AS BIGINT) AS n_samples
        FROM shares GROUP BY 1""",
    metrics="""SELECT r.*, e.entropy AS data_quality_score FROM entropy e JOIN resources r
        ON e.participant_id = r.participant_id""",
    scored="""SELECT *, 0.4::DOUBLE * (1 - cpu_percent / 100) + 0.3::DOUBLE * (1 - memory_percent / 100)
        + 0.3::DOUBLE * data_quality_score AS score FROM metrics""",
    ranked=f"""SELECT participant_id, score, row_number() OVER (ORDER BY round(score, 9) DESC,
        {hash60('participant_id', seed=42)}, participant_id) AS rank, count(*) OVER () AS n FROM scored""",
    chosen="SELECT * FROM ranked WHERE rank <= greatest(2, CAST(floor(n * 0.5) AS BIGINT))",
)


def _sql(query: str) -> str:
    return with_views(query, "participants", "resources", **_VIEWS)


ORACLE = {
    "d1_label_entropy": _sql("SELECT participant_id, round(entropy, 6) AS entropy, n_samples FROM entropy"),
    "d2_label_histogram": with_views(
        "SELECT label, count(*) AS n_samples FROM participants GROUP BY 1", "participants"
    ),
    "d3_participant_metrics": _sql(
        """SELECT participant_id, round(cpu_percent, 6) AS cpu_percent,
        round(memory_percent, 6) AS memory_percent, round(disk_usage, 6) AS disk_usage,
        round(data_quality_score, 6) AS data_quality_score FROM metrics"""
    ),
    "d4_participant_score": _sql("SELECT participant_id, round(score, 6) AS score FROM scored"),
    "d5_select_participants": _sql("SELECT participant_id, rank, round(score, 6) AS score FROM chosen"),
    "d5_select_per_group": f"""SELECT participant_id, s_nationkey, score, rank FROM (
        SELECT s_suppkey AS participant_id, s_nationkey, s_acctbal AS score,
        row_number() OVER (PARTITION BY s_nationkey ORDER BY round(s_acctbal, 9) DESC,
        {hash60('s_suppkey', seed=7)}, s_suppkey) AS rank,
        count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
        WHERE rank <= greatest(1, CAST(floor(n * 0.4) AS BIGINT))""",
    "d6_restrict_to": _sql(
        "SELECT * FROM participants WHERE participant_id IN (SELECT participant_id FROM chosen)"
    ),
}


def flagship(spark, d):
    return d5(spark, d)
