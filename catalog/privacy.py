"""G: differential privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions.rates import gaussian_sigma
from shardloom.operators import privacy as P

from .views import digest, label_updates, normal, shard_updates, samples, sql_digest, table, with_views

CFG = P.PrivacyConfig()


def g1(spark, d):
    """Noise scale per supplier: epsilon from the key, sensitivity from the balance."""
    e = (F.pmod("s_suppkey", F.lit(5)) + 1).cast("double")
    s = F.abs("s_acctbal") / 1000
    return table(spark, d, "supplier").select(
        "s_suppkey", F.round(gaussian_sigma(e, 1e-5, s), 6).alias("sigma")
    )


def g2(spark, d):
    noisy = P.add_gaussian_noise(label_updates(spark, d), CFG, seed="dp")
    return noisy.select("participant_id", *digest("weights"))


def g3(spark, d):
    rows = samples(spark, d).withColumnRenamed("features", "weights")
    return P.clip_updates(rows, 0.9).select("sample_id", *digest("weights"))


def _ledger(spark, d):
    return P.privacy_ledger(shard_updates(spark, d).filter("status = 'success'"), 0.5)


def g4(spark, d):
    return _ledger(spark, d)


def g5(spark, d):
    return P.privacy_metrics(P.PrivacyConfig(epsilon=0.5, sensitivity=2.0), _ledger(spark, d))


QUERIES = {
    "g1_gaussian_sigma": g1,
    "g2_add_gaussian_noise": g2,
    "g3_clip_l2": g3,
    "g4_privacy_ledger": g4,
    "g5_privacy_metrics": g5,
}

_NORM = "sqrt(list_sum(list_transform(features, lambda x: x * x)))"
_BUDGET = """SELECT round, n_updates, epsilon, sum(epsilon) OVER (ORDER BY round) AS spent FROM (
    SELECT round, count(*) AS n_updates, count(*) * 0.5::DOUBLE AS epsilon FROM update_heads
    WHERE status = 'success' GROUP BY 1)"""

ORACLE = {
    "g1_gaussian_sigma": """SELECT s_suppkey, round(sqrt(2.0 * ln(1.25 / 1e-5)) * (abs(s_acctbal) / 1000)
        / CAST(s_suppkey % 5 + 1 AS DOUBLE), 6) AS sigma FROM supplier""",
    "g2_add_gaussian_noise": with_views(
        f"""SELECT participant_id, {sql_digest('w')} FROM (SELECT participant_id,
        list(value + {CFG.sigma!r}::DOUBLE * {normal('pos', 'participant_id', seed='dp')} ORDER BY pos) AS w
        FROM label_means GROUP BY 1)""",
        "label_means",
    ),
    "g3_clip_l2": with_views(
        f"""SELECT sample_id, {sql_digest('w')} FROM (SELECT sample_id, CASE WHEN {_NORM} > 0.9
        THEN list_transform(features, lambda x: x * 0.9::DOUBLE / {_NORM}) ELSE features END AS w FROM samples)""",
        "samples",
    ),
    "g4_privacy_ledger": with_views("SELECT * FROM budget", "update_heads", budget=_BUDGET),
    "g5_privacy_metrics": with_views(
        """SELECT 0.5::DOUBLE AS privacy_budget, max(spent) AS privacy_spent, 4.0::DOUBLE AS noise_scale,
        1.0::DOUBLE AS clip_norm FROM budget""",
        "update_heads", budget=_BUDGET,
    ),
}
