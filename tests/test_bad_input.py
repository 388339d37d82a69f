"""Bad input is a result, not a crash."""

import pytest

from shardloom.operators.averaging import apply_quorum
from shardloom.operators.quality import select_participants
from shardloom.sources.ledgers import clean_ledger


def test_overflowing_round_is_dropped(spark):
    raw = spark.createDataFrame(
        [("1", "1.0", "90", "0.1"), ("1e12", "2.0", "91", "0.1")],
        "Round string, Timestamp string, Accuracy string, Loss string",
    )
    assert [r["round"] for r in clean_ledger(raw).collect()] == [1]


def test_missing_score_ranks_last(spark):
    scored = spark.createDataFrame([(1, None), (2, 0.1), (3, 0.9)], "participant_id int, score double")
    got = {r["participant_id"]: r["rank"] for r in select_participants(scored, ratio=1.0).collect()}
    assert got == {3: 1, 2: 2, 1: 3}


def test_all_needs_the_expected_shards(spark):
    none = spark.createDataFrame([], "round int, shard_id int, status string, weights array<double>, n_samples long")
    with pytest.raises(ValueError):
        apply_quorum(none, none, "all")


def test_a_bad_participant_fails_alone(spark):
    from shardloom.operators.training import train_logistic

    rows = [
        ("good", [1.0, 2.0], 0), ("good", [3.0, 1.0], 1),
        ("no label", [1.0, 2.0], 0), ("no label", [3.0, 1.0], None),
        ("short", [1.0, 2.0], 0), ("short", [3.0], 1),
        ("no vector", [1.0, 2.0], 0), ("no vector", None, 1),
        ("a null", [1.0, 2.0], 0), ("a null", [3.0, None], 1),
    ]
    df = spark.createDataFrame(rows, "participant_id string, features array<double>, label int")
    got = {r["participant_id"]: r["status"] for r in train_logistic(df, 2).collect()}
    assert got == {"good": "success", "no label": "failed", "short": "failed", "no vector": "failed", "a null": "failed"}


def test_a_message_with_uneven_arrays_is_dropped(spark):
    from shardloom.sources.messages import parse_messages

    def message(features, label):
        return (f'{{"participant_id": 1, "features": {features}, "label": {label}}}',)

    rows = [
        message("[[1.0], [2.0]]", "[0, 1]"), message("[[1.0], [2.0]]", "[0]"), message("[[1.0], null]", "[0, 1]"),
        message("[[1.0], [null]]", "[0, 1]"), message("[[1.0]]", "[null]"), ("no message",),
    ]
    got = parse_messages(spark.createDataFrame(rows, "value string")).collect()
    assert [(r["features"], r["label"]) for r in got] == [([1.0], 0), ([2.0], 1)]
