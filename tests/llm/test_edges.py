"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import pytest
from pyspark.sql import functions as F

from shardloom.llm.boosting import quality_scores
from shardloom.llm.decontaminate import contaminated
from shardloom.llm.jaccard import jaccard_components
from shardloom.llm.language import identify_languages
from shardloom.llm.lm import lm_scores
from shardloom.llm.mixture import mix
from shardloom.llm.pii import personal_data
from shardloom.llm.queries import tokenizer_path
from shardloom.llm.rules import quality_rules
from shardloom.llm.tokens import read_documents, write_sequences
from shardloom.llm.toxicity import toxicity_scores

LONG = "alpha beta gamma delta " * 50_000
TEXT = "one two three four five six seven eight nine ten"
ROWS = [
    (1, TEXT, "en", "a"), (2, TEXT.upper(), "en", "a"), (3, None, None, None), (4, "", "en", "b"),
    (5, " \n\t", "de", "b"), (6, LONG, "en", "a"), (None, TEXT, "en", "a"), (1, TEXT, "en", "a"),
    (8, "été ß 12", None, "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.createDataFrame(ROWS, SCHEMA).withColumns(
        {c: F.lit(9) for c in ("n", "size", "score", "band", "k1", "label")}
    )
    return extra


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 0, 1), (4, 1, 0), (6, 0, 1), (None, 1, 1), (8, None, None), (1, 1, 0)],
        "doc_id long, quality int, toxic int",
    )


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(
        [(1, TEXT, 0), (2, None, 0), (3, "", 0), (1, TEXT, 0)], "item_id long, text string, score int"
    )


OPERATORS = {
    "jaccard": lambda d, m, b: jaccard_components(d),
    "mix": lambda d, m, b: mix(d),
    "language": lambda d, m, b: identify_languages(d),
    "toxicity": lambda d, m, b: toxicity_scores(d, m),
    "rules": lambda d, m, b: quality_rules(d, m),
    "tokens": lambda d, m, b: read_documents(write_sequences(d, tokenizer_path())),
    "pii": lambda d, m, b: personal_data(d),
    "lm": lambda d, m, b: lm_scores(d),
    "quality": lambda d, m, b: quality_scores(d, m),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back(name, docs, marks, bench):
    got = OPERATORS[name](docs, marks, bench).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in got), key=key) == sorted((r[0] for r in ROWS), key=key)


@pytest.mark.parametrize("name", [*OPERATORS, "bench"])
def test_empty_tables(name, docs, marks, bench):
    none = docs.limit(0)
    run = OPERATORS.get(name, lambda d, m, b: contaminated(d, b))
    assert run(none, marks.limit(0), bench.limit(0)).collect() == []


def test_jaccard_values(docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()}
    assert got == {
        (1, 6, 1), (2, 6, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 4, 6), (None, 6, None), (8, 1, 8)
    }


def test_contaminated_values(docs, bench):
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (None, 1)}
