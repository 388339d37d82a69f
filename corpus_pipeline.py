"""From raw documents to token files: five stages, each a table that the next one reads.

Every stage but the last returns the columns of ``documents``; ``run`` applies them in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.decontaminate import uncontaminated
from shardloom.llm.jaccard import jaccard_components
from shardloom.llm.mixture import mix
from shardloom.llm.queries import tokenizer_path
from shardloom.llm.tables import benchmark, labels, stored
from shardloom.llm.tokens import read_documents, write_sequences
from shardloom.llm.toxicity import without_toxic

# Between a word and the white space after it.
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity model rejects go, with or without an id."""
    return without_toxic(docs, labels(spark, sf_dir)).select(*docs.columns)


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with ``_h1`` and ``_h2``: 128 bits that name the contents of ``columns``."""
    return docs.withColumns({f"_h{i}": F.xxhash64(F.lit(i), *columns) for i in (1, 2)})


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by near-duplicate shingles one with the smallest id stays, once.

    Texts that share an id but are not linked are different documents. A row without an id stays.
    """
    key = ["doc_id", "_h1", "_h2"]
    rows = keyed(docs, "text")
    groups = stored(jaccard_components(rows, keep=("_h1", "_h2")).filter("doc_id IS NOT NULL"), "near-groups")
    texts = groups.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.first("component_id").alias("component_id"), F.first("group").alias("group")
    )
    texts = stored(texts.withColumn("group", F.coalesce("group", "_h1")), "near-texts")
    first = texts.filter("doc_id = component_id").groupBy("doc_id", "group").agg(
        F.min(F.struct("_h1", "_h2")).alias("first")
    )
    gone = texts.join(first, ["doc_id", "group"], "left").filter(
        "doc_id <> component_id OR struct(_h1, _h2) <> first"
    ).select(*key)
    kept = rows.join(gone, key, "left_anti")
    twice = stored(texts.filter("n > 1").select(*key), "repeated-rows")
    once = kept.join(twice, key, "left_anti").select(*docs.columns)
    return once.unionByName(kept.join(twice, key, "left_semi").dropDuplicates(key).select(*docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark passage go, with or without an id; of rows that share an id the others stay."""
    return uncontaminated(docs, benchmark(spark, sf_dir)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; the last one of a source as far as it is taken.

    Rows are named by their contents. Of identical rows the plan counts for all: each comes out as
    often as all of them do, and what is left over is taken of one.
    """
    key = ["_h1", "_h2"]
    rows = keyed(docs, *docs.columns)
    plan = stored(mix(rows, keep=("_h1", "_h2")).select(*key, "size", "copies"), "mix")
    same = plan.groupBy(*key).agg(F.count(F.lit(1)).alias("_same"), F.first("size").alias("_size"))
    taken = plan.select(*key, F.explode("copies.words").alias("_words")).groupBy(*key, "_words").count()
    taken = stored(taken.join(same, key), "mix-copies")
    each = taken.withColumn("_times", F.expr("count div _same")).filter("_times > 0")
    left = taken.withColumn("_times", F.expr("count % _same")).filter("_times > 0")
    one = rows.join(left.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(
        F.first(F.struct(*docs.columns)).alias("_row")
    ).select(*key, "_row.*")
    rows = rows.join(each, key).unionByName(one.join(left, key).select(*rows.columns, *each.columns[2:]))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    pieces = F.slice(F.split("text", WORD_END), F.lit(1), F.col("_words").cast("int"))
    cut = F.array_join(pieces, "")
    rows = rows.withColumn("text", F.when(F.col("_words") < F.col("_size"), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and where each document lies in them."""
    return read_documents(write_sequences(docs, tokenizer_path(), end_id=2))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixture", mixed),
    ("token_id_output", to_tokens),
]
# Learned models, random draws and token ids are beyond SQL; tests check the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
