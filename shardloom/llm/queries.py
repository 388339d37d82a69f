"""Registered queries of this package: one per operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sql
from .boosting import quality_scores
from .decontaminate import contaminated
from .jaccard import jaccard_components
from .language import identify_languages
from .line_dedup import drop_repeated_lines
from .lm import lm_scores
from .merkle import merkle_manifest
from .mixture import mix
from .pii import personal_data
from .ranked_search import ranked_search
from .rules import quality_rules
from .tables import benchmark, documents, labels, remainder
from .tokens import read_documents, write_sequences
from .toxicity import toxicity_scores



def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir))


def op2_source_mixture(spark, sf_dir):
    columns = ("doc_id", "size", "source_size", "target", "taken", "copies")
    return mix(documents(spark, sf_dir)).select(*columns)


def op3_language_id(spark, sf_dir):
    return identify_languages(documents(spark, sf_dir))


def op4_toxicity(spark, sf_dir):
    return toxicity_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_quality_rules(spark, sf_dir):
    return quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_token_id_output(spark, sf_dir):
    return read_documents(write_sequences(documents(spark, sf_dir), tokenizer_path(), end_id=2))


def op7_pii(spark, sf_dir):
    return personal_data(documents(spark, sf_dir))


def op8_lm_scoring(spark, sf_dir):
    return lm_scores(documents(spark, sf_dir))


def op9_quality_classifier(spark, sf_dir):
    return quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_benchmark_decontamination(spark, sf_dir):
    return contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op11_line_dedup(spark, sf_dir):
    kept = drop_repeated_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark, sf_dir):
    tampered = F.when(remainder(F.col("doc_id"), 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle_manifest(documents(spark, sf_dir), replaced={"n_chars": tampered})


def op13_ranked_search(spark, sf_dir):
    return ranked_search(documents(spark, sf_dir), benchmark(spark, sf_dir))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_source_mixture": op2_source_mixture,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_id_output": op6_token_id_output,
    "op7_pii": op7_pii,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_line_dedup": op11_line_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE = {
    "op1_ngram_jaccard_join": sql.JACCARD,
    "op11_line_dedup": sql.LINES,
    "op12_merkle_manifest": sql.MERKLE,
    "op13_ranked_search": sql.RANKED,
}
