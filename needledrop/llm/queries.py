"""The registered queries of the corpus operators: each applies its operator to a whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.llm import alignment, bpe, language_id, lexical_search, line_dedup, media, mixing, pii, quality_classifier, quality_rules, secret_scan, simhash, toxicity
from needledrop.llm.common import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(table(spark, sf_dir, "documents"))
    return found.drop("spans").withColumnRenamed("shown", "spans")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digested(pii.find(table(spark, sf_dir, "documents")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("row.doc_id", *counts, "base_failed", "kept")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digested(line_dedup.deduped(table(spark, sf_dir, "documents")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_secrets": op2_secrets,
        "op3_quality": op3_quality,
        "op4_mixing": op4_mixing,
        "op5_simhash": op5_simhash,
        "op6_toxicity": op6_toxicity,
        "op7_pii": op7_pii,
        "op8_quality_rules": op8_quality_rules,
        "op9_media": op9_media,
        "op10_language": op10_language,
        "op11_search": op11_search,
        "op12_lines": op12_lines,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": secret_scan.ORACLE, "op4_mixing": mixing.ORACLE, "op7_pii": pii.ORACLE, "op11_search": lexical_search.ORACLE, "op12_lines": line_dedup.ORACLE}
