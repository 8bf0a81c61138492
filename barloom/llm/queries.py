"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import quality_rules as rules
from barloom.llm.align import align
from barloom.llm.decontaminate import leaks
from barloom.llm.html_text import extract
from barloom.llm.minhash import near_duplicates
from barloom.llm.packing import pack
from barloom.llm.quality_model import quality
from barloom.llm.substrings import drop_repeated_words
from barloom.llm.suffixes import drop_repeated_bytes
from barloom.llm.tables import table
from barloom.llm.token_counts import token_counts
from barloom.llm.token_files import token_files
from barloom.llm.toxicity import toxicity
from barloom.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.quality_rules(table(spark, folder, "documents")).drop("reason")


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeated_words(table(spark, folder, "documents")).drop("kept")


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeated_bytes(table(spark, folder, "documents")).drop("kept")


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


def op12_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align(table(spark, folder, "documents"))


def op13_token_id_output(spark: SparkSession, folder: str) -> DataFrame:
    return token_files(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_benchmark_decontamination, op2_substring_dedup, op3_toxicity, op4_suffix_dedup, op5_token_counts, op6_packing, op7_quality_rules, op8_quality_classifier, op9_minhash_near_dedup, op10_html_extraction, op11_embedding_whitening, op12_cross_tokenizer_alignment, op13_token_id_output)
}
ORACLES: dict[str, str] = {"op7_quality_rules": rules.SQL}
