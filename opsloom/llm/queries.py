"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import quotes
from opsloom.session import load_tables


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from opsloom.llm.decontaminate import overlap_report

    t = load_tables(spark, folder)
    return overlap_report(t["documents"], t["benchmark"])


def op2_one_bit_search(spark: SparkSession, folder: str) -> DataFrame:
    from opsloom.llm.vector_search import nearest

    return nearest(load_tables(spark, folder)["embeddings"])


def op3_token_file(spark: SparkSession, folder: str) -> DataFrame:
    from opsloom.llm.token_file import round_trip

    return round_trip(load_tables(spark, folder)["documents"], vocabulary(), end_id=2)


def op4_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    from opsloom.llm.packing import pack_documents

    return pack_documents(load_tables(spark, folder)["documents"], vocabulary(), end_id=0)


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from opsloom.llm.near_duplicates import class_report

    return class_report(load_tables(spark, folder)["documents"])


def op6_resample(spark: SparkSession, folder: str) -> DataFrame:
    from opsloom.llm.resampling import label_kinds, resample

    t = load_tables(spark, folder)
    return resample(t["documents"], label_kinds(t["labels"])).select(
        F.col("order").alias("doc_id"), "log_weight", "sample_key")


def op7_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    from opsloom.llm.fuzzy_lines import without_repeats

    docs = load_tables(spark, folder)["documents"].select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_lines", "n_removed", "text")


def op8_templates(spark: SparkSession, folder: str) -> DataFrame:
    from opsloom.llm.templates import main_texts

    return main_texts(load_tables(spark, folder)["pages"])


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from opsloom.llm.piece_counts import token_counts

    return token_counts(load_tables(spark, folder)["documents"], vocabulary())


def op10_quoted_threads(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.thread_report(load_tables(spark, folder)["conversations"])


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from opsloom.llm.license_scan import license_scan

    return license_scan(load_tables(spark, folder)["documents"])


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    from opsloom.llm.spelling import spelling_variants

    return spelling_variants(load_tables(spark, folder)["documents"])


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from opsloom.llm.whitening import whitened

    return whitened(load_tables(spark, folder)["embeddings"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_one_bit_search, op3_token_file, op4_best_fit, op5_near_duplicates, op6_resample, op7_fuzzy_lines, op8_templates, op9_token_counts,
                           op10_quoted_threads, op11_license_scan, op12_spelling_variants, op13_whitening)
}

ORACLES: dict[str, str] = {"op10_quoted_threads": quotes.ORACLE}
