"""A training corpus from ``documents``: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. ``docs`` is a table scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.decontaminate import clean_documents
from opsloom.llm.fuzzy_lines import cleaned_documents
from opsloom.llm.near_duplicates import one_of_each
from opsloom.llm.packing import pack_documents
from opsloom.llm.queries import vocabulary
from opsloom.llm.resampling import label_kinds, selected_documents
from opsloom.llm.store import kept
from opsloom.session import load_tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling takes; junk and toxic ones go."""
    return selected_documents(docs, label_kinds(load_tables(spark, sf_dir)["labels"]))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; documents that had nothing else go."""
    out = cleaned_documents(docs)
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return out.withColumn("n_chars", F.length("text").cast(kind)) if kind else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return clean_documents(docs, load_tables(spark, sf_dir)["benchmark"])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, placed in sequences of 2048 tokens."""
    return pack_documents(docs, vocabulary(), end_id=0)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: The stages fit models and sign sets; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = load_tables(spark, sf_dir)["documents"]
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
