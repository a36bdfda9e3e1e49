"""Readers: relational tables, knowledge files, sessions, captures, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.functions import html as hx
from opsloom.functions import text as tx

SESSION_SCHEMA = (
    "session_id string, workspace_id string, assistant_instance_id string, "
    "automation_package_id string, knowledge_scope_id string, "
    "answers array<struct<step_id:string,answer:struct<selected:array<string>,free_text:string>>>"
)
ACTIVITY_SCHEMA = (
    "fecha timestamp_ntz, usuario string, objeto string, nombre string, actividad string, "
    "valor_previo string, valor_posterior string"
)
ADS_SCHEMA = (
    "mes date, campana string, proyecto string, formato string, inversion decimal(12,2), "
    "impresiones long, clics long, leads long, respondidos long, reuniones long"
)


def relational_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int,
                     partitions: int, **options: str) -> DataFrame:
    """A database table read in parallel ranges of a numeric key."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high),
        numPartitions=str(partitions), fetchsize="10000", **options).load()


def markdown_corpus(spark: SparkSession, folder: str, scope_id: str) -> DataFrame:
    """One document per ``*.md`` file: title from the name, whole text as content."""
    files = spark.read.text(f"{folder}/*.md", wholetext=True).select(
        F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("content"))
    stem = F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"\.md$", "")
    words = F.replace(F.url_decode(stem), F.lit("_"), F.lit(" "))
    # Title case starts anew after every non-letter, digits included.
    runs = F.regexp_extract_all(words, F.lit(r"(\p{L}+|\P{L}+)"))
    return files.select(
        F.sha2("source_path", 256).alias("document_id"), F.lit(scope_id).alias("scope_id"),
        F.array_join(F.transform(runs, F.initcap), "").alias("title"),
        "source_path", "content")


def intake_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions from JSON objects; a file without id takes its own name."""
    raw = spark.read.schema(SESSION_SCHEMA).json(path, multiLine=True).select("*", "_metadata.file_name")
    answers = F.transform("answers", lambda a: F.struct(
        a["step_id"].alias("step_id"), a["answer"]["selected"].alias("selected"),
        a["answer"]["free_text"].alias("free_text")))
    return raw.withColumn("answers", answers).withColumn(
        "session_id", F.coalesce("session_id", F.regexp_replace("file_name", r"\.json$", ""))).drop("file_name")


def capture_rows(pages: DataFrame, page_id: str = "page_id", html: str = "html",
                 cap: int = 100) -> DataFrame:
    """Visible rows of a stored page with their index, at most ``cap`` per page."""
    lines = F.slice(hx.text_lines(hx.body(F.col(html))), 1, cap)
    return pages.select(page_id, F.posexplode(lines).alias("row_index", "row_text"))


def activity_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """CRM activity export as a batch or a stream over a landing folder."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(ACTIVITY_SCHEMA).option("header", "true").csv(path)


def ads_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ADS_SCHEMA).option("header", "true").csv(path)


def artifact_status(spark: SparkSession, folder: str, expected: Sequence[str]) -> DataFrame:
    """``generated`` for each expected file that exists and is not empty.

    Only paths and lengths are read; the file contents stay untouched.
    """
    listing = spark.read.format("binaryFile").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("artifact"), "length")
    wanted = spark.createDataFrame([(name,) for name in expected], "artifact string")
    return wanted.join(listing, "artifact", "left").select(
        "artifact", F.when(F.col("length") > 0, "generated").otherwise("not run").alias("status"))
