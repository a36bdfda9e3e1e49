"""Writers: reports, appends and keyed tables kept as versions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.operators.keyed import latest_per_key, upsert


def json_report(df: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def next_version(spark: SparkSession, folder: str, version: int, new: DataFrame,
                 keys: Sequence[str]) -> str:
    """Upsert into a table kept as version folders.

    The new version is written beside the old one and becomes visible only when
    its path is handed on, so a failed job leaves the old version intact.
    """
    merged = new if version == 0 else upsert(spark.read.parquet(f"{folder}/v{version}"), new, keys)
    target = f"{folder}/v{version + 1}"
    merged.write.mode("overwrite").parquet(target)
    return target


def batch_appender(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: rows tagged with their batch, safe to run twice.

    A batch owns its folder and overwrites it, so a retried batch replaces its
    own rows.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def latest_state(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Last emitted row per key of an update-mode stream written by batches."""
    rows = spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("long"))
    return latest_per_key(rows, list(keys), ["batch_id"]).drop("batch_id")
