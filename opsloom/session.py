"""Session set-up, table loading and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(app_name: str = "opsloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for.

    On a cluster leave ``master`` unset and let spark-submit supply it.
    Partition counts are left to adaptive execution: a high initial number is
    merged down to the advisory size, so one setting serves 1 MB and 100 TB.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prepare_session(spark: SparkSession) -> SparkSession:
    """Pin what results depend on, for sessions this package did not build."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Lazy readers for every table of a data folder."""
    prepare_session(spark)
    return _Lazy(spark, folder)


class _Lazy(dict):
    """Opens a table on first use, so a query pays only for what it reads."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self._spark, self._folder = spark, folder.rstrip("/")

    def __missing__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        self[name] = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self[name]


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="opsloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_scratch(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to shared storage and read back, so lost executors cost nothing."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
