"""Tables that change, kept as hash buckets and immutable files under a manifest.

A commit writes the files of the buckets that it touches into a folder of its
own and then names them in the next manifest; readers follow the newest one. So
an upsert rewrites only touched buckets, an append adds files, a job that fails
leaves the table as it was, and a commit that is tried again (same writer and
sequence) changes nothing. One writer commits to a table at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.operators.keyed import join_same, one_per_key

BUCKETS = 64
_BUCKET = "_bucket"


class _Manifests:
    """Numbered manifests of a table folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/manifests"

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def latest(self) -> dict | None:
        fs, path = self._path("")
        if not fs.exists(path):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        names = [n for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
        if not names:
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/{max(names)}", wholetext=True).first()[0])

    def put(self, manifest: dict) -> None:
        """Write aside, then rename: a manifest is there as a whole or not at all."""
        fs, final = self._path(f"{manifest['version']:012d}.json")
        _, aside = self._path(f"_{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(aside, final):
            raise RuntimeError(f"another writer has made version {manifest['version']} of {self.folder}")


class KeyedTable:
    """Rows found by ``keys``, in ``buckets`` hash buckets; keys may hold NULLs.

    A missing table is made with the first commit. With ``unique`` a key has one
    row, else any number (children of a parent).
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), list(keys)
        self.schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        self.manifests = _Manifests(spark, folder)
        self._new = {"version": -1, "buckets": buckets, "at": {}, "writers": {}}

    def state(self) -> dict:
        return self.manifests.latest() or self._new

    def _bucket(self, state: dict) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(state["buckets"])).cast("int")

    def _read(self, state: dict, only: Sequence[int] | None = None) -> DataFrame:
        at = state["at"] if only is None else {b: state["at"][str(b)] for b in only if str(b) in state["at"]}
        if not at:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/{commit}/{_BUCKET}={b}" for b, commit in at.items()])

    def read(self) -> DataFrame:
        """The newest version."""
        return self._read(self.state())

    def done(self, writer: str, sequence: int) -> bool:
        return self.state()["writers"].get(writer, -1) >= sequence

    def merge(self, new: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame],
              writer: str = "", sequence: int | None = None) -> list[int]:
        """Put ``combine(old rows, new rows)`` in place of the buckets that ``new`` touches; their numbers.

        ``combine`` sees whole buckets and may use rows of the same key only.
        With a ``sequence`` a commit not above the writer's last one is passed over.
        """
        state = self.state()
        if sequence is not None and state["writers"].get(writer, -1) >= sequence:
            return []
        touched = sorted(r[0] for r in new.select(self._bucket(state)).distinct().collect())
        commit = uuid.uuid4().hex
        if touched:
            rows = combine(self._read(state, touched), new).select(*self.schema.fieldNames())
            # In order of the bucket, so that a task writes few files however many buckets there are.
            placed = rows.withColumn(_BUCKET, self._bucket(state)).repartitionByRange(_BUCKET, F.xxhash64(*self.keys))
            placed.write.partitionBy(_BUCKET).parquet(f"{self.folder}/data/{commit}")
        at = {b: c for b, c in state["at"].items() if int(b) not in set(touched)}
        at |= {str(b): commit for b in self._there(commit, touched)}
        writers = state["writers"] | ({writer: sequence} if sequence is not None else {})
        self.manifests.put(state | {"version": state["version"] + 1, "at": at, "writers": writers})
        return touched

    def _there(self, commit: str, touched: Sequence[int]) -> list[int]:
        """The touched buckets that have rows left."""
        if not touched:
            return []
        fs, path = self.manifests._path(f"../data/{commit}")
        names = {s.getPath().getName() for s in fs.listStatus(path)}
        return [b for b in touched if f"{_BUCKET}={b}" in names]

    def upsert(self, new: DataFrame, order: Sequence[str] = (), writer: str = "", sequence: int | None = None,
               once: bool = False) -> list[int]:
        """Rows of ``new`` replace those with the same key; of several new ones the last by ``order`` stays.

        With ``once`` the caller knows that no key comes twice, and the rows are not grouped again.
        """
        def combine(old: DataFrame, rows: DataFrame) -> DataFrame:
            last = rows.select(*self.schema.fieldNames())
            last = last if once else one_per_key(last, self.keys, order)
            return join_same(old, last.select(*self.keys), self.keys, "left_anti").unionByName(last)

        return self.merge(new, combine, writer, sequence)

    def replace(self, parents: DataFrame, rows: DataFrame, writer: str = "", sequence: int | None = None) -> list[int]:
        """All rows of the keys in ``parents`` go, ``rows`` (of these keys) come."""
        def combine(old: DataFrame, touched: DataFrame) -> DataFrame:
            left = join_same(old, touched.select(*self.keys).distinct(), self.keys, "left_anti")
            return left.unionByName(rows.select(*self.schema.fieldNames()))

        return self.merge(parents, combine, writer, sequence)


class EventLog:
    """Rows that are only ever added; a commit is one folder and one manifest."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        self.manifests = _Manifests(spark, folder)

    def read(self) -> DataFrame:
        parts = (self.manifests.latest() or {"parts": []})["parts"]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/{p}" for p in parts])

    def append(self, rows: DataFrame, writer: str, sequence: int) -> bool:
        """Add the rows of a commit, unless the writer has made it before."""
        state = self.manifests.latest() or {"version": -1, "parts": [], "writers": {}}
        if state["writers"].get(writer, -1) >= sequence:
            return False
        part = uuid.uuid4().hex
        rows.select(*self.schema.fieldNames()).write.parquet(f"{self.folder}/data/{part}")
        self.manifests.put({"version": state["version"] + 1, "parts": [*state["parts"], part],
                            "writers": state["writers"] | {writer: sequence}})
        return True
