import pytest
from pyspark.sql import functions as F

from opsloom.sources import keyed_table as kt

SCHEMA = "k string, sub int, v long"


def rows(df):
    return sorted(df.collect(), key=lambda r: (r.k is not None, r.k or "", r.sub or -1, r.v))


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    table = kt.KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k", "sub"], 16)
    assert table.read().count() == 0
    first = spark.createDataFrame([(f"k{i}", 0, i) for i in range(200)] + [(None, None, -1)], SCHEMA)
    assert len(table.upsert(first)) == 16
    before = table.state()
    touched = table.upsert(spark.createDataFrame([("k1", 0, 7), ("k1", 0, 9), ("k1", 0, 8), (None, None, -2)], SCHEMA), ["v"])
    after = table.state()
    assert 1 <= len(touched) <= 2 and after["version"] == before["version"] + 1
    assert {b for b in after["at"] if after["at"][b] != before["at"][b]} == {str(b) for b in touched}
    got = {(r.k, r.sub): r.v for r in table.read().collect()}
    assert len(got) == 201 and got["k1", 0] == 9 and got[None, None] == -2 and got["k5", 0] == 5
    assert table.read().count() == 201


def test_a_commit_tried_again_changes_nothing(spark, tmp_path):
    table = kt.KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], 4)
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.first("sub").alias("sub"), F.sum("v").alias("v"))
    for sequence in (0, 1, 1, 0, 2):
        table.merge(spark.createDataFrame([("a", 1, 10), ("b", 1, sequence)], SCHEMA), add, "stream", sequence)
    assert [(r.k, r.v) for r in rows(table.read())] == [("a", 30), ("b", 3)]
    assert table.done("stream", 2) and not table.done("stream", 3) and not table.done("other", 0)


def test_a_failed_commit_leaves_the_table(spark, tmp_path):
    table = kt.KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], 4)
    table.upsert(spark.createDataFrame([("a", 1, 10)], SCHEMA))
    bad = spark.createDataFrame([("a", 1, 11)], SCHEMA).withColumn("v", F.when(F.col("v") > 0, F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        table.upsert(bad)
    assert rows(table.read()) == rows(spark.createDataFrame([("a", 1, 10)], SCHEMA))
    table.manifests.put(table.state() | {"version": 1})
    with pytest.raises(RuntimeError, match="another writer"):
        table.manifests.put(table.state() | {"version": 1})


def test_replace_children_and_empty_buckets(spark, tmp_path):
    table = kt.KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], 8)
    table.replace(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", i, i) for i in range(5)] + [("b", 0, 0)], SCHEMA))
    table.replace(spark.createDataFrame([("a",), ("c",)], "k string"), spark.createDataFrame([("a", 9, 9)], SCHEMA))
    assert [(r.k, r.sub) for r in rows(table.read())] == [("a", 9), ("b", 0)]
    table.replace(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([], SCHEMA))
    assert table.read().count() == 0 and table.state()["at"] == {}


def test_log_appends_each_commit_once(spark, tmp_path):
    log = kt.EventLog(spark, str(tmp_path / "log"), SCHEMA)
    assert log.read().count() == 0
    assert log.append(spark.createDataFrame([("a", 1, 1)], SCHEMA), "run", 0)
    assert not log.append(spark.createDataFrame([("a", 1, 1)], SCHEMA), "run", 0)
    assert log.append(spark.createDataFrame([], SCHEMA), "run", 1) and log.append(spark.createDataFrame([("b", 1, 1)], SCHEMA), "other", 0)
    assert [r.k for r in rows(log.read())] == ["a", "b"]
