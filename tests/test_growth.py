"""What may not grow faster than the input: triggers, copies of texts, generated code, tasks."""

from pyspark.sql import functions as F

from opsloom.catalogue import catalog, sources, streams
from opsloom.catalogue.registry import Tables
from opsloom.functions import text as tx
from opsloom.operators.settle import STEP, settle
from opsloom.plans import catalog as ct
from opsloom.streaming import jobs


def test_settle_takes_many_columns_in_steps(spark):
    df = spark.range(3)
    out = settle(df, {f"c{n}": F.col("id") + n for n in range(2 * STEP + 1)})
    assert out._jdf.queryExecution().analyzed().toString().count("Generate") == 3
    assert sorted(r[f"c{2 * STEP}"] for r in out.collect()) == [2 * STEP, 2 * STEP + 1, 2 * STEP + 2]
    swapped = settle(df.withColumn("c0", F.lit(7)), {"c0": F.col("id"), **{f"d{n}": F.col("c0") for n in range(STEP)}})
    assert {r[f"d{STEP - 1}"] for r in swapped.collect()} == {7}


def test_known_systems_are_whole_words(spark):
    texts = ["ERP and erps, SAP B1.", "sap b12, xsap, mi-sap", "éerp erpé", "emailed email", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r[0]: r[1] for r in rows.select("i", tx.known_systems(F.col("t"))).collect()}
    assert [sorted(got[i]) for i in range(6)] == [["erp", "sap", "sap b1"], ["sap"], [], ["email"], [], []]


def _events(spark, folder, n=240, files=3):
    rows = spark.range(0, n, 1, files).select(
        F.col("id").alias("event_id"), F.expr("timestampadd(MINUTE, CAST(id AS INT), TIMESTAMP '2024-01-01')").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") > 0, F.col("id") % 4).otherwise(9).alias("user_id"), F.when(F.col("id") % 8 < 6, "error").otherwise("view").alias("event_type"),
        F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows.write.parquet(f"{folder}/events.parquet")
    return Tables(spark, str(folder))


def test_triggers_do_not_follow_the_files_of_the_table(spark, tmp_path):
    t = _events(spark, tmp_path)
    seen = set()
    jobs.drain(streams._follow(t, streams._arriving(t)), "append", t.spark,
               lambda _: lambda df, n: seen.add(n) if df.count() else None)
    assert len(seen) <= streams.FILES + 2
    got = {(r.user_id, r.alert_at) for r in streams.stream_error_streaks(t).collect()}
    # Users 0 and 1 err in every row, the others in every second; 9 errs once, in the row that the closing ones copy.
    assert got == {(0, "2024-01-01 00:12:00"), (1, "2024-01-01 00:09:00")}


def test_workbooks_are_dealt_out(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("s_suppkey"), F.lit("n").alias("s_name"), F.lit(1).alias("s_nationkey"),
                           F.lit(1.0).alias("s_acctbal")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    books = sources.workbooks(Tables(spark, str(tmp_path)))
    assert books.rdd.getNumPartitions() > 8


def test_sync_writes_bodies_once(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(ct, "cut_lineage", lambda df, f=ct.cut_lineage: kept.append(df.columns) or f(df))
    docs = spark.createDataFrame([("s", "d", k, "web", "t", b, b, v) for k, b, v in (
        ("1", "a", 0), ("1", "b", 1), ("2", "c", 0), (None, "e", 0))],
        "source_system string, source_entity_type string, source_entity_key string, target_channel string, "
        "title string, body_text string, content_hash string, version int")
    catalog = ct.Catalog(spark, str(tmp_path / "c"), buckets=4)
    catalog.sync(docs, 1, ["version"])
    catalog.sync(docs.where("source_entity_key = '2'").withColumn("body_text", F.lit("d")).withColumn(
        "content_hash", F.lit("d")).unionByName(docs.where("version = 1")), 2, ["version"])
    assert [sum("body_text" in c for c in kept)] == [2]
    assert sorted(r[2:] for r in catalog.runs.read().collect()) == [(2, 1, 1, 1), (4, 3, 0, 3)]
    assert sorted((r.source_entity_key or "", r.body_text) for r in catalog.sources.read().collect()) == [
        ("", "e"), ("1", "b"), ("2", "d")]


def test_clean_trims_blanks_only(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [f"{w}a{w}{v}b c{w}d  e {w}" for w in spaces for v in ("", " ", "\t")] + ["", " ", "a", "\x00 a\u200b", None]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.clean(F.col("t")).alias("c"))
    assert {r.t: r.c for r in out.collect()} == {t: " ".join((t or "").split()) for t in texts}
    assert "Some(" not in out._jdf.queryExecution().analyzed().toString()


def test_unit_profiles_are_dealt_out_once(spark, tmp_path, monkeypatch):
    lines = [(1, 10, 5, 1, 3.0, "N", "O"), (1, 10, 5, 1, 3.0, "N", "O"), (1, 11, 5, 2, 3.0, "N", "F"), (2, 10, 6, 1, 4.0, "A", "O"),
             (2, 10, None, 1, 4.0, "A", "O"), (2, 10, None, 2, 4.0, "A", "O"), (2, None, 6, 3, 4.0, "A", "O"),
             (None, 10, 6, 1, 4.0, "A", "O"), (3, 10, 6, 1, None, None, None), (4, 12, 6, 1, 4.0, "A", "O")]
    orders = [(1, "O", "1-URGENT"), (1, "P", "1-URGENT"), (2, "F", None), (2, "F", None), (None, "F", "2-HIGH"), (4, None, "2-HIGH")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(10, "a  b"), (11, "c")], "p long, n string").selectExpr(
        "concat('P', p) AS project_code", "n AS project_name").write.parquet(f"{tmp_path}/names.parquet")
    t = Tables(spark, str(tmp_path))
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    wanted = t.derive(catalog.UNIT_PROFILES)
    assert sorted(catalog._unit_profiles(t).select(*wanted.columns).collect(), key=key) == sorted(wanted.collect(), key=key)

    units, names = t.derive(catalog.UNITS), spark.read.parquet(f"{tmp_path}/names.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        given = []
        monkeypatch.setattr(catalog.ct, "unit_documents", lambda u, p, profiles, c: given.append(profiles) or units)
        monkeypatch.setattr(catalog.ct, "project_documents", lambda *a: units)
        monkeypatch.setattr(catalog.ct, "campaign_documents", lambda *a: units)
        monkeypatch.setattr(catalog.ct, "all_documents", lambda *a: units)
        spark.createDataFrame([], "p_partkey long, p_name string, p_size int, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
        spark.createDataFrame([], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
        catalog.documents(t)
        monkeypatch.undo()
        got = ct.unit_documents(units, names, given[0], "web")
        plan = got._jdf.queryExecution().executedPlan().toString()
        # Units by project and by their key, names, lines and orders by number, profiles by their key.
        assert plan.count("Exchange hashpartitioning") == 6
        assert [len(r.body_text.split("\n")) for r in got.where("source_entity_key = 'P10:1-1-5'").collect()].count(8) == 2
        assert {r.source_entity_key for r in got.collect()} == {"P10:1-1-5", "P11:1-2-5", "P10:2-1-6", "P10", "P10:3-1-6"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
