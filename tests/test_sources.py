import json

from pyspark.sql import functions as F

from opsloom.catalogue.sources import make_workbook
from opsloom.functions import chunking as ch
from opsloom.sources import files, sinks, workbook


def test_markdown_corpus(spark, tmp_path):
    (tmp_path / "sap_b1_guide.md").write_text("# Uno\n\nTexto\n\n## Dos\n\nMás", encoding="utf-8")
    (tmp_path / "other.md").write_text("plain", encoding="utf-8")
    (tmp_path / "skip.txt").write_text("no", encoding="utf-8")
    docs = files.markdown_corpus(spark, str(tmp_path), "kb")
    assert sorted(r["title"] for r in docs.collect()) == ["Other", "Sap B1 Guide"]
    chunks = docs.select("title", F.explode(ch.knowledge_chunks(F.col("content"))).alias("c"))
    assert chunks.count() == 3


def test_sessions(spark, tmp_path):
    body = {"workspace_id": "w", "knowledge_scope_id": "k",
            "answers": [{"step_id": "rules_clarity", "answer": {"selected": ["clear"], "free_text": "x"}}]}
    (tmp_path / "first.json").write_text(json.dumps(body, indent=1), encoding="utf-8")
    r = files.intake_sessions(spark, str(tmp_path)).first()
    assert r["session_id"] == "first" and r["answers"][0]["selected"] == ["clear"]


def test_workbooks_from_files(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(make_workbook(" X", "Ventas", 5))
    (tmp_path / "b.xlsx").write_bytes(make_workbook(" Y", "Marketing", 1))
    cells = workbook.read_workbooks(spark, str(tmp_path))
    assert cells.count() == 2 * (3 + 12 + 1)
    kpis = workbook.kpi_list(cells).orderBy("path", "number").collect()
    assert [k["number"] for k in kpis] == [5, 6, 7, 8, 1, 2, 3, 4]
    assert kpis[-1]["source"] == "Meta Ads"
    assert {(r["sheet"], r["formula_count"]) for r in workbook.sheet_summary(cells).collect()} == {
        ("KPIs CEO Proyectos", 0), ("Carga", 1)}


def test_artifacts(spark, tmp_path):
    (tmp_path / "full.json").write_text("{}")
    (tmp_path / "empty.json").write_text("")
    got = files.artifact_status(spark, str(tmp_path), ["full.json", "empty.json", "absent.json"]).collect()
    assert {r["artifact"]: r["status"] for r in got} == {
        "full.json": "generated", "empty.json": "not run", "absent.json": "not run"}


def test_exports(spark, tmp_path):
    (tmp_path / "act").mkdir()
    (tmp_path / "act" / "a.csv").write_text(
        "fecha,usuario,objeto,nombre,actividad,valor_previo,valor_posterior\n"
        "2024-01-02T03:04:05,ana,lead,L1,Nuevo lead creado,,x\n", encoding="utf-8")
    batch = files.activity_log(spark, str(tmp_path / "act"))
    assert batch.first()["actividad"] == "Nuevo lead creado"
    assert files.activity_log(spark, str(tmp_path / "act"), streaming=True).isStreaming
    (tmp_path / "ads.csv").write_text(
        "mes,campana,proyecto,formato,inversion,impresiones,clics,leads,respondidos,reuniones\n"
        "2024-01-01,c,p,f,10.50,100,5,2,1,1\n", encoding="utf-8")
    assert str(files.ads_report(spark, str(tmp_path / "ads.csv")).first()["inversion"]) == "10.50"


def test_versions_and_appends(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    two = spark.createDataFrame([(2, "c")], "k int, v string")
    sinks.next_version(spark, str(tmp_path / "t"), 0, one, ["k"])
    path = sinks.next_version(spark, str(tmp_path / "t"), 1, two, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c")]
    for _ in range(2):
        sinks.append_rows(one, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
