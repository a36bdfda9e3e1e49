"""Queries over readers and writers. Files come from Spark jobs on the tables
and live in the shared folder."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom import fixed_values as fv
from opsloom.catalogue.inbox import _PAGES
from opsloom.catalogue.registry import Tables, query
from opsloom.plans import quality as ql
from opsloom.session import new_scratch
from opsloom.sources import files, sinks, workbook


@query("capture_rows", f"WITH {_PAGES}" + """
SELECT page_id, unnest(lines[1:100]) AS row_text, unnest(range(0, len(lines[1:100])))::BIGINT AS row_index FROM l
""")
def capture_rows(t: Tables):
    return files.capture_rows(t.pages).withColumn("row_index", F.col("row_index").cast("long"))


@query("activity_scan", """
SELECT user_id::VARCHAR AS usuario, event_type AS actividad, strftime(ts, '%Y-%m-%d') AS dia, count(*)::BIGINT AS n,
 count(CASE WHEN value > 100 THEN 1 END)::BIGINT AS n_large FROM events GROUP BY ALL
""")
def activity_scan(t: Tables):
    """Events exported as CSV by Spark, then scanned back with the activity schema."""
    folder = new_scratch(t.spark, "activity")
    t.events.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("fecha"), F.col("user_id").alias("usuario"),
        F.lit("lead").alias("objeto"), F.concat(F.lit("Lead, "), "user_id").alias("nombre"),
        F.col("event_type").alias("actividad"), F.col("value").alias("valor_previo"),
        F.col("props").alias("valor_posterior"),
    ).write.option("header", "true").csv(folder)
    log = files.activity_log(t.spark, folder)
    return log.groupBy("usuario", "actividad", F.date_format("fecha", "yyyy-MM-dd").alias("dia")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("valor_previo").cast("double") > 100).alias("n_large"))


@query("ads_scan", """
SELECT event_type AS campaign, count(*)::BIGINT AS n_rows, sum(floor(value * 100)::BIGINT)::BIGINT AS impressions, sum(event_id % 7)::BIGINT AS clicks FROM events GROUP BY 1
""")
def ads_scan(t: Tables):
    """Events exported as an ads report in CSV, then scanned back with its schema."""
    folder = new_scratch(t.spark, "ads")
    names = [f.name for f in T._parse_datatype_string(files.ADS_SCHEMA)]
    values = {names[1]: F.col("event_type"), "impresiones": F.floor(F.col("value") * 100), "clics": F.col("event_id") % 7}
    t.events.select(*[values.get(n, F.lit(None).cast("string")).alias(n) for n in names]).write.option("header", "true").csv(folder)
    report = files.ads_report(t.spark, folder)
    return report.groupBy(F.col(names[1]).alias("campaign")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("impresiones").alias("impressions"), F.sum("clics").alias("clicks"))


@query("report_sink", """
SELECT event_type, count(*)::BIGINT AS n, min(strftime(ts, '%Y-%m-%d')) AS first_day FROM events GROUP BY 1
""")
def report_sink(t: Tables):
    folder = new_scratch(t.spark, "report")
    counts = t.events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.date_format("ts", "yyyy-MM-dd")).alias("first_day"))
    sinks.json_report(counts, folder)
    return t.spark.read.schema("event_type string, n long, first_day string").json(folder)


@query("append_versions", """
SELECT doc_id, CASE WHEN lang = 'en' THEN 'second' ELSE 'first' END AS version FROM documents
""")
def append_versions(t: Tables):
    """Two versions of a keyed table: all documents, then the English ones again."""
    folder = new_scratch(t.spark, "versions")
    first = t.documents.select("doc_id", F.lit("first").alias("version"))
    second = t.documents.where("lang = 'en'").select("doc_id", F.lit("second").alias("version"))
    sinks.next_version(t.spark, folder, 0, first, ["doc_id"])
    return t.spark.read.parquet(sinks.next_version(t.spark, folder, 1, second, ["doc_id"]))


# One workbook per supplier: a KPI sheet and a load sheet with a formula.
_NAMES = ("Leads Totales", "CTR ", "Conversión General", "Valor m2")


def make_workbook(name: str, area: str, number: int) -> bytes:
    """A minimal workbook with shared strings, inline strings and a formula."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows = ['<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Area</t></is></c><c r="C1" t="s"><v>1</v></c></row>']
    for i, kpi in enumerate(_NAMES):
        rows.append(f'<row r="{i + 2}"><c r="A{i + 2}"><v>{number + i}</v></c>'
                    f'<c r="B{i + 2}" t="inlineStr"><is><t>{escape(area)}</t></is></c>'
                    f'<c r="C{i + 2}" t="inlineStr"><is><t>{escape(kpi + name)}</t></is></c><c r="D{i + 2}"/></row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>'
                   f'<sheet name="{fv.KPI_SHEET}" r:id="a"/><sheet name="Carga" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/>'
                   '<Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>N</t></si><si><r><t>K</t></r><r><t>PI</t></r></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><dimension ref="A1:C5"/><sheetData>{"".join(rows)}</sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="E2"><f>C2/D2</f><v>0.5</v></c></row></sheetData></worksheet>')
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def _workbook(name: pd.Series, area: pd.Series, number: pd.Series) -> pd.Series:
    return pd.Series([make_workbook(*row) for row in zip(name, area, number)])


def workbooks(t: Tables):
    # Work per workbook is heavy and its row small: dealt out before it, however few files hold the rows.
    return t.supplier.repartition(4 * t.spark.sparkContext.defaultParallelism).select(
        F.concat(F.lit("book-"), "s_suppkey").alias("path"),
        _workbook("s_name", F.concat(F.lit("Zona "), "s_nationkey"), F.col("s_suppkey").cast("int")).alias("content"))


_KPI_ROWS = "unnest(['Leads Totales', 'CTR ', 'Conversión General', 'Valor m2']) AS k, unnest([0, 1, 2, 3]) AS i"


@query("workbook_cells", f"""
WITH r AS (SELECT 'book-' || s_suppkey AS path, s_suppkey, s_name, s_nationkey, {_KPI_ROWS} FROM supplier)
SELECT path, 'KPIs CEO Proyectos' AS sheet, (i + 2)::BIGINT AS "row", 'A' AS col, (s_suppkey + i)::VARCHAR AS value, '' AS formula FROM r
UNION ALL SELECT path, 'KPIs CEO Proyectos', i + 2, 'B', 'Zona ' || s_nationkey, '' FROM r
UNION ALL SELECT path, 'KPIs CEO Proyectos', i + 2, 'C', k || s_name, '' FROM r
UNION ALL SELECT 'book-' || s_suppkey, 'KPIs CEO Proyectos', 1, c, v, '' FROM supplier, (VALUES ('A', 'N'), ('B', 'Area'), ('C', 'KPI')) h(c, v)
UNION ALL SELECT 'book-' || s_suppkey, 'Carga', 2, 'E', '0.5', 'C2/D2' FROM supplier
""")
def workbook_cells(t: Tables):
    return workbook.workbook_cells(workbooks(t)).select(
        "path", "sheet", F.col("row").cast("long").alias("row"), "col", "value", "formula")


@query("kpi_list", f"""
WITH r AS (SELECT 'book-' || s_suppkey AS path, s_suppkey, s_name, s_nationkey, {_KPI_ROWS} FROM supplier)
SELECT path, (s_suppkey + i)::BIGINT AS number, 'Zona ' || s_nationkey AS area, k || s_name AS kpi,
 CASE i WHEN 0 THEN 'Kommo' WHEN 1 THEN 'Meta Ads' WHEN 2 THEN 'Cálculo local' ELSE 'Manual / no definido' END AS source FROM r
""")
def kpi_list(t: Tables):
    return workbook.kpi_list(workbook.workbook_cells(workbooks(t))).withColumn(
        "number", F.col("number").cast("long"))


@query("sheet_inventory", """
SELECT 'book-' || s_suppkey AS path, 'KPIs CEO Proyectos' AS sheet, 'A1:C5' AS dimension, 0::BIGINT AS formula_count FROM supplier
UNION ALL SELECT 'book-' || s_suppkey, 'Carga', '', 1 FROM supplier
""")
def sheet_inventory(t: Tables):
    return workbook.sheet_summary(workbook.workbook_cells(workbooks(t)))


@query("table_scan", """
SELECT 'customer' AS table_name, count(*)::BIGINT AS n, count(DISTINCT c_nationkey)::BIGINT AS n_groups FROM customer
UNION ALL SELECT 'supplier', count(*), count(DISTINCT s_nationkey) FROM supplier
UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderstatus) FROM orders
""")
def table_scan(t: Tables):
    def part(name, df, column):
        groups = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        return groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_groups")).select(
            F.lit(name).alias("table_name"), "n", "n_groups")

    return ql.union_all([part("customer", t.customer, "c_nationkey"), part("supplier", t.supplier, "s_nationkey"),
                         part("orders", t.orders, "o_orderstatus")])
