"""Spreadsheet files to sparse cells, many files at a time.

Spark lists the files and spreads them over tasks; inside a task one small
function streams through a file, a row of cells at a time. The result is a long
cell table that SQL pivots.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom import fixed_values as fv
from opsloom.functions import text as tx

CELLS = "path string, sheet string, dimension string, row int, col string, ref string, value string, formula string"
#: Cells that leave a task in one batch.
BATCH = 20_000


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _events(book: zipfile.ZipFile, member: str, *tags: str) -> Iterator[tuple[str, ElementTree.Element]]:
    """Finished elements of the wanted names; each is emptied after use."""
    with book.open(member) as stream:
        for _, element in ElementTree.iterparse(stream):
            name = _name(element.tag)
            if name in tags:
                yield name, element
                element.clear()


def _letters(number: int) -> str:
    """Column letters of a column number counted from 1."""
    out = ""
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def _number(letters: str) -> int:
    out = 0
    for letter in letters:
        out = out * 26 + ord(letter) - 64
    return out


@dataclass
class _Book:
    """One open workbook: its string pool and where its sheets are."""

    file: zipfile.ZipFile
    pool: list[str]
    sheets: list[tuple[str, str]]

    @classmethod
    def open(cls, content: bytes) -> _Book:
        file = zipfile.ZipFile(io.BytesIO(content))
        pool = []
        if "xl/sharedStrings.xml" in file.namelist():
            for _, item in _events(file, "xl/sharedStrings.xml", "si"):
                pool.append(_plain(item))
        places = {e.get("Id"): posixpath.normpath(posixpath.join("/xl", e.get("Target", "")))[1:]
                  for _, e in _events(file, "xl/_rels/workbook.xml.rels", "Relationship")}
        sheets = []
        for _, e in _events(file, "xl/workbook.xml", "sheet"):
            link = next((v for k, v in e.attrib.items() if k.startswith("{") and _name(k) == "id"), None)
            if link in places:
                sheets.append((e.get("name", ""), places[link]))
        return cls(file, pool, sheets)

    def cells(self) -> Iterator[tuple]:
        for sheet, member in self.sheets:
            dimension, line = "", 0
            for name, element in _events(self.file, member, "dimension", "row"):
                if name == "dimension":
                    dimension = element.get("ref", "")
                    continue
                line = int(element.get("r") or line + 1)
                column = 0
                for cell in element:
                    ref = cell.get("r") or f"{_letters(column + 1)}{line}"
                    letters = ref.rstrip("0123456789")
                    column = _number(letters)
                    value, formula = self._content(cell)
                    if value or formula:
                        yield sheet, dimension, line, letters, ref, value, formula

    def _content(self, cell: ElementTree.Element) -> tuple[str, str]:
        parts = {_name(part.tag): part for part in cell}
        held = {name: (part.text or "") for name, part in parts.items()}
        value = held.get("v", "")
        kind = cell.get("t", "n")
        if kind == "inlineStr" and "is" in parts:
            value = _plain(parts["is"])
        elif kind == "s" and value.isdigit():
            place = int(value)
            value = self.pool[place] if place < len(self.pool) else value
        return value, held.get("f", "")


def _plain(item: ElementTree.Element) -> str:
    """Text of a rich or plain string, its runs joined."""
    return "".join(part.text or "" for part in item.iter() if _name(part.tag) == "t")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("path", pa.string()), ("sheet", pa.string()), ("dimension", pa.string()), ("row", pa.int32()),
             ("col", pa.string()), ("ref", pa.string()), ("value", pa.string()), ("formula", pa.string())]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], [n for n, _ in kinds])

    for files in batches:
        for path, content in zip(files.column(0).to_pylist(), files.column(1)):
            for cell in _Book.open(content.as_py()).cells():
                held.append((path, *cell))
                if len(held) == BATCH:
                    yield batch()
                    held.clear()
    if held:
        yield batch()


def workbook_cells(files: DataFrame) -> DataFrame:
    """Cells of workbooks given as (path, content); empty cells are dropped.

    A row or cell without a reference stands after the one before it.
    """
    return files.select("path", "content").mapInArrow(_read, CELLS)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    return workbook_cells(spark.read.format("binaryFile").load(path))


def sheet_summary(cells: DataFrame) -> DataFrame:
    """Dimension and number of formulas per sheet."""
    return cells.groupBy("path", "sheet").agg(
        F.first("dimension").alias("dimension"), F.count_if(F.col("formula") != "").alias("formula_count"))


def kpi_list(cells: DataFrame, sheet: str = fv.KPI_SHEET) -> DataFrame:
    """KPI rows: column A all digits and column C filled, with their source."""
    wanted = cells.where((F.col("sheet") == sheet) & F.col("col").isin("A", "B", "C"))
    wide = wanted.groupBy("path", "row").pivot("col", ["A", "B", "C"]).agg(F.first("value"))
    rows = wide.where(F.col("A").rlike(r"^\d+$") & (F.coalesce("C", F.lit("")) != ""))
    area = F.coalesce("B", F.lit(""))
    return rows.select(
        "path", F.col("A").cast("int").alias("number"), area.alias("area"), F.col("C").alias("kpi"),
        tx.kpi_source(F.col("C"), area).alias("source"))
