"""Tables kept in the shared folder while an operator works."""

from __future__ import annotations

import itertools

import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.session import new_scratch

#: A side of a join is sent to every executor only up to this many rows of two
#: or three numbers each (tens of MB); beyond it both sides are shuffled.
BROADCAST_ROWS = 2_000_000


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: work done once, no lineage."""
    path = new_scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str = "uid") -> DataFrame:
    """Give every row a number that each scan of the same table repeats.

    The number holds the row's file and its place in the file, so it does not
    depend on splits, on the cores there are, or on a task that is run again.
    ``docs`` is a scan of Parquet files, with projections and filters; of
    anything else the rows are written first.
    """
    file, row = fresh(docs, "_file", "_row")

    def placed(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.select("*", at["file_path"].alias(file), at["row_index"].alias(row))

    try:
        out = placed(docs)
    except AnalysisException:
        docs = kept(docs, "rows")
        out = placed(docs)
    salt, bits = _file_hash(docs.inputFiles())
    place = F.when(F.shiftright(row, 63 - bits) == 0, F.col(row)).otherwise(
        F.raise_error(F.lit("a file has too many rows to number them")).cast("long"))
    # Spark writes a local file as file:/a in one place and file:///a in another.
    path = F.ltrim(F.substring(F.col(file), F.instr(file, ":") + 1, F.length(file)), F.lit("/"))
    code = F.xxhash64(F.concat(path, F.lit(salt))).bitwiseAND((1 << bits) - 1)
    return out.select(*[quoted(c) for c in docs.columns], F.shiftleft(code, 63 - bits).bitwiseOR(place).alias(name))


def _file_hash(files: list[str]) -> tuple[str, int]:
    """(salt, bits) of a hash that tells all files apart; the driver lists them anyway."""
    paths = {f[f.find(":") + 1:].lstrip("/") for f in files}
    bits = max(38, 2 * len(paths).bit_length() - 1)
    for salt in map(str, itertools.count()):
        if len({xxhash.xxh64_intdigest(p + salt, 42) & ((1 << bits) - 1) for p in paths}) == len(paths):
            return salt, bits


def small_side(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Allow a broadcast of a written table if its counted rows are within the bound."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= bound else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")
