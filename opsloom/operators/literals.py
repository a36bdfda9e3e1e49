"""Small fixed tables written into the plan, so Catalyst knows their size."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_sql(v) for v in value) + ")"
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def fixed_table(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """A lookup table of constants: a local relation, broadcast by its size."""
    body = ", ".join("(" + ", ".join(_sql(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def text_array(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def lookup(key: Column, mapping: dict) -> Column:
    """A constant dictionary as one ``CASE`` expression; NULL when absent."""
    out = None
    for name, value in mapping.items():
        test = key == F.lit(name)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out
