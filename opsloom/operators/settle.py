"""Compute expensive columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Columns of one step: the code of a longer one outgrows what the JVM compiles to machine code.
STEP = 12


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later projections and filters read instead of recompute.

    Catalyst pushes a filter through a projection by copying the expression,
    and copies of nested array functions multiply. One struct in a one-element
    array, unpacked by a generator, is a row-local step it does not see through.
    Many columns are added in several such steps, unless one takes the place of
    another that is still read.
    """
    names = list(columns)
    if len(names) > STEP and not set(names) & set(df.columns):
        for low in range(0, len(names), STEP):
            df = settle(df, {name: columns[name] for name in names[low:low + STEP]})
        return df
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline_outer(F.array(row)))
