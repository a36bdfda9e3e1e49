"""Dense-vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def to_literal(v: Column) -> Column:
    """``[x,y,...]`` with ten decimals; NULL stays NULL."""
    parts = F.transform(v, lambda x: F.format_string("%.10f", x.cast("double")))
    return F.when(v.isNotNull(), F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")))


def from_literal(text: Column) -> Column:
    return F.from_json(text, "array<float>")
