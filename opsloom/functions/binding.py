"""Give an intermediate value a name inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Inside a lambda every mention of an expression is evaluated again, once per
    element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
