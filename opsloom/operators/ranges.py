"""Validity ranges: the best row in force at any time, as-of joins."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def elementary_ranges(ranges: DataFrame, keys: Sequence[str], start: str, end: str, best: Sequence[str],
                      open_start: bool = False) -> DataFrame:
    """Non-overlapping pieces of validity ranges, each with its winning row.

    ``best`` names the columns that order the rows valid at a time, the first
    to win; ``-`` before a number or time turns it round. A NULL end is open; a
    range with NULL start is left out, or with ``open_start`` has begun before
    all others. Afterwards a range join meets at most one piece per probe row.

    One sweep per key over the starts, with the open ranges in a heap: linear
    but for the heap, and a task holds no more than the ranges open at a time.
    """
    if not open_start:
        ranges = ranges.where(F.col(start).isNotNull())
    names = [b.lstrip("-") for b in best]
    ordered = ranges.repartition(*keys).sortWithinPartitions(*keys, F.col(start).asc_nulls_first(), *names)
    rest = [c for c in ranges.columns if c not in keys and c not in (start, end)]
    made = ordered.select(*keys, start, end, *rest)
    found = made.mapInArrow(_sweep(list(keys), start, end, list(best)), T.StructType(
        [T.StructField(f.name, f.dataType) for f in made.schema]))
    return found.select(*keys, start, end, *rest)


def _number(value):
    if isinstance(value, datetime):
        return (value.replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds()
    return value.toordinal() if isinstance(value, date) else value


def _sweep(keys: list[str], start: str, end: str, best: list[str]):
    """Pieces of rows that come by key and start."""

    def rank(row: dict) -> tuple:
        out = []
        for name in best:
            value = _number(row[name.lstrip("-")])
            out.append((value is None, -value if name.startswith("-") and value is not None else value if value is not None else 0))
        return tuple(out)

    def pieces(open_: list, low, until) -> Iterator[tuple]:
        """(from, to, row) from ``low`` to ``until`` (None: without end), of the ranges in the heap."""
        while open_:
            row = open_[0][2]
            if row[end] is not None and low is not None and row[end] <= low:
                heapq.heappop(open_)
                continue
            stop = row[end] if until is None or row[end] is not None and row[end] < until else until
            yield low, stop, row
            if stop is None or stop == until:
                return
            low = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, low, last, count = None, [], None, None, 0

        def closed(until):
            """Pieces up to ``until``; what goes on with the same row is held back."""
            nonlocal last
            for begin, stop, row in pieces(open_, low, until):
                if last is not None and last[2] is row and last[1] == begin:
                    last = (last[0], stop, row)
                    continue
                if last is not None:
                    yield last
                last = (begin, stop, row)

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                here = tuple(row[k] for k in keys)
                if row[end] is not None and row[start] is not None and row[end] <= row[start]:
                    continue
                if here != key:
                    out += closed(None)
                    out += [last] if last is not None else []
                    key, open_, low, last = here, [], row[start], None
                elif row[start] != low:
                    out += closed(row[start])
                    low = row[start]
                count += 1
                heapq.heappush(open_, (rank(row), count, row))
            yield _rows(out, batch.schema, start, end)
        out = list(closed(None))
        out += [last] if last is not None else []
        if out:
            yield _rows(out, batch.schema, start, end)

    return run


def _rows(pieces: list[tuple], schema: pa.Schema, start: str, end: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row | {start: begin, end: stop} for begin, stop, row in pieces], schema)


def as_of(facts: DataFrame, ts: str, pieces: DataFrame, keys: Sequence[str], start: str,
          end: str, how: str = "left", bucket_days: int | None = None) -> DataFrame:
    """Join each fact to the piece in force at its time.

    With ``bucket_days`` the pieces are copied into calendar buckets and the
    join becomes an equi join on (keys, bucket): use it when a key has
    thousands of pieces. Buckets run over the starts of the pieces; earlier and
    later facts go to the first and last. Whether the pieces are broadcast is
    left to their measured size.
    """
    pieces = pieces.withColumnRenamed(start, "_from").withColumnRenamed(end, "_to")
    on = list(keys)
    inside = (F.col("_from").isNull() | (F.col(ts) >= F.col("_from"))) & (F.col("_to").isNull() | (F.col(ts) < F.col("_to")))
    if bucket_days:
        def bucket(c: str):
            days = F.expr(f"timestampdiff(DAY, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")
            return F.floor(days / bucket_days).cast("int")

        span = pieces.agg(F.min(bucket("_from")).alias("lo"), F.max(bucket("_from")).alias("hi")).first()
        lo, hi = span["lo"] or 0, span["hi"] or 0

        def within(c):
            return F.greatest(F.least(c, F.lit(hi)), F.lit(lo))

        pieces = pieces.withColumn("_b", F.explode(F.sequence(
            within(F.coalesce(bucket("_from"), F.lit(lo))), within(F.coalesce(bucket("_to"), F.lit(hi))))))
        facts = facts.withColumn("_b", within(bucket(ts)))
        on.append("_b")
    left, right = facts.alias("f"), pieces.alias("p")
    match = inside
    for key in on:
        match = match & (F.col(f"f.{key}") == F.col(f"p.{key}"))
    extra = [F.col(f"p.{c}") for c in pieces.columns if c not in [*on, "_from", "_to"]]
    kept = [F.col(f"f.{c}") for c in facts.columns if c != "_b"]
    return left.join(right, match, how).select(*kept, *extra)
