"""Top-k of chunks by shared words for many queries, by block-max pruning.

Words are counted inside a chunk's row. Chunks are put in order of their length
and cut into blocks; a block keeps, for every token, its postings in impact
order (highest count first) and the highest count as an upper bound. Nodes over
``FAN`` blocks, over ``FAN`` of these, and so on, keep bounds alone. A query goes
down to its most promising block first; the score that its k-th chunk has there
rules out every node whose bounds add up to less. Only postings of the blocks
that are left are read, so neither a frequent token nor a long list of chunks is
joined as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.operators.keyed import first_n
from opsloom.session import new_scratch

#: Chunks of a block, and nodes under a node.
BLOCK, FAN_BITS = 64, 6
#: Distinct query tokens up to which chunks drop all other tokens as they are read (some MB).
SENT_TOKENS = 100_000
_LOCAL = 33


def _written(df: DataFrame, label: str) -> DataFrame:
    path = new_scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _count(only: list[str] | None):
    """Replace the token list of each row by its distinct tokens and their counts."""
    wanted = None if only is None else pa.array(only, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            column = batch.column("tokens")
            n = len(batch)
            size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
            row, flat = np.repeat(np.arange(n), size), column.flatten()
            if wanted is not None:
                on = pc.is_in(flat, value_set=wanted)
                row, flat = row[np.asarray(on)], flat.filter(on)
            coded = flat.dictionary_encode()
            words = max(len(coded.dictionary), 1)
            code, count = np.unique(row * words + np.asarray(coded.indices), return_counts=True)
            edge = pa.array(np.searchsorted(code, np.arange(n + 1) * words), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("scope"), batch.column("chunk_id"), pa.array(size, pa.int64()),
                pa.ListArray.from_arrays(edge, coded.dictionary.take(pa.array(code % words))),
                pa.ListArray.from_arrays(edge, pa.array(count, pa.int64()))], ["scope", "chunk_id", "length", "tokens", "counts"])

    return run


def _invert(size: int):
    """Postings of each block of ``size`` chunks; rows come in order, and a block has one scope."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << _LOCAL
        for batch in batches:
            scopes = np.asarray(batch.column("scope").dictionary_encode().indices.fill_null(-1))
            cuts = np.append(np.flatnonzero(np.append(True, scopes[1:] != scopes[:-1])), len(batch))
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                for low in range(begin, end, size):
                    yield _inverted(batch.slice(low, min(size, end - low)), block)
                    block += 1

    return run


def _inverted(part: pa.RecordBatch, block: int) -> pa.RecordBatch:
    tokens = part.column("tokens")
    coded = tokens.flatten().dictionary_encode()
    token, count = np.asarray(coded.indices), np.asarray(part.column("counts").flatten())
    row = np.repeat(np.arange(len(part)), np.asarray(tokens.value_lengths()))
    order = np.lexsort((row, -count, token))
    token, count, row = token[order], count[order], row[order]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    edge = pa.array(np.append(first, len(token)), pa.int32())
    scope = part.column("scope").slice(0, 1)
    return pa.RecordBatch.from_arrays([
        scope.take(pa.array(np.zeros(len(first), np.int64))), pa.array(np.full(len(first), block), pa.int64()),
        coded.dictionary.take(pa.array(token[first])), pa.array(count[first], pa.int64()),
        pa.ListArray.from_arrays(edge, part.column("chunk_id").take(pa.array(row))),
        pa.ListArray.from_arrays(edge, pa.array(count, pa.int64()))], ["scope", "block", "token", "most", "chunks", "counts"])


def posting_blocks(chunks: DataFrame, only: list[str] | None = None, size: int = BLOCK) -> DataFrame:
    """Written table (scope, block, token, most, chunks, counts) of ``chunks`` (scope, chunk_id, tokens).

    ``most`` is the highest count in the block; ``chunks`` and ``counts`` are in
    impact order. With ``only`` other tokens are left out.
    """
    plain = chunks.select("scope", "chunk_id", "tokens")
    keys = [plain.schema["scope"], plain.schema["chunk_id"]]
    lists = [T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType()))]
    counted = plain.mapInArrow(_count(only), T.StructType([*keys, T.StructField("length", T.LongType()), *lists]))
    # Written, as putting rows in ranges reads them twice and words are to be found once.
    counted = _written(counted, "counts")
    order = [F.col("scope"), F.col("length").desc(), F.col("chunk_id")]
    placed = counted.repartitionByRange(*order).sortWithinPartitions(*order)
    made = placed.mapInArrow(_invert(size), T.StructType([
        keys[0], T.StructField("block", T.LongType()), T.StructField("token", T.StringType()), T.StructField("most", T.LongType()),
        T.StructField("chunks", T.ArrayType(keys[1].dataType)), T.StructField("counts", T.ArrayType(T.LongType()))]))
    return _written(made, "postings")


def _above(node: Column | str, levels: int = 1) -> Column:
    """The node that stands over a block or node, within its part of the index."""
    node = F.col(node) if isinstance(node, str) else node
    local = F.shiftright(node.bitwiseAND((1 << _LOCAL) - 1), levels * FAN_BITS)
    return F.shiftleft(F.shiftright(node, _LOCAL), _LOCAL).bitwiseOR(local)


class _Search:
    """Bounds of all levels over one index, and one set of query terms."""

    def __init__(self, index: DataFrame, terms: DataFrame, k: int):
        self.index, self.terms, self.k = index, terms, k
        self.bounds = [index.select("scope", F.col("block").alias("node"), "token", "most")]
        last = index.agg(F.max(F.col("block").bitwiseAND((1 << _LOCAL) - 1))).first()[0] or 0
        while last:
            last >>= FAN_BITS
            below = self.bounds[-1].groupBy("scope", _above("node").alias("node"), "token").agg(F.max("most").alias("most"))
            self.bounds.append(_written(below, "bounds"))

    def _bounded(self, met: DataFrame) -> DataFrame:
        return met.groupBy("query_id", "scope", "node").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))

    def top(self) -> DataFrame:
        """(query_id, scope, node, bound) of the highest level."""
        return self._bounded(self.terms.join(self.bounds[-1], ["scope", "token"]))

    def below(self, nodes: DataFrame, level: int) -> DataFrame:
        """The same of the nodes on ``level`` under (query_id, scope, node)."""
        under = self.bounds[level].withColumn("over", _above("node"))
        asked = nodes.select("query_id", "scope", F.col("node").alias("over")).join(self.terms, ["query_id", "scope"])
        return self._bounded(asked.join(under, ["scope", "over", "token"]))

    def scored(self, blocks: DataFrame) -> DataFrame:
        """(query_id, chunk_id, total) of the chunks of these blocks that share a token."""
        asked = blocks.select("query_id", "scope", F.col("node").alias("block")).join(self.terms, ["query_id", "scope"])
        met = asked.join(self.index.select("scope", "block", "token", "chunks", "counts"), ["scope", "block", "token"])
        each = met.select("query_id", "weight", F.inline(F.arrays_zip(F.col("chunks").alias("chunk_id"), F.col("counts").alias("tf"))))
        return each.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("tf")).alias("total"))

    def best(self, scored: DataFrame) -> DataFrame:
        return first_n(scored, ["query_id"], [F.col("total").desc(), F.col("chunk_id").asc()], self.k)

    def floors(self) -> DataFrame:
        """(query_id, floor): a total that k chunks of the query's most promising block reach."""
        nodes = self.top()
        for level in range(len(self.bounds) - 2, -1, -1):
            nodes = self.below(self._most_promising(nodes), level)
        found = self.best(self.scored(self._most_promising(nodes)))
        return found.where(F.col("rank_position") == self.k).select("query_id", F.col("total").alias("floor"))

    def _most_promising(self, nodes: DataFrame) -> DataFrame:
        best = nodes.groupBy("query_id").agg(F.max(F.struct("bound", "scope", "node")).alias("best"))
        return best.select("query_id", "best.scope", "best.node")

    def run(self) -> DataFrame:
        floors = _written(self.floors(), "floors")

        def left(nodes: DataFrame) -> DataFrame:
            return nodes.join(floors, "query_id", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(0)))

        nodes = left(self.top())
        for level in range(len(self.bounds) - 2, -1, -1):
            nodes = left(self.below(nodes, level))
        return self.best(self.scored(nodes))


def best_chunks(chunks: DataFrame, terms: DataFrame, k: int, size: int = BLOCK) -> DataFrame:
    """The k chunks of highest total for every query: query_id, chunk_id, total, rank_position.

    ``chunks`` has scope, chunk_id and tokens (every occurrence); ``terms`` has
    query_id, scope, token and weight, one row per query and distinct token,
    with a weight above 0. The total is the sum of weight times occurrences;
    ties go to the smaller chunk_id. A query meets chunks of its own scope;
    chunks that share no token with it are no result. Exact, whatever is pruned.
    """
    terms = _written(terms.select("query_id", "scope", "token", "weight"), "terms")
    tokens = _written(terms.select("token").distinct(), "tokens")
    only = [r.token for r in tokens.collect()] if tokens.count() <= SENT_TOKENS else None
    return _Search(posting_blocks(chunks, only, size), terms, max(k, 1)).run()
