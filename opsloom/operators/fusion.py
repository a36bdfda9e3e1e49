"""Fused top-k of ranked lists by the threshold algorithm.

Lists are read from the top, to the same depth. A row that no list has shown by
then can reach at most the sum of what the next ranks are worth; once the k-th
best row is above that, nothing unseen can enter. Rows seen in some lists only
are looked up in the others, and their rank is counted there.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.operators.topk import top_k
from opsloom.session import cut_lineage


@dataclass(frozen=True)
class Ranked:
    """Rows (id, score), ids once, best score first; equal scores by id, rising or falling."""

    rows: DataFrame
    falling_ids: bool = False

    @property
    def order(self) -> list[Column]:
        return [F.col("score").desc(), F.col("id").desc() if self.falling_ids else F.col("id").asc()]

    def before(self, score, id_) -> Column:
        """Whether a row stands before a given one."""
        tie = F.col("id") > F.lit(id_) if self.falling_ids else F.col("id") < F.lit(id_)
        return (F.col("score") > F.lit(score)) | ((F.col("score") == F.lit(score)) & tie)

    def ranks(self, wanted: list) -> dict:
        """Ranks, from 1, of the ids that the list holds: a look-up, and one pass that counts between them."""
        if not wanted:
            return {}
        found = top_k(self.rows.where(F.col("id").isin(wanted)), self.order, len(wanted)).collect()
        if not found:
            return {}
        counts = dict(self.rows.groupBy(self._cell(found).alias("cell")).count().collect())
        out, total = {}, 0
        for i, row in enumerate(found):
            total += counts.get(i, 0)
            out[row["id"]] = total + 1
        return out

    def _cell(self, found: list) -> Column:
        """Number of the found rows that stand at or before a row, by bisection."""
        def between(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(self.before(found[middle]["score"], found[middle]["id"]), between(low, middle)).otherwise(between(middle + 1, high))

        return between(0, len(found))


def fused_top_k(lists: list[Ranked], k: int, c: int = 60) -> DataFrame:
    """(id, score_final, rank_position): the k best by the sum of 1 / (c + rank) over the lists.

    Equal sums go by id, rising. Equal to fusing the whole lists; how deep they
    are read follows from k and c, not from the data: with one list of k rows or
    more the k-th best is worth 1 / (c + k) at least.
    """
    k = max(k, 1)
    lists = [Ranked(cut_lineage(x.rows.select("id", "score").where("id IS NOT NULL AND score IS NOT NULL")), x.falling_ids) for x in lists]
    depth = 2 * k
    while True:
        seen = [{r["id"]: r["rank_position"] for r in top_k(x.rows, x.order, depth).collect()} for x in lists]
        every = sorted(set().union(*seen))
        rank = [s | x.ranks([i for i in every if i not in s]) if len(s) >= depth else s for x, s in zip(lists, seen)]
        fused = sorted((-sum(1.0 / (c + r[i]) for r in rank if i in r), i) for i in every)
        open_ = [s for s in seen if len(s) >= depth]           # lists that go on
        beyond = len(open_) / (c + depth + 1)
        if not open_ or bisect.bisect_left(fused, (-beyond,)) >= k:
            break
        depth *= 2
    schema = T.StructType([T.StructField("id", lists[0].rows.schema["id"].dataType), T.StructField("score_final", T.DoubleType()),
                           T.StructField("rank_position", T.IntegerType())])
    return lists[0].rows.sparkSession.createDataFrame([(i, -s, n + 1) for n, (s, i) in enumerate(fused[:k])], schema)
