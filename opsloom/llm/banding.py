"""Candidate pairs from banded signatures, verified, and joined into components.

A bucket holds the items that agree in one band. Its members are paired with
the smallest member and with their neighbour in the order of the next band, so
a bucket of n items gives fewer than 2n pairs whatever its size. Pairs with the
smallest member are verified first; neighbours that are then still apart second.
Buckets whose members are not one component by then are worked through whole:
all pairs between different components of a bucket are compared, in small
buckets one by one, in crowds as products of block matrices. So no pair that
shares a band is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.arrow import mix
from opsloom.llm.components import components, extended
from opsloom.llm.store import kept, small_side

WITH_SMALLEST, WITH_NEIGHBOUR, EDGE, MEMBER = 0, 1, 2, 3

#: Members of a bucket up to which its pairs become rows.
FEW = 24
#: Members of a crowd that are compared with as many others at a time, and shingles of a matrix.
BLOCK, COLUMNS = 256, 4096


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` columns, as signed numbers."""
    n, width = signature.shape
    out = np.zeros((n, width // rows), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(width // rows):
            key = np.full(n, b + 1, np.uint64)
            for j in range(rows):
                key = mix(key + signature[:, b * rows + j] + np.uint64(0x9E3779B97F4A7C15))
            out[:, b] = key
    return out.view(np.int64)


def bucket_pairs(signed: DataFrame, tails: bool = True) -> tuple[DataFrame, DataFrame]:
    """Tables (kind, a, b) of pairs and (band, id) of members; ``signed`` has id and bands (array<long>).

    Rows are range-partitioned and sorted by (band, next band, id), so a bucket
    of any size is spread over tasks; what a bucket has in several tasks is
    joined through its smallest members. Without ``tails`` the order within a
    band is by id alone. Members are those of all buckets of three or more.
    """
    full = signed.filter(F.size("bands") > 0)
    if tails:
        turned = F.concat(F.slice("bands", 2, F.size("bands") - 1), F.slice("bands", 1, 1))
        rows = full.select("id", F.inline(F.arrays_zip(F.col("bands").alias("band"), turned.alias("tail"))))
    else:
        rows = full.select("id", F.explode("bands").alias("band"))
    order = ["band", "tail", "id"] if tails else ["band", "id"]
    placed = rows.select(*order).repartitionByRange(*order)
    made = kept(placed.mapInArrow(_runs, "kind int, a long, b long"), "buckets")
    edges = made.filter(F.col("kind") == EDGE).select(F.col("a").alias("band"), "b")
    across = (edges.groupBy("band").agg(F.min("b").alias("a"), F.count("*").alias("n")).filter("n > 1")
              .join(edges, "band").select(F.lit(WITH_SMALLEST).alias("kind"), "a", "b"))
    pairs = made.filter(F.col("kind") < EDGE).union(across).filter("a <> b")
    return pairs, made.filter(F.col("kind") == MEMBER).select(F.col("a").alias("band"), F.col("b").alias("id"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs, members and edges of the buckets of one range; its rows are a few numbers each."""
    parts = [[np.asarray(c) for c in batch.columns] for batch in batches if len(batch)]
    if not parts:
        return
    columns = [np.concatenate(c) for c in zip(*parts)]
    del parts
    order = np.lexsort(columns[::-1])
    band, ids = columns[0][order], columns[-1][order]
    del columns, order
    same = band[1:] == band[:-1]
    run = np.concatenate([[0], np.cumsum(~same)])
    size = np.bincount(run)
    size[[0, -1]] = 3                # what goes on in another task may be longer
    wide = np.flatnonzero(size[run] > 2)
    yield _pairs(MEMBER, band[wide], ids[wide])
    smallest = _smallest_so_far(ids, run)
    follows = np.flatnonzero(same) + 1
    here, star, near = ids[follows], smallest[follows - 1], ids[follows - 1]
    yield _pairs(WITH_SMALLEST, star, here)
    yield _pairs(WITH_NEIGHBOUR, near[near != star], here[near != star])
    edge = np.unique([0, len(ids) - 1])
    yield _pairs(EDGE, band[edge], smallest[edge])


def _smallest_so_far(ids: np.ndarray, run: np.ndarray) -> np.ndarray:
    """For each place the smallest id of its run up to there; runs ascend."""
    values, rank = np.unique(ids, return_inverse=True)
    back = run * (len(values) + 1)
    return values[np.minimum.accumulate(rank - back) + back] if len(ids) else ids


def _pairs(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "kind": pa.array(np.full(len(a), kind, np.int32)), "a": pa.array(a), "b": pa.array(b)})


def linked(signed: DataFrame, texts: Callable[[DataFrame], DataFrame], holds: Callable,
           sets: Callable[[pa.Array], list], alike: Callable, least: float, tails: bool = True) -> DataFrame:
    """(node, root) of all items that a verified pair links to another.

    ``texts`` gives (id, text) for written distinct ids, ``holds`` keeps the
    pairs of (a, b, text_a, text_b) that are alike, ``sets`` gives the distinct
    shingles and their weights for texts, and ``alike`` says whether two of
    these sets are; all are by the similarity ``least``.
    """
    def verify(pairs: DataFrame) -> DataFrame:
        found = texts(kept(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "needed"))
        with_b = pairs.join(found.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        both = with_b.join(found.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        return kept(both.select("a", "b", "text_a", "text_b").mapInArrow(holds, "a long, b long"), "links")

    pairs, members = bucket_pairs(signed, tails)
    pairs = pairs.select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    each = kept(pairs.groupBy("a", "b").agg(F.min("kind").alias("kind")), "pairs")
    links = verify(each.filter(F.col("kind") == WITH_SMALLEST).select("a", "b"))
    roots = components(links)
    near = each.filter(F.col("kind") == WITH_NEIGHBOUR).select("a", "b")
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    apart = (near.join(of("a"), "a", "left").join(of("b"), "b", "left")
             .filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    second = verify(kept(apart, "apart"))
    if second.limit(1).count():
        roots = extended(roots, second)

    rooted = kept(members.join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        "band", "id", F.coalesce("root", "id").alias("root")), "members")
    buckets = kept(rooted.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y"))
                   .filter("n > 2 AND x < y").select("band", "n"), "open")
    still = kept(rooted.join(small_side(buckets), "band"), "open")
    few, crowds = still.filter(F.col("n") <= FEW), still.filter(F.col("n") > FEW)
    one, two = (few.select("band", F.col("id").alias(s), F.col("root").alias(f"root_{s}")) for s in "ab")
    rest = (one.join(two, "band").filter("a < b AND root_a <> root_b").select("a", "b").distinct()
            .join(each.select("a", "b"), ["a", "b"], "left_anti"))
    more = [verify(kept(rest, "rest"))]
    if crowds.limit(1).count():
        more.append(_crowd_links(crowds, texts, sets, alike, least))
    for links in more:
        if links.limit(1).count():
            roots = extended(roots, links)
    return roots


def _crowd_links(members: DataFrame, texts: Callable, sets: Callable, alike: Callable, least: float) -> DataFrame:
    """Written links (a, b) that join all alike members (band, id, root) of each bucket.

    A bucket is cut into blocks of about ``BLOCK`` members, those of a large
    component apart from the others; every two blocks are a job, unless both
    are of the same component.
    """
    parts = kept(members.groupBy("band", "root").agg(F.count("*").alias("c")).withColumn(
        "owner", F.when(F.col("c") > BLOCK, F.col("root")).otherwise(-1)), "parts")
    sizes = kept(parts.groupBy("band", "owner").agg(F.ceil(F.sum("c") / BLOCK).alias("salts")), "sizes")
    large = parts.filter("owner >= 0").select("band", "root", "owner")
    owned = members.join(small_side(kept(large, "large")), ["band", "root"], "left").select(
        "band", "id", "root", F.coalesce("owner", F.lit(-1)).alias("owner"))
    placed = kept(owned.join(small_side(sizes), ["band", "owner"]).select(
        "band", "id", "root", "owner", F.expr("pmod(xxhash64(id), salts)").alias("salt")), "placed")
    blocks = kept(placed.select("band", F.struct("owner", "salt").alias("block")).distinct(), "blocks")
    jobs = (blocks.withColumnRenamed("block", "x").join(blocks.withColumnRenamed("block", "y"), "band")
            .filter("x <= y AND (x.owner < 0 OR x.owner <> y.owner)")
            .withColumn("job", F.monotonically_increasing_id()))
    sides = kept(kept(jobs, "jobs").select("band", "job", F.explode(F.expr(
        "if(x = y, array(named_struct('side', 0, 'block', x)), "
        "array(named_struct('side', 1, 'block', x), named_struct('side', 2, 'block', y)))")).alias("part")).select(
        "band", "job", "part.side", "part.block.owner", "part.block.salt"), "sides")
    work = kept(placed.join(small_side(sides), ["band", "owner", "salt"]).select("job", "side", "id", "root"), "work")
    found = texts(kept(work.select("id").distinct(), "needed"))
    made = work.join(found, "id").select("job", "side", "id", "root", "text").groupBy("job").applyInArrow(
        _compare(sets, alike, least), "a long, b long")
    return kept(made, "links")


def _compare(sets: Callable, alike: Callable, least: float):
    """Links that join the alike members of two blocks (sides 1 and 2), or of one (side 0).

    For weights x and y with totals X and Y, of which X' and Y' lie on shared
    shingles, the probability Jaccard is at most 1 / (X/X' + Y/Y' - 1), and just
    that where all weights are 1. Pairs within this bound are verified.
    """

    def run(job: pa.Table) -> pa.Table:
        ids, roots, side = (job.column(c).to_numpy() for c in ("id", "root", "side"))
        each = sets(job.column("text").combine_chunks())
        left, right = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
        whole, on_left, on_right = _shared_weights(each, left, right)
        with np.errstate(divide="ignore"):
            most = 1 / (whole[left, None] / on_left + whole[right] / on_right - 1)
        hits = (most >= least - 1e-6) & (roots[left, None] != roots[right])
        if not side.any():
            hits &= left[:, None] < right
        parent = {r: r for r in roots.tolist()}

        def top(r: int) -> int:
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        a, b = [], []
        for i, j in zip(*(x.tolist() for x in np.nonzero(hits))):
            i, j = left[i], right[j]
            x, y = top(int(roots[i])), top(int(roots[j]))
            if x != y and alike(each[i], each[j]):
                parent[x] = y
                a.append(ids[i])
                b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _shared_weights(each: list, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight of each set, and per pair that of the left and of the right one on their shared shingles."""
    n = len(each)
    owner = np.repeat(np.arange(n), [len(k) for k, _ in each])
    weight = np.concatenate([w for _, w in each]).astype(np.float32)
    column = np.unique(np.concatenate([k for k, _ in each]), return_inverse=True)[1]
    whole = np.bincount(owner, weight, n)
    several = np.bincount(column) > 1
    number = np.cumsum(several) - 1
    on = several[column]
    owner, weight, column = owner[on], weight[on], number[column[on]]
    order = np.argsort(column, kind="stable")
    owner, weight, column = owner[order], weight[order], column[order]
    plain = bool((weight == 1).all())
    on_left = np.zeros((len(left), len(right)), np.float32)
    on_right = on_left if plain else on_left.copy()
    for low in range(0, int(several.sum()), COLUMNS):
        x, y = np.searchsorted(column, [low, low + COLUMNS])
        dense = np.zeros((n, COLUMNS), np.float32)
        dense[owner[x:y], column[x:y] - low] = weight[x:y]
        some = dense if plain else (dense > 0).astype(np.float32)
        on_left += dense[left] @ some[right].T
        if not plain:
            on_right += some[left] @ dense[right].T
    return whole, on_left.astype(float), on_right.astype(float)
