import random

import pytest

from opsloom.operators.hierarchy import resolve_roots, subtree_intervals


def brute(edges):
    up = dict(edges)
    children = {}
    for n, p in edges:
        if p in up:
            children.setdefault(p, []).append(n)
    out = {}
    for root in sorted(n for n, p in edges if p not in up):
        count, stack = 0, [(root, 0, True)]
        while stack:
            n, depth, first = stack.pop()
            if first:
                out[n] = [root, depth, count]
                count += 1
                stack.append((n, depth, False))
                stack.extend((c, depth + 1, True) for c in sorted(children.get(n, []), reverse=True))
            else:
                out[n].append(count - 1)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_equal_a_walk(spark, seed):
    pick = random.Random(seed)
    edges = [(i, pick.choice([None, -5, 0, 0, 0, *range(max(0, i - 9), i)]) if i else None) for i in range(700)]
    got = {r.node: [r.root, r.depth, r.low, r.high] for r in subtree_intervals(spark.createDataFrame(edges, "id long, up long"), "id", "up").collect()}
    assert got == brute(edges)


def test_a_hot_parent_and_a_long_chain(spark):
    chain = [(i, i - 1 if i else None) for i in range(20_000)]
    broad = [(100_000 + i, 19_999) for i in range(10_000)]
    got = {r.node: (r.depth, r.low, r.high) for r in subtree_intervals(
        spark.createDataFrame(chain + broad, "id long, up long").repartition(7), "id", "up").collect()}
    assert got[0] == (0, 0, 29_999) and got[19_999] == (19_999, 19_999, 29_999)
    assert all(got[100_000 + i] == (20_000, 20_000 + i, 20_000 + i) for i in range(10_000))


def test_cycles_raise_and_empty_tables(spark):
    with pytest.raises(ValueError, match="cycle"):
        subtree_intervals(spark.createDataFrame([(1, 2), (2, 1)], "id long, up long"), "id", "up", max_rounds=3)
    assert subtree_intervals(spark.createDataFrame([], "id long, up long"), "id", "up").count() == 0


def test_roots_without_paths(spark):
    out = resolve_roots(spark.createDataFrame([(1, None), (2, 1)], "id long, up long"), "id", "up", path=False)
    assert out.columns == ["node", "root", "depth"] and sorted(map(tuple, out.collect())) == [(1, 1, 0), (2, 1, 1)]
