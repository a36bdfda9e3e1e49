import random

import pytest

from opsloom.operators.fusion import Ranked, fused_top_k


def brute(lists, k, c=60):
    scores = {}
    for rows, falling in lists:
        order = sorted(rows, key=lambda r: (-r[1], -r[0] if falling else r[0]))
        for n, (i, _) in enumerate(order):
            scores.setdefault(i, []).append(1.0 / (c + n + 1))
    best = sorted((-sum(v), i) for i, v in scores.items())[:k]
    return [(i, round(-s, 12)) for s, i in best]


@pytest.mark.parametrize("seed,k,c", [(1, 20, 60), (2, 3, 1), (3, 50, 0), (4, 5, 600)])
def test_equal_to_a_full_fusion(spark, seed, k, c):
    pick = random.Random(seed)
    ids = list(range(1500))
    first = [(i, float(pick.randint(0, 40))) for i in pick.sample(ids, 900)]
    second = [(i, pick.random()) for i in pick.sample(ids, 1000)]
    got = fused_top_k([Ranked(spark.createDataFrame(first, "id long, score double")),
                       Ranked(spark.createDataFrame(second, "id long, score double"), falling_ids=True)], k, c).collect()
    assert [(r.id, round(r.score_final, 12)) for r in got] == brute([(first, False), (second, True)], k, c)
    assert [r.rank_position for r in got] == list(range(1, k + 1))


def test_short_and_empty_lists(spark):
    few = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "id long, score double")
    none = spark.createDataFrame([], "id long, score double")
    assert [r.id for r in fused_top_k([Ranked(few), Ranked(none)], 5).collect()] == [1, 3]
    assert fused_top_k([Ranked(none), Ranked(none)], 5).count() == 0
