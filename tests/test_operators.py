import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.operators import hierarchy, keyed, ranges, ranking, segmented, topk


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all rows belong to one key; times repeat."""
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 20)}",
             start + timedelta(seconds=rng.randint(0, 50_000)), i, rng.choice([None, None, f"v{i}"]),
             rng.random() < 0.4) for i in range(3000)]
    # Rows without key, rows without time, and a burst within one second.
    rows += [(None, start + timedelta(seconds=i % 40), 3000 + i, rng.choice([None, f"n{i}"]), i % 5 < 4) for i in range(300)]
    rows += [("hot", None, 4000 + i, rng.choice([None, f"t{i}"]), i % 3 > 0) for i in range(30)]
    rows += [("burst", start + timedelta(microseconds=i), 5000 + i, rng.choice([None, f"b{i}"]), i % 7 > 0) for i in range(400)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, v string, bad boolean")


def same(a, b, columns):
    left = sorted(map(tuple, a.select(*columns).collect()), key=repr)
    right = sorted(map(tuple, b.select(*columns).collect()), key=repr)
    assert left == right


@pytest.fixture(scope="module", params=[100, 10**9])
def cut(request, skewed):
    return segmented.with_segments(skewed, ["k"], "ts", "seg", request.param, parts=7)


def test_segmented_scans_equal_plain_windows(skewed, cut):
    order = W.partitionBy("k").orderBy("ts", "id")
    got = segmented.last_known(cut, ["k"], "seg", ["ts", "id"], F.col("v"), "o")
    want = skewed.withColumn("o", F.last("v", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    same(got, want, ["id", "o"])
    got = segmented.next_known(cut, ["k"], "seg", ["ts", "id"], F.col("v"), "o")
    want = skewed.withColumn("o", F.first("v", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)))
    same(got, want, ["id", "o"])
    got = segmented.running_count(cut, ["k"], "seg", ["ts", "id"], F.col("bad"), "o")
    want = skewed.withColumn("o", F.sum(F.col("bad").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    same(got, want, ["id", "o"])


def test_a_burst_is_cut(skewed):
    cut = segmented.with_segments(skewed, ["k"], "ts", "seg", 100, parts=7)
    sizes = [r["n"] for r in cut.where("k = 'burst'").groupBy("seg").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 7 and max(sizes) < 120


def test_runs(skewed, cut):
    got = segmented.runs_of(cut, ["k"], "seg", ["ts", "id"], F.col("bad"), 3)
    want, rows = [], {}
    for r in skewed.orderBy("k", "ts", "id").collect():
        rows.setdefault(r["k"], []).append(r)
    for k, seq in rows.items():
        run = []
        for r in [*seq, None]:
            if r is not None and r["bad"]:
                run.append(r)
            else:
                if len(run) >= 3:
                    times = [x["ts"] for x in run if x["ts"] is not None]
                    want.append((k, len(run), min(times, default=None), max(times, default=None)))
                run = []
    found = map(tuple, got.select("k", "run_length", "run_start", "run_end").collect())
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_as_of_latest_start_among_valid(spark):
    rng = random.Random(9)
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    price = [(rng.choice("ab"), day(s), rng.choice([None, day(s + rng.randint(1, 30))]), float(i))
             for i, s in enumerate(rng.sample(range(90), 40))]
    facts = [(i, rng.choice("abc"), day(rng.randint(-5, 120)) + timedelta(hours=rng.randint(0, 23))) for i in range(400)]
    prices = spark.createDataFrame(price, "m string, f timestamp_ntz, t timestamp_ntz, p double")
    pieces = ranges.elementary_ranges(prices, ["m"], "f", "t", ["-f"])
    df = spark.createDataFrame(facts, "id int, m string, ts timestamp_ntz")

    def best(m, ts):
        fit = [x for x in price if x[0] == m and x[1] <= ts and (x[2] is None or ts < x[2])]
        return max(fit, key=lambda x: x[1])[3] if fit else None

    want = sorted((i, best(m, ts)) for i, m, ts in facts)
    for bucket in (None, 1, 10):
        out = ranges.as_of(df, "ts", pieces, ["m"], "f", "t", "left", bucket)
        assert sorted((r["id"], r["p"]) for r in out.collect()) == want


def test_pieces_are_linear_in_a_busy_key(spark):
    """Twenty thousand overlapping ranges of one key: the best at any time, in a few seconds."""
    rows = spark.range(20_000).select(
        F.lit("k").alias("k"), F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit(datetime(2024, 1, 1))).alias("f"),
        F.when(F.col("id") % 2 == 0, F.timestamp_add("SECOND", (F.col("id") + 5000).cast("int"), F.lit(datetime(2024, 1, 1)))).alias("t"),
        (F.col("id") * 7919 % 20_000).alias("p"), F.col("id").alias("n"))
    got = [(r.f, r.t, r.p) for r in ranges.elementary_ranges(rows, ["k"], "f", "t", ["p", "n"]).orderBy("f").collect()]
    assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(got, got[1:])) and got[-1][1] is None
    data = [(r.f, r.t, r.p) for r in rows.collect()]
    for at in got[::199]:
        assert min(p for f, t, p in data if f <= at[0] and (t is None or at[0] < t)) == at[2]


def test_open_starts(spark):
    day = lambda n: datetime(2024, 1, n)
    rows = [("a", None, day(5), 1), ("a", day(3), None, 2), ("a", day(4), day(4), 0), ("b", None, None, 3), ("b", day(2), day(3), 1)]
    df = spark.createDataFrame(rows, "k string, f timestamp_ntz, t timestamp_ntz, p int")
    got = ranges.elementary_ranges(df, ["k"], "f", "t", ["p"], open_start=True).collect()
    assert sorted([(r.k, r.p, r.f, r.t) for r in got], key=str) == sorted([
        ("a", 1, None, day(5)), ("a", 2, day(5), None), ("b", 3, None, day(2)), ("b", 1, day(2), day(3)), ("b", 3, day(3), None)], key=str)


def test_roots_depth_path_and_cycle(spark):
    edges = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(37)] + [("x", "outside"), ("y", "x")]
    rows = {r["node"]: r for r in hierarchy.resolve_roots(
        spark.createDataFrame(edges, "id string, up string"), "id", "up").collect()}
    assert len(rows) == 39
    assert rows["n36"]["root"] == "n0" and rows["n36"]["depth"] == 36
    assert rows["n3"]["path"] == "n0/n1/n2/n3" and rows["y"]["path"] == "x/y" and rows["x"]["depth"] == 0
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, up string")
    with pytest.raises(ValueError):
        hierarchy.resolve_roots(loop, "id", "up", max_rounds=3)


def test_vector_top_k_both_ways(spark):
    rng = np.random.default_rng(2)
    c, q = rng.normal(size=(300, 8)).astype("float32"), rng.normal(size=(40, 8)).astype("float32")
    c[17] = c[40]
    q[0] = c[17]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)] + [(999, [0.0] * 8)], "id long, vec array<float>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vec array<float>")
    unit = lambda m: m.astype("float64") / np.linalg.norm(m.astype("float64"), axis=1, keepdims=True)
    dist = 1 - unit(q) @ unit(c).T
    want = {(i, int(j)) for i in range(40) for j in np.lexsort((-np.arange(300), dist[i].round(12)))[:5]}
    for options in ({}, {"block_values": 80}):
        got = topk.vector_top_k(corpus, queries, 5, **options).collect()
        assert {(r["query_id"], r["id"]) for r in got} == want
    first = [r["id"] for r in sorted(got, key=lambda r: r["rank_position"]) if r["query_id"] == 0][:2]
    assert first == [40, 17]
    named = corpus.select(F.format_string("v-%03d", "id").alias("id"), "vec")
    got = topk.vector_top_k(named, queries.withColumn("query_id", F.concat(F.lit("q"), "query_id")), 5).collect()
    assert {(int(r["query_id"][1:]), int(r["id"][2:])) for r in got} == want


def test_ranks_match_rank(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0, 0, 0, None, rng.randint(1, 500)]), i) for i in range(800)]
    rows += [("empty", None, 900), ("empty", None, 901)]
    df = spark.createDataFrame(rows, "s string, m int, id int")
    want = df.withColumn("hi", F.rank().over(W.partitionBy("s").orderBy(F.desc("m")))).withColumn(
        "lo", F.rank().over(W.partitionBy("s").orderBy("m")))
    for parts in (2, 64):
        same(ranking.competition_ranks(df, "s", "m", "hi", "lo", parts), want, ["id", "hi", "lo"])


def test_keyed_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, keyed.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, keyed.insert_absent(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "C")]
    twice = spark.createDataFrame([(3, "x"), (3, "C"), (None, "n"), (None, "m"), (2, "A"), (2, "B")], "k int, v string")
    void = old.union(spark.createDataFrame([(None, "o")], "k int, v string"))
    assert sorted(map(tuple, keyed.upsert(void, twice, ["k"], ["v"]).collect()), key=repr) == sorted(
        [(1, "a"), (2, "B"), (3, "x"), (None, "n")], key=repr)
    assert sorted(map(tuple, keyed.insert_absent(void, twice, ["k"], ["v"]).collect()), key=repr) == sorted(
        [(1, "a"), (2, "b"), (3, "x"), (None, "o")], key=repr)
    assert sorted(map(tuple, keyed.replace_children(old, new, "k", new.where("k = 2")).collect())) == [
        (1, "a"), (2, "B"), (3, "C")]
    rows = spark.createDataFrame([(1, "x", 3), (1, "x", 1), (1, "y", 2), (2, "z", 9)], "g int, f string, p int")
    assert sorted(map(tuple, keyed.dedupe_ordered(rows, ["g"], ["f"], "p", 1).collect())) == [(1, "x", 1), (2, "z", 9)]
    assert sorted(map(tuple, keyed.latest_per_key(rows, ["g"], ["p"]).collect())) == [(1, "x", 3), (2, "z", 9)]
