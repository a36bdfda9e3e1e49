import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opsloom.operators import postings


def tables(spark, seed, n_chunks=300, n_queries=40):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(30)]
    chunks = [(s, i, pick.choices(words, weights, k=min(int(pick.paretovariate(0.9)), 400))) for s in ("a", "b") for i in range(s == "b", n_chunks, 2)]
    chunks += [("a", 9000, []), ("a", 9001, None), (None, 9002, ["w1"])]
    queries = [(q, pick.choice("aab"), Counter(pick.choices(words, weights, k=pick.randint(1, 12)))) for q in range(n_queries)]
    queries += [(900, "a", Counter(["nowhere"])), (901, "c", Counter(["w1"]))]
    terms = [(q, s, t, n) for q, s, c in queries for t, n in c.items()]
    return chunks, queries, (spark.createDataFrame(chunks, "scope string, chunk_id long, tokens array<string>").repartition(5),
                             spark.createDataFrame(terms, "query_id long, scope string, token string, weight long"))


def brute(chunks, queries, k):
    out = {}
    for q, scope, terms in queries:
        found = [(-sum(n * (tokens or []).count(t) for t, n in terms.items()), i) for s, i, tokens in chunks if s == scope]
        out.update({(q, r + 1): (i, -w) for r, (w, i) in enumerate(sorted(x for x in found if x[0])[:k])})
    return out


@pytest.mark.parametrize("seed,k,size,bits", [(1, 5, 64, 6), (2, 3, 4, 1), (3, 1, 2, 2), (4, 400, 8, 1)])
def test_equal_to_brute_force(spark, monkeypatch, seed, k, size, bits):
    monkeypatch.setattr(postings, "FAN_BITS", bits)
    chunks, queries, (c, t) = tables(spark, seed)
    got = {(r.query_id, r.rank_position): (r.chunk_id, r.total) for r in postings.best_chunks(c, t, k, size).collect()}
    assert got == brute(chunks, queries, k)


def test_more_tokens_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(postings, "SENT_TOKENS", 1)
    chunks, queries, (c, t) = tables(spark, 5, 60, 10)
    got = {(r.query_id, r.rank_position): (r.chunk_id, r.total) for r in postings.best_chunks(c, t, 2, 8).collect()}
    assert got == brute(chunks, queries, 2)


def test_blocks_hold_postings_in_impact_order(spark):
    chunks, _, (c, _) = tables(spark, 6)
    index = postings.posting_blocks(c, size=16).collect()
    assert all(r["counts"] == sorted(r["counts"], reverse=True) and r.most == r["counts"][0] and len(r.chunks) <= 16 for r in index)
    assert Counter({(i, r.token): n for r in index for i, n in zip(r.chunks, r["counts"])}) == Counter(
        {(i, t): n for _, i, tokens in chunks for t, n in Counter(tokens or []).items()})


def test_short_chunks_are_not_read(spark):
    """Blocks whose bounds stay below the floor are ruled out."""
    rows = [(0, i, ["x"] * (100 - i // 10) + ["y"]) for i in range(1000)]
    c = spark.createDataFrame(rows, "scope int, chunk_id long, tokens array<string>")
    t = spark.createDataFrame([(1, 0, "x", 1)], "query_id long, scope int, token string, weight long")
    search = postings._Search(postings.posting_blocks(c, size=10), t, 5)
    floors = {r.query_id: r.floor for r in search.floors().collect()}
    assert floors == {1: 100}
    reached = search.index.where((F.col("token") == "x") & (F.col("most") >= 100)).count()
    assert reached <= 3


def test_empty_tables(spark):
    c = spark.createDataFrame([], "scope int, chunk_id long, tokens array<string>")
    t = spark.createDataFrame([], "query_id long, scope int, token string, weight long")
    assert postings.best_chunks(c, t, 5).count() == 0
