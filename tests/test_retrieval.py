import itertools
import random

import pytest
from pyspark.sql import functions as F

from opsloom.functions import text as tx
from opsloom.plans import retrieval as rt

DOCS = [(1, "kb", "Seguridad", "mfa y faceid sin bypass"), (2, "kb", "Otro", "excel mfa mfa"),
        (3, "kb", "Nada", "sin relacion"), (4, "x", "Seguridad", "mfa mfa mfa")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, scope string, title string, content string")


def test_keyword_counts_repeated_query_tokens(docs):
    kb = rt.in_scope(docs, "kb")
    rows = rt.keyword_top_k(kb, "MFA mfa seguridad", ["title", "content"], ["id"]).orderBy("rank_position").collect()
    assert [(r["id"], r["score"]) for r in rows] == [(2, 1.3333), (1, 1.0)]
    assert rt.keyword_top_k(kb, "", ["title", "content"], ["id"]).count() == 0
    assert len(rt.keyword_top_k(kb, "mfa", ["content"], ["id"], 0).collect()) == 2
    with pytest.raises(ValueError):
        rt.keyword_top_k(kb, "mfa", ["content"], ["id"], -1)


def test_mode_none_returns_nothing(docs):
    assert rt.in_scope(docs, "kb", "none").count() == 0
    assert rt.in_scope(docs, "kb", None).count() == 3


def test_batch_equals_single(spark, docs):
    queries = [(1, "mfa mfa excel"), (2, "sin mfa"), (3, "nothing"), (4, "")]
    table = spark.createDataFrame(queries, "query_id long, query_text string")
    batch = rt.keyword_top_k_batch(docs, table, "id", "content", 2).collect()
    for qid, text in queries:
        single = rt.keyword_top_k(docs, text, ["content"], ["id"], 2).collect()
        assert sorted((r["chunk_id"], r["score"]) for r in batch if r["query_id"] == qid) == sorted(
            (r["id"], r["score"]) for r in single)


def covers(words, wanted):
    """All minimal passages with every wanted word, by brute force."""
    full = [(i, j) for i, j in itertools.combinations_with_replacement(range(len(words)), 2)
            if set(wanted) <= set(words[i:j + 1])]
    small = [s for s in full if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in full)]
    return sum(0.1 / (1 + (j - i) - (sum(w in wanted for w in words[i:j + 1]) - 1)) for i, j in small)


def test_cover_density_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "the", "x", "z"]) for _ in range(rng.randint(0, 25))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    for query in ("aa", "aa bb", "cc aa bb"):
        got = df.select("i", rt.cover_density(F.col("s"), query).alias("c")).orderBy("i").collect()
        for row, text in zip(got, texts):
            assert row["c"] == pytest.approx(covers(text.split(), set(tx.query_tokens(query))))


def test_and_match(spark):
    df = spark.createDataFrame([("aa bb",), ("aa",), (None,)], "s string")
    assert df.where(rt.matches_all(F.col("s"), "bb aa aa")).count() == 1
    assert df.where(rt.matches_all(F.col("s"), "the")).count() == 0


def test_semantic_search(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    out = rt.semantic_top_k(df, [1.0, 0.1], "v", "id", 2).orderBy("rank_position").collect()
    assert [r["id"] for r in out] == [3, 1]
