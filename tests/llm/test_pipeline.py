from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def test_stages_keep_columns_and_shrink(spark):
    import corpus_pipeline as p
    from opsloom.llm.store import kept

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = kept(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n
        n = docs.count()
    assert docs.filter("n_chars <> length(text)").count() == 0
    packed = p.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_accept_an_empty_table(spark):
    import corpus_pipeline as p
    from opsloom.llm.store import kept

    docs = kept(spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0), "none")
    for _, stage in p.STAGES:
        docs = kept(stage(spark, docs, FOLDER), "stage")
        assert docs.count() == 0


def test_native_query_equals_its_sql(spark):
    import duckdb

    from opsloom.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    cur = con.execute(queries.ORACLES["op10_quoted_threads"])
    names = [d[0] for d in cur.description]
    got = queries.QUERIES["op10_quoted_threads"](spark, FOLDER).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cur.fetchall()))
