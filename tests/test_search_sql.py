import pytest

from opsloom.plans.search_sql import register_search

ROWS = [(1, "red widget stock", [1.0, 0.0], "north", "web"), (2, "widget red, the red widget", [0.0, 1.0], "north", "chat"),
        (3, "blue widget", [1.0, 1.0], "south", "web"), (4, None, None, None, None)]


@pytest.fixture(scope="module")
def search(spark):
    spark.createDataFrame(ROWS, "chunk_id long, body string, embedding array<float>, project string, channel string").createOrReplaceTempView("some_chunks")
    register_search(spark, "some_chunks")
    return lambda sql: [tuple(r) for r in spark.sql(sql).collect()]


def test_lexical(search):
    assert [r[0] for r in search("SELECT * FROM lexical_search('red widget')")] == [2, 1]
    assert [r[0] for r in search("SELECT * FROM lexical_search('widget', 1)")] == [2]
    assert [r[0] for r in search("SELECT * FROM lexical_search('widget', project => 'south', channel => 'web')")] == [3]
    assert [r[0] for r in search("SELECT * FROM lexical_search('widget', project => 'south', channel => 'chat')")] == []
    assert search("SELECT * FROM lexical_search('the')") == []


def test_semantic(search):
    assert [(r[0], round(r[1], 6), r[2]) for r in search("SELECT * FROM semantic_search(array(1D, 0D), NULL)")] == [(1, 0.0, 1), (3, 0.292893, 2), (2, 1.0, 3)]
    assert [r[0] for r in search("SELECT * FROM semantic_search(array(1D, 0D), 2, channel => 'web')")] == [1, 3]
    with pytest.raises(Exception, match="negative"):
        search("SELECT * FROM semantic_search(array(1D, 0D), -1)")


def test_no_more_than_k_rows_leave_a_task(spark, search):
    plan = spark.sql("SELECT * FROM lexical_search('red widget', 2)")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=2" in plan
