from pyspark.sql import functions as F

from opsloom.functions import html as hx
from opsloom.functions import text as tx

PAGE = """<html><head><title>t</title></head><body><a href='/x' title=y>caf&eacute; &#233;&#x41;</a>
<a href=/bare aria-label="B &amp; C">n&uuml;n</a><div role="button" class='tour-step'>Go <b>on</b></div>
<span role=button>Next</span><button title='k'>K</button><a>  </a></body></html>"""


def one(spark, column):
    return spark.createDataFrame([(PAGE,)], "html string").select(column.alias("o")).first()["o"]


def test_attributes_in_any_quotes(spark):
    got = [tuple(r) for r in one(spark, hx.elements(hx.body(F.col("html")), "a"))]
    assert got == [("café éA", "/x", "", "y"), ("nün", "/bare", "B & C", "")]


def test_buttons_by_tag_and_role(spark):
    got = [(r["text"], r["title"]) for r in one(spark, hx.elements(hx.body(F.col("html")), "button"))]
    assert got == [("Go on", ""), ("Next", ""), ("K", "k")]
    assert one(spark, hx.has_layer(F.col("html"), ("tour",)))


def test_references(spark):
    cases = {"&lt;a&gt; &copy;&nbsp;x": "<a> © x", "&amp;lt;": "&lt;", "&#0; &#1114112; &#128512;": "&#0; &#1114112; 😀",
             "&am &unknown; &": "&am &unknown; &", "plain": "plain"}
    df = spark.createDataFrame(list(cases.items()), "i string, o string")
    for r in df.select("o", hx.unescape(F.col("i")).alias("g")).collect():
        assert r["g"] == r["o"]


def test_compatibility_forms_fold(spark):
    cases = {"ﬁnalizar": "finalizar", "Ｅﬃｃａｚ": "efficaz", "ǅep ½ №": "dzep 1⁄2 no", "ça⃗": "ca", "İş": "is",
             "𝐀b": "ab"}
    df = spark.createDataFrame(list(cases.items()), "i string, o string")
    for r in df.select("o", tx.match_form(F.col("i")).alias("g")).collect():
        assert r["g"] == r["o"]
