import json
import random
import re
import unicodedata

from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom import fixed_values as fv
from opsloom.functions import jsonx
from opsloom.functions import text as tx

SAMPLES = [
    "  Hola  mundo \n\t fin ", "El niño y la acción: 42 veces_x", "", None, "ÀÉÎõü ＡＢＣ",
    "a\x1cb c　", "the THE The, sólo DOS y uno", "x" * 300, "çedilla über naïve", "12 / 30 items",
]


def column(spark, values, expr):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, s string").select("i", expr(F.col("s")).alias("o"))
    return [r["o"] for r in df.orderBy("i").collect()]


def test_clean_collapses_every_white_space(spark):
    want = [" ".join((s or "").split()) for s in SAMPLES]
    assert column(spark, SAMPLES, tx.clean) == want


def test_match_form_folds_accents(spark):
    def form(s):
        bare = "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c))
        return " ".join(bare.lower().split())

    assert column(spark, SAMPLES, tx.match_form) == [form(s) for s in SAMPLES]


def test_tokens_keep_repeats_and_drop_stopwords(spark):
    def tokens(s):
        found = [w.lower() for w in re.findall(fv.TOKEN_PATTERN, s or "")]
        return [w for w in found if w not in fv.STOPWORDS]

    assert column(spark, SAMPLES, tx.tokens) == [tokens(s) for s in SAMPLES]
    assert tx.query_tokens("La casa, la CASA") == ["casa", "casa"]


def test_noise_and_time_lines(spark):
    lines = ["Respuestas rápidas", "3 / 10", "", "hola", "a las 12:45", "el 3/4/2025", "ayer vino"]
    assert column(spark, lines, tx.is_noise_line) == [True, True, True, False, False, False, False]
    assert column(spark, lines, tx.looks_like_time) == [False, False, False, False, True, True, True]


def test_preview_estimate_and_defaults(spark):
    assert column(spark, ["x" * 161, "short"], tx.preview) == ["x" * 157 + "...", "short"]
    assert column(spark, ["abc", "x" * 9], tx.token_estimate) == [1, 2]
    assert column(spark, ["  ", None, "a"], lambda c: tx.default_blank(c, "web")) == ["web", "web", "a"]
    urls = ["postgresql://u:p@h:5432/sales?x=1", "postgresql://h", "no url"]
    assert column(spark, urls, tx.database_name) == ["sales", "unknown", "unknown"]


def test_keyword_helpers(spark):
    df = spark.createDataFrame([(["Hola mundo", "Guía de Inicio", "Siguiente >"],)], "v array<string>")
    row = df.select(
        tx.keyword_hits(F.col("v"), ["siguiente", "guia", "tour", "mundo"], 2).alias("hits"),
        tx.first_text_match(F.col("v"), ["inicio"]).alias("first"),
        tx.first_long_text(F.col("v"), 11).alias("long"),
        tx.first_text_match(F.col("v"), ["zzz"]).alias("none"),
    ).first()
    assert row["hits"] == ["siguiente", "guia"]
    assert (row["first"], row["long"], row["none"]) == ("Guía de Inicio", "Guía de Inicio", "")


def test_stable_json_equals_sorted_dump(spark):
    kind = T.StructType([
        T.StructField("b", T.ArrayType(T.StringType())), T.StructField("a", T.MapType(T.StringType(), T.LongType())),
        T.StructField("c", T.StringType())])
    rng = random.Random(3)
    rows = [{"b": ["ñ\"q", "x\\y"], "a": {"k2": 2, "k1": rng.randint(0, 9)}, "c": None}]
    df = spark.createDataFrame([(r,) for r in rows], T.StructType([T.StructField("v", kind)]))
    got = df.select(jsonx.stable_json(F.col("v"), kind).alias("o")).first()["o"]
    assert got == json.dumps(rows[0], ensure_ascii=False, sort_keys=True)


def test_first_json_object(spark):
    replies = ['```json\n{"a": {"b": "}"}}\n```', 'Sure: {"x": 1} and {y}', "none", "{broken", None,
               '```{"gone": 1}```', ' {"x": NaN} ', 'a {"k": "{"} b', '{"k": 1, "k": 2}', "{a} {\"b\": 1}", "```\n{}\n```", '{"a": 1}, {"b": 2}']
    assert column(spark, replies, jsonx.first_json_object) == [
        '{"a": {"b": "}"}}', '{"x": 1}', None, None, None, None, '{"x": NaN}', '{"k": "{"}', '{"k": 1, "k": 2}', None, "{}", '{"a": 1}']


def test_merge_right_wins(spark):
    df = spark.sql("SELECT map('a', '1', 'b', '2') AS l, map('b', '3') AS r, CAST(NULL AS map<string,string>) AS n")
    row = df.select(jsonx.merge_maps(F.col("l"), F.col("r")).alias("x"),
                    jsonx.merge_maps(F.col("l"), F.col("n")).alias("y")).first()
    assert row["x"] == {"a": "1", "b": "3"} and row["y"] == {"a": "1", "b": "2"}
