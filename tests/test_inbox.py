import pytest
from pyspark.sql import functions as F

from opsloom.plans import inbox as ib

ITEMS = [
    # Named buyer, product from the link, question after the buyer line.
    (1, "Comprador: Ana\n¿Tenés stock de este faro para mi auto?\nAyer\nSin responder",
     [("Publicación faro led", "https://articulo.mercadolibre.com/MLA-1")], ["Responder"], ["Sin responder"]),
    # Buyer by brackets; noise lines dropped; no hints at all.
    (2, "Respuestas rápidas\nJuan (Rosario)\nquiero saber si sirve para camioneta\n3 / 20", [], [], []),
    # Nothing usable.
    (3, "hola", [], [], []),
    # A metrics card without question or product.
    (4, "Tiempo de respuesta\nCalculamos estos valores cada día", [], [], []),
    # Product from a long link text that is not the call to action.
    (5, "linea uno bastante larga?", [("Responder", ""), ("Compresor 12v portátil", "")], [], []),
]
SCHEMA = ("id int, raw_text string, links array<struct<text:string,href:string>>, "
          "cta_texts array<string>, status_texts array<string>")


@pytest.fixture(scope="module")
def rows(spark):
    out = ib.question_summary(spark.createDataFrame(ITEMS, SCHEMA)).withColumn("q", ib.looks_like_question())
    return {r["id"]: r for r in out.collect()}


def test_named_buyer(rows):
    r = rows[1]
    assert r["buyer_hint"] == "Comprador: Ana"
    assert r["text_snippet"] == "¿Tenés stock de este faro para mi auto?"
    assert r["product_hint"] == "Publicación faro led" and r["product_href"].endswith("MLA-1")
    assert (r["status_hint"], r["cta_hint"], r["time_hint"]) == ("Sin responder", "Responder", "Ayer")
    assert r["q"]


def test_bracketed_buyer(rows):
    r = rows[2]
    assert r["buyer_hint"] == "Juan (Rosario)"
    assert r["text_snippet"] == "quiero saber si sirve para camioneta"


def test_weak_entries(rows):
    assert rows[3]["text_snippet"] == "" and not rows[3]["q"]
    assert not rows[4]["q"]
    assert rows[5]["product_hint"] == "Compresor 12v portátil" and rows[5]["cta_hint"] == "Responder" and rows[5]["q"]


def test_collection_prefers_real_questions(spark):
    rows = [("p", 1, 1, False, "a"), ("p", 2, 5, True, "b"), ("p", 2, 6, True, "b"), ("p", 2, 7, True, "c"),
            ("z", 1, 3, False, "x"), ("z", 1, 4, False, "y")]
    df = spark.createDataFrame(rows, "page string, selector int, position int, is_question boolean, text_snippet string")
    for c in ("product_hint", "buyer_hint", "time_hint", "status_hint", "cta_hint"):
        df = df.withColumn(c, F.lit(""))
    out = ib.collect_questions(df, "page", "selector", "position").collect()
    assert sorted((r["page"], r["text_snippet"]) for r in out) == [("p", "b"), ("p", "c"), ("z", "x")]


def test_intents_slots_handoff(spark):
    df = spark.createDataFrame([("¿Cuánto dura? ¿VA PARA mi moto?", 1), ("No sé qué ficha", 1), ("buenas", 9)], "s string, n int")
    out = df.select(
        ib.best_rule(F.col("s"), ib.INTENT_RULES).alias("i"),
        ib.missing_slots(F.lit("compatibilidad"), F.array(F.lit("voltaje"))).alias("m"),
        ib.needs_handoff(F.col("s"), F.lit(None).cast("string"), F.array(F.lit("a")), F.col("n")).alias("h")).collect()
    assert [r["i"] for r in out] == ["compatibilidad", None, None]
    assert out[0]["m"] == ["vehiculo_o_contexto", "marca_modelo_año", "conector_o_formato"]
    assert [r["h"] for r in out] == [False, True, False]


PAGE = ('<html><head><title>t</title></head><body><div class="onb wizard-box"><h1>Bienvenido</h1>'
        '<a href="/x" title="T">Ver  más</a><a href="/x" title="T">Ver más</a><button aria-label="Siguiente"></button>'
        '<button></button><script>var a="<a>";</script><iframe></iframe></div></body></html>')


def test_pages(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<body></body>")], "page_id int, html string")
    m = {r["page_id"]: r for r in ib.page_metrics(df).collect()}
    assert (m[1]["anchor_count"], m[1]["button_count"], m[1]["iframe_count"]) == (2, 2, 1)
    seen = {r["page_id"]: r for r in ib.inspect_pages(df, ["ver mas"]).collect()}
    assert [tuple(x) for x in seen[1]["links"]] == [("Ver más", "/x", "", "T")]
    assert len(seen[1]["buttons"]) == 1 and seen[1]["warnings"] == []
    assert len(seen[2]["warnings"]) == 4
    o = {r["page_id"]: r for r in ib.onboarding(df).collect()}
    assert o[1]["detected"] and not o[2]["detected"]
