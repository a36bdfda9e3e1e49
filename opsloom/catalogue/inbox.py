"""Queries over stored pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom import fixed_values as fv
from opsloom.catalogue.registry import Tables, query
from opsloom.catalogue.text import sql_clean, sql_form, sql_list
from opsloom.functions import html as hx
from opsloom.functions import text as tx
from opsloom.operators.literals import lookup, text_array
from opsloom.operators.settle import settle
from opsloom.plans import inbox as ib

_BODY = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'),
 '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?is)<head\\b.*?</head>', ' ', 'g')"""
_UNESC = ("replace(replace(replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''),"
          " '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')")


def _unesc(x: str) -> str:
    return _UNESC.replace("{x}", x)


_PAGES = f"""
b AS (SELECT page_id, html, {_BODY} AS body FROM pages),
l AS (SELECT page_id, html, body, list_filter(list_transform(string_split(regexp_replace(body, '(?s)<[^>]*>', chr(10), 'g'), chr(10)),
  lambda s: {sql_clean(_unesc('s'))}), lambda s: s <> '') AS lines FROM b)
"""


@query("page_metrics", f"WITH {_PAGES}" + """
SELECT page_id, len(regexp_extract_all(body, '(?i)<a\\b'))::BIGINT AS anchor_count, len(regexp_extract_all(body, '(?i)<button\\b'))::BIGINT AS button_count,
 len(regexp_extract_all(body, '(?i)<iframe\\b'))::BIGINT AS iframe_count, coalesce(length(array_to_string(lines, chr(10))), 0)::BIGINT AS body_text_length,
 length(regexp_extract(html, '(?is)<body\\b[^>]*>(.*?)(?:</body\\s*>|\\z)', 1))::BIGINT AS body_html_length, len(lines)::BIGINT AS n_lines FROM l
""")
def page_metrics(t: Tables):
    out = ib.page_metrics(t.pages)
    return out.select("page_id", *[F.col(c).cast("long").alias(c) for c in out.columns[1:]])


@query("page_text_chunks", f"WITH {_PAGES}" + """,
c AS (SELECT page_id, unnest(lines) AS s, unnest(range(1, len(lines) + 1)) AS p FROM l),
d AS (SELECT page_id, substr(s, 1, 120) AS chunk, min(p) AS p FROM c GROUP BY ALL)
SELECT page_id, chunk, r AS position FROM (SELECT page_id, chunk, row_number() OVER (PARTITION BY page_id ORDER BY p) AS r FROM d) WHERE r <= 20
""")
def page_text_chunks(t: Tables):
    return t.pages.select("page_id", F.posexplode(hx.text_chunks(hx.body(F.col("html")))).alias("p", "chunk")).select(
        "page_id", "chunk", (F.col("p") + 1).cast("long").alias("position"))


@query("page_links", f"WITH {_PAGES}" + f""",
e AS (SELECT page_id, unnest(regexp_extract_all(body, '(?is)<a\\b[^>]*>.*?</a>')) AS m,
  unnest(range(1, len(regexp_extract_all(body, '(?is)<a\\b[^>]*>.*?</a>')) + 1)) AS p FROM l),
f AS (SELECT page_id, p, substr({sql_clean(_unesc("regexp_replace(m, '(?s)<[^>]*>', ' ', 'g')"))}, 1, 200) AS text,
  regexp_extract(m, '(?is)^<[^>]*\\shref\\s*=\\s*"([^"]*)"', 1) AS href FROM e),
d AS (SELECT page_id, text, href, min(p) AS p FROM f WHERE text || href <> '' GROUP BY ALL)
SELECT page_id, text, href, r AS position FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY p) AS r FROM d) WHERE r <= 50
""")
def page_links(t: Tables):
    return t.pages.select("page_id", F.posexplode(hx.elements(hx.body(F.col("html")), "a", hx.LINKS)).alias("p", "e")).select(
        "page_id", "e.text", "e.href", (F.col("p") + 1).cast("long").alias("position"))


_PAGE_WORDS = ("the", "und", "les", "next")


@query("page_flags", f"WITH {_PAGES}" + f""",
a AS (SELECT page_id, regexp_extract_all(body, '(?is)<a\\b[^>]*>.*?</a>') AS links, regexp_extract_all(body, '(?is)<button\\b[^>]*>.*?</button>') AS buttons, lines,
  regexp_matches(body, '(?i)\\s(class|role|data-testid)\\s*=\\s*"[^"]*(banner|onboarding|coachmark|tour|wizard|modal|dialog|overlay|backdrop)[^"]*"') AS layer FROM l),
h AS (SELECT *, list_filter({sql_list(_PAGE_WORDS)}, lambda k: len(list_filter(lines[1:20], lambda s: contains({sql_form('substr(s, 1, 160)')}, k))) > 0) AS hits FROM a)
SELECT page_id, (len(links) > 0)::INT AS has_links, (len(buttons) > 0)::INT AS has_buttons, layer::INT AS layer FROM h
""")
def page_flags(t: Tables):
    found = ib.inspect_pages(t.pages, _PAGE_WORDS)
    return found.select(
        "page_id", (F.size("links") > 0).cast("int").alias("has_links"),
        (F.size("buttons") > 0).cast("int").alias("has_buttons"), F.col("layer").cast("int").alias("layer"))


@query("page_filters", f"WITH {_PAGES}" + f""",
e AS (SELECT page_id, unnest(regexp_extract_all(body, '(?is)<a\\b[^>]*>.*?</a>')) AS m,
  unnest(range(1, len(regexp_extract_all(body, '(?is)<a\\b[^>]*>.*?</a>')) + 1)) AS p FROM l),
f AS (SELECT page_id, p, substr({sql_clean(_unesc("regexp_replace(m, '(?s)<[^>]*>', ' ', 'g')"))}, 1, 200) AS text,
  regexp_extract(m, '(?is)^<[^>]*\\shref\\s*=\\s*"([^"]*)"', 1) AS href FROM e),
d AS (SELECT page_id, text, href, min(p) AS p FROM f WHERE text || href <> ''
  AND len(list_filter({sql_list(_PAGE_WORDS)}, lambda k: contains({sql_form("text || ' ' || href")}, k))) > 0 GROUP BY ALL)
SELECT page_id, text, href, r AS position FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY p) AS r FROM d) WHERE r <= 12
""")
def page_filters(t: Tables):
    return ib.filter_affordances(t.pages, _PAGE_WORDS).select("page_id", F.posexplode("affordances").alias("p", "e")).select(
        "page_id", "e.text", "e.href", (F.col("p") + 1).cast("long").alias("position"))


@query("page_onboarding")
def page_onboarding(t: Tables):
    out = ib.onboarding(t.pages, _PAGE_WORDS)
    return out.select("page_id", F.array_join("matched_keywords", "|").alias("hits"),
                      F.size("matched_buttons").alias("n_buttons"), "detected")


def question_items(t: Tables):
    """User turns as question entries; some lines get the words of the inbox."""
    n = F.col("turn") % 6
    head = (F.when(n == 0, "Comprador: Ana (Lima)").when(n == 1, "Juan (Rosario)").when(n == 2, "Respuestas rápidas")
            .when(n == 3, "Tiempo de respuesta").otherwise("Hoy 12:45"))
    tail = (F.when(n == 0, "Sin responder").when(n == 1, "Publicación: faro led").when(n == 4, "¿Va para mi auto?").otherwise(""))
    link = F.struct(F.concat(F.lit("Ver artículo "), "conv_id").alias("text"),
                    F.concat(F.lit("https://articulo.mercadolibre.com/"), "conv_id").alias("href"))
    links = F.when(n < 2, F.array(link)).otherwise(F.slice(F.array(link), 1, 0))
    return t.conversations.where("role = 'user'").select(
        "conv_id", "turn", F.concat_ws("\n", head, "text", tail).alias("raw_text"), links.alias("links"),
        F.when(n == 0, text_array(["Responder"])).otherwise(F.array().cast("array<string>")).alias("cta_texts"),
        F.when(n == 5, text_array(["Pendiente"])).otherwise(F.array().cast("array<string>")).alias("status_texts"))


@query("question_summary")
def question_summary(t: Tables):
    return ib.question_summary(question_items(t))


@query("question_filter")
def question_filter(t: Tables):
    out = ib.question_summary(question_items(t)).withColumn("is_question", ib.looks_like_question())
    return out.select("conv_id", "turn", F.col("is_question").cast("int").alias("is_question"))


@query("question_collect")
def question_collect(t: Tables):
    rows = settle(ib.question_summary(question_items(t)), {
        "is_question": ib.looks_like_question(), "selector": (F.col("turn") % 2).cast("int")})
    return ib.collect_questions(rows, "conv_id", "selector", "turn").select(
        "conv_id", "selector", "turn", "text_snippet", "question_rank")


_DRAFTS = """
m AS (SELECT conv_id, turn, text || CASE CAST(turn % 7 AS INT) WHEN 0 THEN ' ¿Va para mi auto, LED H7?' WHEN 1 THEN ' es plug and play el compresor'
  WHEN 2 THEN ' hay stock? llega mañana' WHEN 3 THEN ' cuánto dura' WHEN 4 THEN ' alumbra bien y va para camioneta'
  WHEN 5 THEN ' no sé qué ficha lleva' ELSE '' END AS body, turn AS turns FROM conversations WHERE role = 'user')
"""


def _drafts(t: Tables):
    n = F.col("turn") % 7
    tail = (F.when(n == 0, " ¿Va para mi auto, LED H7?").when(n == 1, " es plug and play el compresor")
            .when(n == 2, " hay stock? llega mañana").when(n == 3, " cuánto dura")
            .when(n == 4, " alumbra bien y va para camioneta").when(n == 5, " no sé qué ficha lleva").otherwise(""))
    return t.conversations.where("role = 'user'").select("conv_id", "turn", F.concat("text", tail).alias("body"))


def _case(rules, form: str) -> str:
    ordered = sorted(enumerate(rules), key=lambda r: (r[1][1], r[0]))
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({form}, '{tx.match_key(p)}')" for p in phrases)
                              + f" THEN '{name}'" for _, (name, _, phrases) in ordered) + " END"


_SLOTS = " ".join(f"WHEN '{k}' THEN {sql_list(v)}" for k, v in fv.INTENT_SLOTS.items())


@query("intent_tag", f"WITH {_DRAFTS}, f AS (SELECT *, {sql_form('body')} AS form FROM m)" + f"""
SELECT conv_id, turn, {_case(ib.INTENT_RULES, 'form')} AS intent, {_case(fv.PRODUCT_LINES, 'form')} AS product_line FROM f
""")
def intent_tag(t: Tables):
    body = F.col("body")
    return _drafts(t).select("conv_id", "turn", ib.best_rule(body, ib.INTENT_RULES).alias("intent"),
                             ib.best_rule(body, fv.PRODUCT_LINES).alias("product_line"))


@query("missing_slots", f"WITH {_DRAFTS}, f AS (SELECT *, {sql_form('body')} AS form FROM m), i AS (SELECT *, {_case(ib.INTENT_RULES, 'form')} AS intent FROM f)," + f"""
s AS (SELECT *, list_filter(coalesce(CASE intent {_SLOTS} END, []), lambda x: NOT (x = 'voltaje' AND turn % 2 = 0)) AS need FROM i)
SELECT conv_id, turn, array_to_string(need, '|') AS missing,
 (contains(form, 'no se que') OR contains(form, 'pieza adaptada') OR contains(form, 'piezas adaptadas') OR contains(form, 'no original') OR contains(form, 'no originales')
  OR (intent IS NOT NULL AND len(need) > 0 AND turn >= 3))::INT AS handoff FROM s
""")
def missing_slots(t: Tables):
    rows = settle(_drafts(t), {"intent": ib.best_rule(F.col("body"), ib.INTENT_RULES)})
    filled = F.when(F.col("turn") % 2 == 0, text_array(["voltaje"])).otherwise(F.array().cast("array<string>"))
    rows = settle(rows, {"need": ib.missing_slots(F.col("intent"), filled)})
    return rows.select(
        "conv_id", "turn", F.array_join("need", "|").alias("missing"),
        ib.needs_handoff(F.col("body"), F.col("intent"), F.col("need"), F.col("turn")).cast("int").alias("handoff"))


# Example phrases and priority per comment tag; the tags are fixed, the rest a parameter.
TAG_EXAMPLES = {
    "apoyo_israel": (8, ("apoyo", "and the")), "pregunta_religiosa": (7, ("torah", "dans")),
    "interes_curso": (4, ("curso", "les")), "interes_moria": (6, ("moria", "keit")), "donacion": (3, ("donar", "ein")),
    "soporte": (2, ("error", "the ")), "hate_risk": (0, ("odio", "hate")), "spam_scam": (5, ("http", "ver")),
    "idioma_no_es": (9, ("the of", "und der")), "requiere_humano": (1, ("urgente", "that")),
}
TAG_RULES = sorted([(tag, *TAG_EXAMPLES[tag]) for tag in fv.COMMENT_TAGS], key=lambda r: r[1])


@query("comment_tags", f"WITH f AS (SELECT conv_id, turn, {sql_form('text')} AS form FROM conversations)" + f"""
SELECT conv_id, turn, array_to_string(list_filter([{', '.join(
    "CASE WHEN " + ' OR '.join(f"contains(form, '{tx.match_key(p)}')" for p in ps) + f" THEN '{n}' END" for n, _, ps in TAG_RULES)}], lambda x: x IS NOT NULL), '|') AS tags,
 coalesce({_case(TAG_RULES, 'form')}, 'none') AS main_tag FROM f
""")
def comment_tags(t: Tables):
    return t.conversations.select(
        "conv_id", "turn", F.array_join(ib.all_rules(F.col("text"), TAG_RULES), "|").alias("tags"),
        F.coalesce(ib.best_rule(F.col("text"), TAG_RULES), F.lit("none")).alias("main_tag"))


_TOPICS = [topic for topic, _ in fv.OFFER_ROUTES]


@query("offer_route", f"""
SELECT conv_id, turn, CASE {sql_list(_TOPICS + ['otro'])}[(conv_id % 8)::INT + 1] {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in fv.OFFER_ROUTES)} ELSE 'humano' END AS next_offer
FROM conversations WHERE role = 'user'
""")
def offer_route(t: Tables):
    topic = F.get(text_array([*_TOPICS, "otro"]), (F.col("conv_id") % 8).cast("int"))
    return t.conversations.where("role = 'user'").select(
        "conv_id", "turn", F.coalesce(lookup(topic, dict(fv.OFFER_ROUTES)), F.lit("humano")).alias("next_offer"))


@query("map_rows", """
WITH s AS (SELECT o_orderkey, ['inventory', 'prices', 'extra'][(o_custkey % 3)::INT + 1] AS e1, 'crm' AS s1, 'orders' AS e2, ['erp', 'spreadsheet'][(o_custkey % 2)::INT + 1] AS s2 FROM orders),
u AS (SELECT o_orderkey, e1 AS e, s1 AS s FROM s UNION ALL SELECT o_orderkey, e2, s2 FROM s)
SELECT o_orderkey, CASE e WHEN 'inventory' THEN 'Stock' WHEN 'prices' THEN 'Precios' WHEN 'orders' THEN 'Pedidos' ELSE e END AS entity,
 CASE s WHEN 'crm' THEN 'CRM' WHEN 'erp' THEN 'ERP' WHEN 'spreadsheet' THEN 'Planilla' END AS source FROM u
""")
def map_rows(t: Tables):
    from opsloom.plans.labels import map_rows as rows_of

    pick = lambda words, n: F.get(text_array(words), n.cast("int"))
    sources = F.create_map(
        pick(["inventory", "prices", "extra"], F.col("o_custkey") % 3), F.lit("crm"),
        F.lit("orders"), pick(["erp", "spreadsheet"], F.col("o_custkey") % 2))
    rows = t.orders.select("o_orderkey", sources.alias("m"), F.lit("es").alias("locale"))
    return rows_of(rows, "o_orderkey", "m", "locale").select("o_orderkey", "entity", "source")
