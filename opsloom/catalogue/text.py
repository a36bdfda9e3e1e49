"""Queries over scalar text, JSON and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom import fixed_values as fv
from opsloom.catalogue.registry import Tables, query
from opsloom.functions import jsonx
from opsloom.functions import text as tx
from opsloom.operators.literals import fixed_table
from opsloom.operators.settle import settle


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


# DuckDB text of the tokeniser: a list of lower-case words without stopwords.
def sql_tokens(expr: str) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all(coalesce({expr}, ''), "
        f"'{fv.TOKEN_PATTERN}'), lambda w: lower(w)), "
        f"lambda w: NOT list_contains({sql_list(fv.STOPWORDS)}, w))"
    )


# RE2 has no Unicode white space class; the escapes spell it out.
SQL_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_clean(expr: str) -> str:
    return (
        f"regexp_replace(regexp_replace(coalesce({expr}, ''), '{SQL_WS}+', ' ', 'g'), "
        f"'^ | $', '', 'g')"
    )


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"


def sql_form(expr: str) -> str:
    return sql_clean(f"lower(strip_accents({expr}))")


@query("text_normalise", f"""
SELECT doc_id, {sql_clean('text')} AS cleaned, {sql_form('text')} AS match_form,
       CASE WHEN length({sql_strip('text')}) > 160
            THEN substr({sql_strip('text')}, 1, 157) || '...' ELSE {sql_strip('text')} END AS preview,
       coalesce(nullif(trim(source), ''), 'unknown') AS source_name,
       (SELECT count(*) FROM unnest(string_split(text, chr(10))) AS u(s)
        WHERE {sql_clean('s')} <> '')::BIGINT AS n_lines,
       sha256(text) AS content_hash,
       greatest(1, length(text) // 4)::BIGINT AS token_estimate
FROM documents
""")
def text_normalise(t: Tables):
    body = F.col("text")
    return t.documents.select(
        "doc_id",
        tx.clean(body).alias("cleaned"),
        tx.match_form(body).alias("match_form"),
        tx.preview(body).alias("preview"),
        tx.default_blank(F.col("source"), "unknown").alias("source_name"),
        F.size(tx.visible_lines(body)).cast("long").alias("n_lines"),
        tx.content_hash(body).alias("content_hash"),
        tx.token_estimate(body).cast("long").alias("token_estimate"),
    )


_KEYS = ("in", "of", "die", "que", "stat", "ré", "le la")


@query("text_keywords", f"""
WITH lines AS (
  SELECT conv_id, turn, text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
         lambda s: substr({sql_clean('s')}, 1, 200)), lambda s: s <> '') AS v
  FROM conversations),
forms AS (SELECT *, list_transform(v, lambda s: {sql_form('s')}) AS f,
  {sql_form('text')} AS whole FROM lines)
SELECT conv_id, turn,
  array_to_string(list_filter({sql_list(_KEYS)}, lambda k:
     len(list_filter(f, lambda s: contains(s, strip_accents(k)))) > 0)[1:8], '|') AS hits,
  rtrim(coalesce(list_filter(v, lambda s: contains({sql_form('s')}, 'die')
     OR contains({sql_form('s')}, 'que'))[1], '')) AS first_match,
  rtrim(coalesce(list_filter(v, lambda s: length(rtrim(s)) >= 30)[1], '')) AS first_long,
  (contains(whole, 'stat') OR contains(whole, 're'))::INT AS any_hit,
  len(list_filter(f, lambda s: s = '' OR {' OR '.join(
      f"contains(s, '{tx.match_key(k)}')" for k in fv.QUESTION_NOISE)}
      OR regexp_matches(s, '^\\d+\\s*/\\s*\\d+')))::BIGINT AS n_noise,
  rtrim(coalesce(list_filter(v, lambda s: {' OR '.join(
      f"contains({sql_form('s')}, '{tx.match_key(k)}')" for k in fv.QUESTION_TIME)}
      OR regexp_matches(s, '\\b\\d{{1,2}}:\\d{{2}}\\b')
      OR regexp_matches(s, '\\b\\d{{1,2}}[/-]\\d{{1,2}}([/-]\\d{{2,4}})?\\b'))[1], '')) AS time_hint
FROM forms
""")
def text_keywords(t: Tables):
    lines = tx.visible_lines(F.col("text"))
    return settle(t.conversations, {"v": lines}).select(
        "conv_id", "turn",
        F.array_join(tx.keyword_hits(F.col("v"), _KEYS), "|").alias("hits"),
        tx.first_text_match(F.col("v"), ("die", "que")).alias("first_match"),
        tx.first_long_text(F.col("v"), 30).alias("first_long"),
        tx.item_matches([F.col("text")], ("stat", "ré")).cast("int").alias("any_hit"),
        F.size(F.filter("v", tx.is_noise_line)).cast("long").alias("n_noise"),
        tx.first_time_hint(F.col("v")).alias("time_hint"),
    )


_PHRASES = ("sap", "sap b1", "erp", "excel", "whatsapp", "email", "portal", "browser", "desktop", "api")


@query("known_systems", f"""
WITH base AS (SELECT p_partkey,
  p_name || CASE p_size % 5 WHEN 0 THEN ' in SAP B1' WHEN 1 THEN ' via e-mail, Excel'
    WHEN 2 THEN ' ERP/api' WHEN 3 THEN ' sap_b1 browsers' ELSE '' END AS body FROM part)
SELECT p_partkey, array_to_string(list_filter({sql_list(_PHRASES)},
   lambda k: regexp_matches(lower(body), '\\b' || k || '\\b')), '|') AS systems,
   len(list_intersect(string_split(lower(body), ' '), ['excel', 'in', 'via']))::BIGINT AS n_common
FROM base
""")
def known_systems(t: Tables):
    suffix = (
        F.when(F.col("p_size") % 5 == 0, " in SAP B1").when(F.col("p_size") % 5 == 1, " via e-mail, Excel")
        .when(F.col("p_size") % 5 == 2, " ERP/api").when(F.col("p_size") % 5 == 3, " sap_b1 browsers")
        .otherwise("")
    )
    body = F.concat("p_name", suffix)
    words = F.split(F.lower(body), " ")
    return t.part.select(
        "p_partkey",
        F.array_join(tx.known_systems(body), "|").alias("systems"),
        F.size(F.array_intersect(words, F.array(F.lit("excel"), F.lit("in"), F.lit("via"))))
        .cast("long").alias("n_common"),
    )


@query("url_parts", """
SELECT page_id, coalesce(nullif(ltrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), ''),
  'unknown') AS database_name,
  coalesce(nullif(trim(regexp_extract(url, '[?&]ref=([^&#]*)', 1)), ''), 'none') AS ref_name
FROM pages
""")
def url_parts(t: Tables):
    return t.pages.select(
        "page_id", tx.database_name(F.col("url")).alias("database_name"),
        tx.default_blank(F.regexp_extract("url", r"[?&]ref=([^&#]*)", 1), "none").alias("ref_name"),
    )


@query("score_bands", f"""
WITH s AS (SELECT doc_id, 40 * quality + 30 * (1 - toxic) + doc_id % 31 AS score FROM labels)
SELECT doc_id, score::BIGINT AS score, CASE WHEN score >= 80 THEN '{fv.SCORE_BANDS[0][1]}'
  WHEN score >= 50 THEN '{fv.SCORE_BANDS[1][1]}' WHEN score IS NOT NULL THEN '{fv.SCORE_BANDS[2][1]}' END AS band,
  round_even(score / 7.0, 4) AS score4
FROM s
""")
def score_bands(t: Tables):
    score = 40 * F.col("quality") + 30 * (1 - F.col("toxic")) + F.col("doc_id") % 31
    return t.labels.select(
        "doc_id", score.cast("long").alias("score"), tx.score_band(score).alias("band"),
        F.bround(score.cast("double") / F.lit(7.0), 4).alias("score4"),
    )


@query("date_defaults", """
SELECT o_orderkey, strftime(CASE WHEN o_orderstatus = 'P' THEN NULL
    ELSE date_trunc('day', o_orderdate) + INTERVAL 12 HOUR END, '%Y-%m-%dT%H:%M:%S') AS noon,
  coalesce(strftime(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END, '%d/%m/%Y'),
    'Sin fecha') AS shown_date,
  date_diff('second', TIMESTAMP '1995-01-01 00:00:00', o_orderdate)::BIGINT AS seconds_since
FROM orders
""")
def date_defaults(t: Tables):
    known = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    day = F.date_format(known, "yyyy-MM-dd")
    return t.orders.select(
        "o_orderkey",
        F.date_format(tx.noon_utc(day), "yyyy-MM-dd'T'HH:mm:ss").alias("noon"),
        F.coalesce(F.date_format(known, "dd/MM/yyyy"), F.lit("Sin fecha")).alias("shown_date"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1995-01-01 00:00:00', o_orderdate)")
        .cast("long").alias("seconds_since"),
    )


_RECORDS = """
SELECT event_id, CASE CAST(event_id % 4 AS INT)
  WHEN 0 THEN '{"version":"1","feasibility":"high","automation_mode":"assisted","channels":["web"],"systems":[],"props":' || props || '}'
  WHEN 1 THEN '{"version":1,"feasibility":"high","automation_mode":"assisted","channels":["web"],"systems":[]}'
  WHEN 2 THEN '{"version":"1","feasibility":"low","automation_mode":"x","channels":"web","systems":[]}'
  ELSE props END AS record FROM {events}
"""


def _records(t: Tables):
    return t.spark.sql(_RECORDS.replace("{events}", "{src}").replace("'{\"", "'{{\"").replace("}'", "}}'"),
                       src=t.events)


@query("record_validity", "WITH r AS (" + _RECORDS.replace("{events}", "events") + """)
SELECT event_id, CASE WHEN coalesce(json_type(record, '$.version') = 'VARCHAR'
   AND json_type(record, '$.feasibility') = 'VARCHAR' AND json_type(record, '$.automation_mode') = 'VARCHAR'
   AND json_type(record, '$.channels') = 'ARRAY' AND json_type(record, '$.systems') = 'ARRAY', false)
   THEN 'valid' ELSE 'quarantine' END AS state FROM r
""")
def record_validity(t: Tables):
    return _records(t).select(
        "event_id",
        F.when(jsonx.record_is_valid(F.col("record")), "valid").otherwise("quarantine").alias("state"),
    )


@query("json_shape", """
WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '[' || props || ']' WHEN event_id % 3 = 1 THEN props
   ELSE '"text"' END AS j FROM events)
SELECT event_id, CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'string' END AS shape,
  CASE WHEN json_type(j) = 'OBJECT' THEN j ELSE '{}' END AS as_object,
  CASE WHEN json_type(j) = 'ARRAY' THEN j ELSE '[]' END AS as_list FROM r
""")
def json_shape(t: Tables):
    j = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), "props", F.lit("]")))
        .when(F.col("event_id") % 3 == 1, F.col("props")).otherwise('"text"')
    )
    return t.events.select(
        "event_id", jsonx.json_shape(j).alias("shape"), jsonx.object_or_empty(j).alias("as_object"),
        jsonx.list_or_empty(j).alias("as_list"),
    )


@query("json_merge", """
SELECT event_id, CASE WHEN event_id % 5 = 0
   THEN '{"k": "' || json_extract_string(props, '$.k') || '", "t": "' || event_type || '"}'
   ELSE '{"k": "' || event_type || '", "t": "' || event_type || '", "u": "' || user_id || '"}' END AS merged
FROM events
""")
def json_merge(t: Tables):
    left = F.map_from_arrays(F.array(F.lit("t"), F.lit("k")),
                             F.array("event_type", F.get_json_object("props", "$.k")))
    right = F.when(
        F.col("event_id") % 5 != 0,
        F.map_from_arrays(F.array(F.lit("k"), F.lit("u")),
                          F.array("event_type", F.col("user_id").cast("string"))),
    )
    merged = jsonx.merge_maps(left, right)
    return t.events.select(
        "event_id",
        jsonx.stable_json(merged, T.MapType(T.StringType(), T.StringType())).alias("merged"),
    )


@query("json_secret_scan", """
SELECT event_type, count(*)::BIGINT AS n_rows,
  count(*) FILTER (WHERE regexp_matches(CASE WHEN value > 100 THEN replace(props, 'k', 'Api_Key') ELSE props END,
    '(?i)password|passwd|token|api_key|apikey|secret|private_key|credential'))::BIGINT AS n_suspicious
FROM events GROUP BY event_type
""")
def json_secret_scan(t: Tables):
    meta = F.when(F.col("value") > 100, F.replace(F.col("props"), F.lit("k"), F.lit("Api_Key"))).otherwise(
        F.col("props"))
    return t.events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(jsonx.holds_secret_key(meta)).alias("n_suspicious"),
    )


@query("model_reply_parse", """
WITH r AS (SELECT event_id, event_id % 4 AS k, props FROM events)
SELECT event_id, CASE k WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN '{"a": {"b": ' || props || '}}' END AS object,
 CASE WHEN k = 3 THEN 'no object here' END AS rejected FROM r
""")
def model_reply_parse(t: Tables):
    kind = F.col("event_id") % 4
    reply = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("Sure: "), "props", F.lit(" and {more}")))
        .when(kind == 2, F.concat(F.lit('{"a": {"b": '), "props", F.lit("}} tail")))
        .otherwise("no object here")
    )
    parsed = t.events.select("event_id", reply.alias("reply")).withColumn(
        "object", jsonx.first_json_object("reply"))
    return parsed.select(
        "event_id", "object",
        F.when(F.col("object").isNull(), F.col("reply")).alias("rejected"),
    )


@query("vector_text_roundtrip")
def vector_text_roundtrip(t: Tables):
    from opsloom.functions import vectors as vx

    text = vx.to_literal(F.col("embedding"))
    back = t.embeddings.select("vec_id", "embedding", text.alias("vector_text")).withColumn(
        "back", vx.from_literal(F.col("vector_text")))
    gap = F.aggregate(F.zip_with("embedding", "back", lambda a, b: F.abs(a - b)), F.lit(0.0).cast("float"),
                      lambda acc, x: F.greatest(acc, x))
    return back.select("vec_id", "vector_text", (gap < 1e-6).alias("same"))


# Labels and templated phrases ----------------------------------------------


def label_rows() -> list[tuple[str, str, str, str]]:
    return [(domain, key, locale, text) for domain, keys in fv.LABELS.items()
            for key, texts in keys.items() for locale, text in zip(fv.LOCALES, texts)]


def sql_values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


@query("label_lookup", """
SELECT doc_id, CASE lang WHEN 'en' THEN CASE doc_id % 6 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low'
    WHEN 3 THEN 'Needs validation' WHEN 4 THEN 'Not recommended' ELSE 'other' END
  WHEN 'de' THEN CASE doc_id % 6 WHEN 0 THEN 'גבוהה' WHEN 1 THEN 'בינונית' WHEN 2 THEN 'נמוכה'
    WHEN 3 THEN 'דרוש אימות' WHEN 4 THEN 'לא מומלץ' ELSE 'other' END
  ELSE CASE doc_id % 6 WHEN 0 THEN 'Alta' WHEN 1 THEN 'Media' WHEN 2 THEN 'Baja'
    WHEN 3 THEN 'Requiere validación' WHEN 4 THEN 'No recomendada' ELSE 'other' END END AS label FROM documents
""")
def label_lookup(t: Tables):
    from opsloom.plans.labels import with_label

    n = F.col("doc_id") % 6
    key = (F.when(n == 0, "high").when(n == 1, "medium").when(n == 2, "low")
           .when(n == 3, "needs_validation").when(n == 4, "not_recommended").otherwise("other"))
    locale = F.when(F.col("lang") == "en", "en").when(F.col("lang") == "de", "he").otherwise(F.col("lang"))
    docs = t.documents.select("doc_id", key.alias("key"), locale.alias("locale"))
    labels = fixed_table(t.spark, ["domain", "key", "locale", "label"], label_rows())
    return with_label(docs, labels, "feasibility").select("doc_id", "label")


_STEPS = """
SELECT o_orderkey AS id, CASE CAST(o_orderkey % 4 AS INT)
  WHEN 0 THEN 'receive inquiries from whatsapp and ' || CASE WHEN o_custkey % 2 = 0 THEN 'email' ELSE 'fax' END
  WHEN 1 THEN 'retrieve ' || CASE WHEN o_custkey % 2 = 0 THEN 'prices' ELSE 'stock list' END || ' from crm'
  WHEN 2 THEN 'confirm spreadsheet integration method for orders'
  ELSE 'validate erp and crm access, then design the web response flow' ||
    CASE WHEN o_custkey % 2 = 0 THEN ' with approval rules' ELSE '' END END AS phrase,
  CASE o_orderstatus WHEN 'F' THEN 'en' ELSE 'es' END AS locale
FROM {orders}
"""


@query("phrase_translate", "WITH s AS (" + _STEPS.replace("{orders}", "orders") + """)
SELECT id, CASE
 WHEN phrase LIKE 'receive%' THEN CASE locale WHEN 'en' THEN
    'receive inquiries from WhatsApp and ' || CASE WHEN phrase LIKE '%email' THEN 'Email' ELSE 'fax' END
    ELSE 'recibir consultas desde WhatsApp y ' || CASE WHEN phrase LIKE '%email' THEN 'Email' ELSE 'fax' END END
 WHEN phrase LIKE 'retrieve%' THEN CASE locale WHEN 'en' THEN
    'retrieve ' || CASE WHEN phrase LIKE '%prices%' THEN 'Prices' ELSE 'stock list' END || ' from CRM'
    ELSE 'consultar ' || CASE WHEN phrase LIKE '%prices%' THEN 'Precios' ELSE 'stock list' END || ' desde CRM' END
 WHEN phrase LIKE 'confirm%' THEN CASE locale WHEN 'en' THEN 'confirm Spreadsheet integration method for Orders'
    ELSE 'confirmar método de integración de Planilla para Pedidos' END
 ELSE CASE locale WHEN 'en' THEN 'validate ERP and CRM access, then design the Website response flow' ||
      CASE WHEN phrase LIKE '%rules' THEN ' with approval rules' ELSE '' END
    ELSE 'validar acceso a ERP y CRM y luego diseñar el flujo de respuesta para Sitio web' ||
      CASE WHEN phrase LIKE '%rules' THEN ' con reglas de aprobación' ELSE '' END END END AS shown
FROM s
""")
def phrase_translate(t: Tables):
    from opsloom.plans.labels import translate_phrase

    rows = t.derive(_STEPS)
    return rows.select("id", translate_phrase(F.col("phrase"), F.col("locale")).alias("shown"))


@query("kpi_source", f"""
WITH k AS (SELECT p_partkey, p_type AS area, CASE p_partkey % 7 WHEN 0 THEN 'Ranking de Fuentes de Leads'
  WHEN 1 THEN 'CTR ' || p_name WHEN 2 THEN 'Conversión General' WHEN 3 THEN 'Visitas Realizadas'
  WHEN 4 THEN 'Valor m2' WHEN 5 THEN 'Facturación Total' ELSE p_name END AS kpi FROM part),
x AS (SELECT p_partkey, lower(area || ' ' || kpi) AS s FROM k)
SELECT p_partkey, CASE {' '.join("WHEN " + ' OR '.join(f"contains(s, '{w}')" for w in words)
    + f" THEN '{source}'" for words, source in fv.KPI_SOURCE_RULES)} ELSE '{fv.KPI_SOURCE_DEFAULT}' END AS source
FROM x
""")
def kpi_source(t: Tables):
    n = F.col("p_partkey") % 7
    kpi = (
        F.when(n == 0, "Ranking de Fuentes de Leads").when(n == 1, F.concat(F.lit("CTR "), "p_name"))
        .when(n == 2, "Conversión General").when(n == 3, "Visitas Realizadas").when(n == 4, "Valor m2")
        .when(n == 5, "Facturación Total").otherwise(F.col("p_name"))
    )
    return t.part.select("p_partkey", tx.kpi_source(kpi, F.col("p_type")).alias("source"))
