"""Queries over search, chunking and retrieval telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom import fixed_values as fv
from opsloom.catalogue.registry import Tables, plain, query
from opsloom.catalogue.text import sql_list, sql_strip, sql_tokens
from opsloom.functions import chunking as ch
from opsloom.functions import text as tx
from opsloom.functions.vectors import cosine_distance
from opsloom.operators import topk
from opsloom.operators.fusion import Ranked, fused_top_k
from opsloom.operators.literals import fixed_table
from opsloom.plans import retrieval as rt
from opsloom.plans.search_sql import register_search
from opsloom.session import new_scratch

QUERY = "the shall of thin die que ist of in une"
AND_QUERY = "of the is a"
_QT = tx.query_tokens(QUERY)
_AND = sorted(set(tx.query_tokens(AND_QUERY)))


@query("keyword_topk", f"""
WITH tok AS (SELECT doc_id, unnest({sql_tokens("source || ' ' || text")}) AS token FROM documents),
q AS (SELECT unnest({sql_list(_QT)}) AS token),
s AS (SELECT doc_id, count(*) / {len(_QT)}.0 AS s FROM tok JOIN q USING (token) GROUP BY doc_id)
SELECT doc_id, round_even(s, 4)::DOUBLE AS score, row_number() OVER (ORDER BY s DESC, doc_id) AS rank_position
FROM s ORDER BY s DESC, doc_id LIMIT 5
""")
def keyword_topk(t: Tables):
    docs = t.documents.select("doc_id", "source", "text")
    best = rt.keyword_top_k(docs, QUERY, ["source", "text"], ["doc_id"])
    return best.select("doc_id", "score", F.col("rank_position").cast("long").alias("rank_position"))


def _batch(t: Tables, k: int = 5):
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return rt.keyword_top_k_batch(t.documents, queries, "doc_id", "text", k)


_BATCH_SQL = f"""
tok AS (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM documents),
tf AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY ALL),
qt AS (SELECT item_id, unnest({sql_tokens('text')}) AS token FROM benchmark),
qf AS (SELECT item_id, token, count(*) AS qtf FROM qt GROUP BY ALL),
qn AS (SELECT item_id, count(*) AS nq FROM qt GROUP BY ALL),
sc AS (SELECT item_id, doc_id, sum(tf * qtf)::DOUBLE / any_value(nq) AS s
  FROM qf JOIN tf USING (token) JOIN qn USING (item_id) GROUP BY item_id, doc_id),
rk AS (SELECT item_id AS query_id, doc_id AS chunk_id, round_even(s, 4)::DOUBLE AS score,
  row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank_position FROM sc)
"""


@query("keyword_topk_batch", f"WITH {_BATCH_SQL} SELECT * FROM rk WHERE rank_position <= 5")
def keyword_topk_batch(t: Tables):
    return _batch(t).withColumn("rank_position", F.col("rank_position").cast("long"))


@query("lexical_and_match", f"""
SELECT doc_id, lang FROM documents
WHERE len(list_intersect({sql_tokens('text')}, {sql_list(_AND)})) = {len(_AND)}
""")
def lexical_and_match(t: Tables):
    return t.documents.where(rt.matches_all(F.col("text"), AND_QUERY)).select("doc_id", "lang")


# A cover runs from one query word to another, holds every word, and neither end
# can be dropped. Brute force over positions.
_COVER_SQL = f"""
WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{fv.TOKEN_PATTERN}'), lambda x: lower(x)) AS words
  FROM documents),
h AS (SELECT doc_id, p, words[p] AS token FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w)
  WHERE words[p] IN ({', '.join(repr(x) for x in _AND)})),
last AS (SELECT doc_id, p, token, {', '.join(
    f"max(CASE WHEN token = '{x}' THEN p END) OVER o AS l{i}, "
    f"max(CASE WHEN token = '{x}' THEN p END) OVER b AS b{i}" for i, x in enumerate(_AND))},
  row_number() OVER (PARTITION BY doc_id ORDER BY p) AS n
  FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  b AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT doc_id, p, n, least({', '.join(f'l{i}' for i in range(len(_AND)))}) AS q,
  CASE token {' '.join(f"WHEN '{x}' THEN b{i}" for i, x in enumerate(_AND))} END AS prev
  FROM last WHERE {' AND '.join(f'l{i} IS NOT NULL' for i in range(len(_AND)))}),
m AS (SELECT c.*, s.n AS n0 FROM c JOIN last s ON s.doc_id = c.doc_id AND s.p = c.q
  WHERE coalesce(prev, -1) < q),
sc AS (SELECT doc_id, sum(0.1::DOUBLE / (1 + (p - q) - (n - n0))) AS s FROM m GROUP BY doc_id)
SELECT doc_id, round(s, 4) AS lexical_score, row_number() OVER (ORDER BY s::FLOAT DESC, doc_id DESC) AS rank_position
FROM sc ORDER BY s::FLOAT DESC, doc_id DESC LIMIT 8
"""


@query("lexical_cover_topk", _COVER_SQL)
def lexical_cover_topk(t: Tables):
    best = rt.lexical_top_k(t.documents.select("doc_id", "text"), AND_QUERY, "text", "doc_id")
    return best.select(
        "doc_id", F.round(F.col("lexical_score").cast("double"), 4).alias("lexical_score"),
        F.col("rank_position").cast("long").alias("rank_position"),
    )


def _searchable(t: Tables) -> None:
    """The chunks as a view with the search functions over it."""
    joined = t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id"), "left")
    joined.selectExpr("doc_id AS chunk_id", "text AS body", "embedding", "source AS project", "lang AS channel").createOrReplaceTempView("catalog_chunks")
    register_search(t.spark, "catalog_chunks")


@query("sql_lexical_search", "SELECT *, 'both' AS filters FROM (" + _COVER_SQL.replace("FROM documents)", "FROM documents WHERE source = 'src1' AND lang = 'en')", 1)
       + ") UNION ALL SELECT *, 'none' FROM (" + _COVER_SQL.replace("LIMIT 8", "LIMIT 3") + ")")
def sql_lexical_search(t: Tables):
    """Full-text search as SQL users call it: default k with both filters, and k of 3 without."""
    _searchable(t)
    out = t.spark.sql(f"""SELECT *, 'both' AS filters FROM lexical_search('{AND_QUERY}', project => 'src1', channel => 'en')
        UNION ALL SELECT *, 'none' FROM lexical_search('{AND_QUERY}', 3)""")
    return out.select(F.col("chunk_id").alias("doc_id"), F.round(F.col("score").cast("double"), 4).alias("lexical_score"),
                      F.col("rank_position").cast("long").alias("rank_position"), "filters")


@query("sql_semantic_search", """
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3),
d AS (SELECT vec_id AS chunk_id, source, list_cosine_distance(embedding::DOUBLE[], v) AS d FROM embeddings JOIN documents ON doc_id = vec_id, q),
r AS (SELECT 'project' AS filters, chunk_id, d, row_number() OVER (ORDER BY d, chunk_id DESC) AS rank_position FROM d WHERE source = 'src2'
 UNION ALL SELECT 'none', chunk_id, d, row_number() OVER (ORDER BY d, chunk_id DESC) FROM d)
SELECT filters, chunk_id, round(d, 6) + 0.0 AS cosine_distance, rank_position FROM r WHERE rank_position <= 8
""")
def sql_semantic_search(t: Tables):
    _searchable(t)
    vector = t.embeddings.where("vec_id = 3").select("embedding").first()[0]
    given = "array(" + ", ".join(f"{x!r}D" for x in vector) + ")"
    out = t.spark.sql(f"""SELECT 'project' AS filters, * FROM semantic_search({given}, project => 'src2')
        UNION ALL SELECT 'none', * FROM semantic_search({given}, k => 0)""")
    return out.select("filters", "chunk_id", (F.round("distance", 6) + 0.0).alias("cosine_distance"),
                      F.col("rank_position").cast("long").alias("rank_position"))


def _vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _label_search(t: Tables, k: int):
    vectors = _vectors(t)
    queries = topk.centroids(vectors, "label").withColumnRenamed("label", "query_id")
    return topk.vector_top_k(vectors, queries, k)


_VEC_SQL = """
flat AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
mean AS (SELECT label, pos, avg(x) AS m FROM flat GROUP BY ALL),
cent AS (SELECT label, list(m ORDER BY pos) AS c FROM mean GROUP BY label),
dist AS (SELECT cent.label AS query_id, vec_id AS id,
  list_cosine_distance(c, list_transform(embedding, lambda x: x::DOUBLE)) AS d FROM cent, embeddings),
vr AS (SELECT query_id, id, round(d, 6) AS cosine_distance,
  row_number() OVER (PARTITION BY query_id ORDER BY d, id DESC) AS rank_position FROM dist)
"""


@query("vector_topk", f"WITH {_VEC_SQL} SELECT query_id::BIGINT AS query_id, id, cosine_distance, rank_position FROM vr WHERE rank_position <= 8")
def vector_topk(t: Tables):
    return _label_search(t, 8).select(
        "query_id", "id", F.round("cosine_distance", 6).alias("cosine_distance"),
        F.col("rank_position").cast("long").alias("rank_position"),
    )


@query("hybrid_rrf", f"""
WITH tok AS (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM documents),
q AS (SELECT unnest({sql_list(_QT)}) AS token),
s AS (SELECT doc_id, count(*) / {len(_QT)}.0 AS s FROM tok JOIN q USING (token) GROUP BY doc_id),
k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY s DESC, doc_id) AS kr FROM s),
{_VEC_SQL.replace("SELECT label, unnest(range", "SELECT 0 AS label, unnest(range")},
f AS (SELECT id, kr, rank_position AS vrank FROM k FULL JOIN (SELECT id, rank_position FROM vr) USING (id)),
z AS (SELECT id, coalesce(1.0::DOUBLE / (60 + kr), 0) + coalesce(1.0::DOUBLE / (60 + vrank), 0) AS score FROM f)
SELECT id, round(score, 6) AS score_final, row_number() OVER (ORDER BY score DESC, id) AS rank_position
FROM z ORDER BY score DESC, id LIMIT 20
""")
def hybrid_rrf(t: Tables):
    words = t.documents.select(F.col("doc_id").alias("id"), rt.keyword_score(F.col("text"), QUERY).alias("score")).where("score > 0")
    vectors = _vectors(t)
    centre = topk.centroids(vectors.withColumn("query_id", F.lit(0)), "query_id").first()["vec"]
    near = vectors.where("vec IS NOT NULL").select("id", (-cosine_distance(F.col("vec"), F.array(*[F.lit(x) for x in centre]))).alias("score"))
    best = fused_top_k([Ranked(words), Ranked(near, falling_ids=True)], 20)
    return best.select("id", F.round("score_final", 6).alias("score_final"),
                       F.col("rank_position").cast("long").alias("rank_position"))


def chunk_sql(bodies: str) -> str:
    """CTEs that end in ``chunks`` (doc_id, chunk_index, chunk_text) of a table with doc_id and text."""
    return f"""
lines AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM
  (SELECT doc_id, i, {sql_strip('s')} AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {bodies})) WHERE p <> ''),
fold AS (
  SELECT doc_id, n, p AS cur, 0 AS done, NULL::VARCHAR AS flushed FROM lines WHERE n = 1
  UNION ALL
  SELECT l.doc_id, l.n,
    CASE WHEN length(f.cur || chr(10) || l.p) <= 900 THEN f.cur || chr(10) || l.p
         ELSE {sql_strip("right(f.cur, 120) || chr(10) || l.p")} END,
    f.done + CASE WHEN length(f.cur || chr(10) || l.p) <= 900 THEN 0 ELSE 1 END,
    CASE WHEN length(f.cur || chr(10) || l.p) <= 900 THEN NULL ELSE f.cur END
  FROM fold f JOIN lines l ON l.doc_id = f.doc_id AND l.n = f.n + 1),
chunks AS (SELECT doc_id, done - 1 AS chunk_index, flushed AS chunk_text FROM fold WHERE flushed IS NOT NULL
  UNION ALL SELECT doc_id, done, cur FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS r FROM fold)
    WHERE r = 1)"""


@query("chunk_overlap", f"""
WITH RECURSIVE {chunk_sql("documents")}
SELECT doc_id, chunk_index::BIGINT AS chunk_index, length(chunk_text)::BIGINT AS n_chars, sha256(chunk_text) AS content_hash,
  greatest(1, length(chunk_text) // 4)::BIGINT AS token_estimate, 'semantic' AS chunk_kind FROM chunks
""")
def chunk_overlap(t: Tables):
    cut = t.documents.select(
        "doc_id", F.posexplode(ch.line_chunks(F.col("text"))).alias("chunk_index", "chunk_text"))
    c = F.col("chunk_text")
    return cut.select(
        "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"),
        F.length(c).cast("long").alias("n_chars"), tx.content_hash(c).alias("content_hash"),
        tx.token_estimate(c).cast("long").alias("token_estimate"), F.lit("semantic").alias("chunk_kind"))


# Documents carry no headings: every third line becomes one before the split.
@query("chunk_markdown")
def chunk_markdown(t: Tables):
    lines = F.split("text", "\n")
    headed = F.array_join(
        F.transform(lines, lambda s, i: F.when(i % 3 == 0, F.concat(F.lit("## "), s))
                    .otherwise(F.concat(s, F.lit("\n")))), "\n")
    cut = t.documents.select(
        "doc_id", F.posexplode(ch.knowledge_chunks(headed)).alias("ordinal", "c"))
    return cut.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "c.title", "c.content")


@query("context_prompt", f"""
WITH {_BATCH_SQL},
b AS (SELECT query_id, rank_position, '[' || rank_position || '] ' || source || chr(10) || text AS block
  FROM rk JOIN documents ON doc_id = chunk_id WHERE rank_position <= 5)
SELECT query_id, sha256(string_agg(block, chr(10) || chr(10) ORDER BY rank_position)) AS prompt_hash FROM b GROUP BY query_id
""")
def context_prompt(t: Tables):
    best = _batch(t)
    texts = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"),
                               F.col("text").alias("content"))
    listed = best.join(texts, "chunk_id").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank_position", "title", "content"))).alias("c"))
    return listed.select("query_id", tx.content_hash(tx.numbered_prompt(F.col("c"))).alias("prompt_hash"))


@query("scope_counts", f"""
WITH d AS (SELECT source AS scope, count(*)::BIGINT AS document_count FROM documents GROUP BY source),
c AS (SELECT source AS scope, sum(len(list_filter(string_split(text, chr(10)), lambda s: {sql_strip('s')} <> '')))::BIGINT AS chunk_count
  FROM documents GROUP BY source)
SELECT scope, document_count, coalesce(chunk_count, 0)::BIGINT AS chunk_count FROM d LEFT JOIN c USING (scope)
""")
def scope_counts(t: Tables):
    docs = t.documents.groupBy(F.col("source").alias("scope")).agg(F.count(F.lit(1)).alias("document_count"))
    pieces = F.filter(F.split("text", "\n"), lambda s: tx.strip(s) != "")
    chunks = t.documents.groupBy(F.col("source").alias("scope")).agg(
        F.sum(F.size(pieces)).alias("chunk_count"))
    return docs.join(chunks, "scope", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


# Catalog joins and filters ---------------------------------------------------


def _catalog(t: Tables):
    sources = t.documents.select(
        F.col("doc_id").alias("source_id"), F.col("source").alias("source_project_code"),
        F.col("lang").alias("target_channel"), F.substring("text", 1, 30).alias("title"))
    chunks = t.embeddings.select(
        F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("source_id"), "label", "embedding")
    return chunks, sources


@query("catalog_join", """
SELECT vec_id AS chunk_id, source AS source_project_code, lang AS target_channel, label::BIGINT AS label
FROM embeddings JOIN documents ON doc_id = vec_id
""")
def catalog_join(t: Tables):
    chunks, sources = _catalog(t)
    return chunks.join(sources, "source_id").select(
        "chunk_id", "source_project_code", "target_channel", F.col("label").cast("long").alias("label"))


@query("optional_filter", """
SELECT 'both' AS variant, doc_id FROM documents WHERE source = 'src3' AND lang = 'en'
UNION ALL SELECT 'project', doc_id FROM documents WHERE source = 'src3'
UNION ALL SELECT 'channel', doc_id FROM documents WHERE lang = 'en'
UNION ALL SELECT 'none', doc_id FROM documents
""")
def optional_filter(t: Tables):
    out = None
    for name, project, channel in (("both", "src3", "en"), ("project", "src3", None),
                                   ("channel", None, "en"), ("none", None, None)):
        part = rt.optional_filters(t.documents, source=project, lang=channel).select(
            F.lit(name).alias("variant"), "doc_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("scope_filter", """
SELECT 'rag' AS mode, doc_id FROM documents WHERE source = 'src1'
UNION ALL SELECT 'blank', doc_id FROM documents WHERE source = 'src2'
""")
def scope_filter(t: Tables):
    parts = [
        rt.in_scope(t.documents, scope, mode, "source").select(F.lit(name).alias("mode"), "doc_id")
        for name, scope, mode in (("rag", "src1", "rag"), ("blank", "src2", ""), ("none", "src3", "none"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_EMB = """
SELECT vec_id AS embedding_id, vec_id AS chunk_id, CASE WHEN vec_id % 11 = 0 THEN 'src0' ELSE source END AS scope_id,
  CASE CAST(vec_id % 5 AS INT) WHEN 0 THEN 'pending' WHEN 1 THEN 'stale' ELSE 'ready' END AS embedding_status,
  CASE WHEN vec_id % 13 = 0 THEN NULL ELSE embedding END AS embedding, CAST(label % 2 AS INT) AS model_id
FROM {embeddings} JOIN {documents} ON doc_id = vec_id
"""


@query("ready_chunks", "WITH e AS (" + plain(_EMB) + """)
SELECT embedding_id, e.scope_id, doc_id AS document_id, CASE model_id WHEN 0 THEN 'default' ELSE 'small' END AS model_alias
FROM e JOIN labels l ON l.doc_id = e.chunk_id JOIN documents d USING (doc_id)
WHERE embedding_status = 'ready' AND embedding IS NOT NULL AND e.scope_id = d.source
""")
def ready_chunks(t: Tables):
    chunks = t.labels.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"))
    docs = t.documents.select(F.col("doc_id").alias("document_id"), F.col("source").alias("scope_id"))
    models = fixed_table(t.spark, ["model_id", "model_alias"], [(0, "default"), (1, "small")])
    ready = rt.ready_embeddings(t.derive(_EMB), chunks, docs, models)
    return ready.select("embedding_id", "scope_id", "document_id", "model_alias")


# Telemetry -------------------------------------------------------------------

_SEARCHES = """
SELECT item_id AS query_id, 'c' || CAST(item_id % 7 AS STRING) AS conversation_id,
  CASE CAST(item_id % 3 AS INT) WHEN 0 THEN ' ' WHEN 1 THEN 'chat' END AS channel, text AS query_text,
  CASE WHEN item_id % 4 = 3 THEN 'semantic' ELSE 'lexical' END AS retrieval_mode, CAST(item_id % 3 AS INT) AS top_k,
  TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, item_id) AS started_at,
  CAST(NULL AS MAP<STRING, STRING>) AS meta FROM {benchmark}
"""


def _telemetry(t: Tables):
    searches = t.derive(_SEARCHES)
    opened = rt.retrieval_events(searches)
    finished = opened.where("length(query_text) > 150").select(
        "event_id",
        (F.col("started_at") + F.make_dt_interval(secs=(F.col("query_id") % 4 + 1).cast("decimal(18,6)"))).alias("finished_at"),
        F.when(F.col("query_id") % 2 == 0, F.create_map(F.lit("state"), F.lit("ok"))).alias("meta"))
    events = rt.close_events(opened, finished)
    lexical = searches.where("retrieval_mode = 'lexical'").select("query_id")
    hits = rt.retrieval_hits(_batch(t).join(lexical, "query_id", "left_semi"), "lexical")
    return events, hits


_EVENT_SQL = """
ev AS (SELECT item_id, sha256(item_id::VARCHAR) AS event_id, CASE WHEN item_id % 3 = 1 THEN 'chat' ELSE 'web' END AS channel,
  CASE WHEN item_id % 4 = 3 THEN 'semantic' ELSE 'lexical' END AS retrieval_mode, greatest(item_id % 3, 1)::BIGINT AS top_k,
  CASE WHEN length(text) > 150 THEN 1000 * (item_id % 4 + 1) END AS latency,
  CASE WHEN length(text) > 150 AND item_id % 2 = 0 THEN 'ok' END AS state FROM benchmark),
hit AS (SELECT e.event_id, rank_position, chunk_id, score FROM rk JOIN ev e ON e.item_id = query_id
  WHERE rank_position <= 5 AND retrieval_mode = 'lexical')
"""


@query("retrieval_telemetry", f"WITH {_BATCH_SQL}, {_EVENT_SQL}" + """
SELECT event_id, channel, retrieval_mode, top_k, latency::BIGINT AS latency_ms, state, rank_position, chunk_id, score AS score_final
FROM ev LEFT JOIN hit USING (event_id)
""")
def retrieval_telemetry(t: Tables):
    events, hits = _telemetry(t)
    return events.join(hits, "event_id", "left").select(
        "event_id", "channel", "retrieval_mode", F.col("top_k").cast("long").alias("top_k"),
        F.expr("timestampdiff(MILLISECOND, started_at, finished_at)").alias("latency_ms"),
        F.try_element_at("meta", F.lit("state")).alias("state"),
        F.col("rank_position").cast("long").alias("rank_position"), "chunk_id", "score_final")


_EVENT_COLUMNS = ("event_id", "conversation_id", "channel", "retrieval_mode", "top_k", "started_at", "finished_at", "meta")
_HIT_COLUMNS = ("event_id", "rank_position", "chunk_id", "score_cosine", "score_lexical", "score_final")


def _logged(t: Tables):
    """Events, hits and turns as they stand in a log: opened, closed, with hits and turns added, each commit tried twice."""
    folder = new_scratch(t.spark, "telemetry")
    events, hits = _telemetry(t)
    opened = events.withColumn("finished_at", F.lit(None).cast("timestamp_ntz"))
    closed = events.where("finished_at IS NOT NULL")
    turns = rt.ai_turns(t.conversations.select(
        F.col("conv_id").cast("string").alias("conversation_id"), "turn", "role", F.lit(" ").alias("channel"),
        F.sha2(F.col("conv_id").cast("string"), 256).alias("event_id")))
    log = rt.TelemetryLog(t.spark, folder, *[df.select(*c).schema for df, c in (
        (opened, _EVENT_COLUMNS), (hits, _HIT_COLUMNS), (turns, turns.columns))])
    for _ in range(2):
        log.open_events(opened, 0)
        log.add_hits(hits, 0)
        log.close_events(closed, 1)
        log.add_turns(turns.where("role = 'user'"), 0)
        log.add_turns(turns.where("role <> 'user'"), 1)
    return log


@query("telemetry_log", f"WITH {_BATCH_SQL}, {_EVENT_SQL}" + """,
turn AS (SELECT sha256(conv_id::VARCHAR) AS event_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS users FROM conversations GROUP BY 1)
SELECT ev.event_id, channel, top_k, latency::BIGINT AS latency_ms, state, rank_position, chunk_id, score AS score_final,
  coalesce(n, 0)::BIGINT AS turns, coalesce(users, 0)::BIGINT AS user_turns FROM ev LEFT JOIN hit USING (event_id) LEFT JOIN turn USING (event_id)
""")
def telemetry_log(t: Tables):
    """What is read back after events, hits and turns were written."""
    log = _logged(t)
    turns = log.turns.read().groupBy("event_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"))
    return (log.events.read().join(log.hits.read(), "event_id", "left").join(turns, "event_id", "left").select(
        "event_id", "channel", F.col("top_k").cast("long").alias("top_k"),
        F.expr("timestampdiff(MILLISECOND, started_at, finished_at)").alias("latency_ms"),
        F.try_element_at("meta", F.lit("state")).alias("state"), F.col("rank_position").cast("long").alias("rank_position"),
        "chunk_id", "score_final", F.coalesce("turns", F.lit(0)).cast("long").alias("turns"),
        F.coalesce("user_turns", F.lit(0)).cast("long").alias("user_turns")))


@query("retrieval_quality", f"WITH {_BATCH_SQL}, {_EVENT_SQL}" + """,
p AS (SELECT event_id, count(*) AS n, max(score) - min(score) AS spread FROM hit GROUP BY event_id)
SELECT retrieval_mode, count(*)::BIGINT AS events, round(avg(coalesce(n, 0)), 6) AS hits_per_event,
  round(avg(CASE WHEN n IS NULL THEN 1.0 ELSE 0.0 END), 6) AS zero_hit_rate, round(avg(spread), 6) AS score_spread,
  round(avg(latency), 6) AS latency_ms FROM ev LEFT JOIN p USING (event_id) GROUP BY retrieval_mode
""")
def retrieval_quality(t: Tables):
    events, hits = _telemetry(t)
    out = rt.retrieval_quality(events, hits)
    for c in ("hits_per_event", "zero_hit_rate", "score_spread", "latency_ms"):
        out = out.withColumn(c, F.round(F.col(c).cast("double"), 6))
    return out


@query("telemetry_chain", f"WITH {_BATCH_SQL}, {_EVENT_SQL}" + """,
turn AS (SELECT sha256(conv_id::VARCHAR) AS event_id, sha256(conv_id || ':' || turn) AS turn_id, role FROM conversations
  WHERE role = 'assistant')
SELECT ev.event_id, rank_position, chunk_id, source AS source_project_code, turn_id
FROM ev LEFT JOIN hit USING (event_id) LEFT JOIN documents ON doc_id = chunk_id LEFT JOIN turn USING (event_id)
""")
def telemetry_chain(t: Tables):
    events, hits = _telemetry(t)
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_project_code"))
    turns = rt.ai_turns(t.conversations.where("role = 'assistant'").select(
        F.col("conv_id").cast("string").alias("conversation_id"), "turn", F.lit(None).cast("string").alias("channel"),
        F.sha2(F.col("conv_id").cast("string"), 256).alias("event_id"))).select("event_id", "turn_id")
    return rt.telemetry_chain(events.select("event_id"), hits, chunks, turns).select(
        "event_id", F.col("rank_position").cast("long").alias("rank_position"), "chunk_id",
        "source_project_code", "turn_id")
