"""Queries over catalog sync. Parts play the projects, suppliers the
developers, order lines the units, and groups of lines the marketing assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom import fixed_values as fv
from opsloom.catalogue.registry import Tables, plain, query
from opsloom.catalogue.retrieval import chunk_sql
from opsloom.operators import keyed
from opsloom.operators.literals import fixed_table
from opsloom.plans import catalog as ct
from opsloom.session import new_scratch

PROJECTS = """
SELECT p_partkey AS project_id, concat('P', CAST(p_partkey AS STRING)) AS project_code, p_name AS project_name,
  CAST(p_size AS BIGINT) AS developer_id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS project_status,
  concat(p_brand, '  ', p_type) AS project_description FROM {part}
"""
DEVELOPERS = "SELECT s_suppkey AS developer_id, s_name AS developer_name FROM {supplier}"
FACTS = """
SELECT concat('P', CAST(l_partkey AS STRING)) AS project_code, concat('ws', CAST(l_partkey % 5 AS STRING)) AS workspace_id,
  count(*) AS n_lines, count(DISTINCT l_suppkey) AS n_suppliers FROM {lineitem} GROUP BY l_partkey
"""
PROFILES = """
SELECT concat('P', CAST(p_partkey AS STRING)) AS project_code, p_type AS inventory_scope_label,
  CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS inventory_is_complete FROM {part} WHERE p_size > 5
"""
# One asset per project and channel, so a project has at most six of them.
ASSETS = """
SELECT concat(CAST(l_partkey AS STRING), '-', l_returnflag, l_linestatus) AS asset_id, l_partkey AS project_id,
  concat(l_returnflag, l_linestatus) AS channel, concat('Asset ', l_returnflag) AS title,
  concat(CAST(count(*) AS STRING), ' units "new"') AS short_copy, concat(l_linestatus, l_returnflag) AS sort_order
FROM {lineitem} GROUP BY l_partkey, l_returnflag, l_linestatus
"""
UNITS = """
SELECT concat('ws', CAST(l_partkey % 5 AS STRING)) AS workspace_id, concat('P', CAST(l_partkey AS STRING)) AS project_code,
  concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_suppkey AS STRING)) AS unit_id,
  CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE concat('U', CAST(l_linenumber AS STRING)) END AS unit_code,
  l_returnflag AS typology, CAST(CAST(l_quantity AS INT) AS STRING) AS bedrooms,
  CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'USD' END AS currency,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS INT) * 1000 AS STRING) END AS list_price,
  l_linestatus AS availability_status, l_orderkey FROM {lineitem}
"""
UNIT_PROFILES = """
SELECT DISTINCT u.workspace_id, u.project_code, u.unit_id, o_orderpriority AS orientation,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS natural_light
FROM (""" + UNITS + """) u JOIN {orders} ON o_orderkey = l_orderkey
"""
# The rows of UNIT_PROFILES before DISTINCT: orders are met by their number, and names are made afterwards.
UNIT_ORDERS = """
SELECT concat('ws', CAST(l_partkey % 5 AS STRING)) AS workspace_id, concat('P', CAST(l_partkey AS STRING)) AS project_code,
  concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_suppkey AS STRING)) AS unit_id,
  o_orderpriority AS orientation, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS natural_light
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey
"""


def _unit_profiles(t: Tables):
    """The rows of ``UNIT_PROFILES``, dealt out once for DISTINCT and for the join with units."""
    return t.derive(UNIT_ORDERS).repartition(*ct.UNIT_KEYS).distinct()


def _facts(t: Tables):
    return t.derive(FACTS).select(
        "project_code", "workspace_id",
        F.struct("n_suppliers", "n_lines").alias("construction"))


def documents(t: Tables):
    projects = t.derive(PROJECTS).withColumn("project_tags", F.array("project_name", "project_code"))
    return ct.all_documents(
        ct.project_documents(projects, t.derive(DEVELOPERS), _facts(t), t.derive(PROFILES), t.derive(ASSETS), "web"),
        ct.unit_documents(t.derive(UNITS), projects, _unit_profiles(t), "web"),
        ct.campaign_documents(t.derive(ASSETS), projects, _facts(t), "web"),
    )


@query("catalog_documents", f"""
WITH p AS ({plain(PROJECTS)}), d AS ({plain(DEVELOPERS)}), f AS ({plain(FACTS)}), pp AS ({plain(PROFILES)}),
a AS ({plain(ASSETS)}), u AS ({plain(UNITS)}), up AS ({plain(UNIT_PROFILES)}),
al AS (SELECT project_id, '[' || string_agg('{{"channel": "' || channel || '", "short_copy": "' ||
   replace(short_copy, '"', '\\"') || '", "title": "' || title || '"}}', ', ' ORDER BY sort_order) || ']' AS assets FROM a GROUP BY project_id),
x AS (
SELECT 'project' AS source_entity_type, p.project_code AS source_entity_key, f.workspace_id AS source_workspace_id, 'catalog' AS target_entity_type,
  project_name AS title, concat_ws(chr(10), 'Proyecto: ' || project_name, 'Codigo: ' || p.project_code, 'Estado: ' || project_status,
   'Descripcion: ' || regexp_replace(project_description, ' +', ' ', 'g'), 'Tags: ["' || project_name || '", "' || p.project_code || '"]',
   'Desarrolladora: ' || developer_name, 'Construccion: {{"n_lines": ' || n_lines || ', "n_suppliers": ' || n_suppliers || '}}',
   'Inventario: ' || inventory_scope_label, 'Inventario completo: ' || inventory_is_complete, 'Assets marketing: ' || assets) AS body
FROM p LEFT JOIN d USING (developer_id) LEFT JOIN f USING (project_code) LEFT JOIN pp USING (project_code) LEFT JOIN al USING (project_id)
UNION ALL
SELECT 'unit', u.project_code || ':' || u.unit_id, u.workspace_id, 'offer', project_name || ' ' || coalesce(nullif(unit_code, ''), u.unit_id),
  concat_ws(chr(10), 'Unidad: ' || project_name || ' ' || coalesce(nullif(unit_code, ''), u.unit_id), 'Proyecto: ' || u.project_code,
   'Tipologia: ' || typology, 'Dormitorios: ' || bedrooms, 'Precio: ' || nullif(trim(currency || ' ' || coalesce(list_price, '')), ''),
   'Disponibilidad: ' || availability_status, 'Orientacion: ' || orientation, 'Luz natural: ' || natural_light)
FROM u JOIN p USING (project_code) LEFT JOIN up USING (workspace_id, project_code, unit_id)
UNION ALL
SELECT 'marketing_asset', asset_id, f.workspace_id, 'campaign', p.project_code || ' ' || title,
  concat_ws(chr(10), 'Campania marketing: ' || title, 'Proyecto: ' || p.project_code, 'Canal origen: ' || channel, 'Copy: ' || short_copy)
FROM a JOIN p USING (project_id) LEFT JOIN f USING (project_code))
SELECT source_entity_type, source_entity_key, source_workspace_id, target_entity_type, title, sha256(body) AS content_hash,
  length(body)::BIGINT AS n_chars FROM x
""")
def catalog_documents(t: Tables):
    return documents(t).select(
        "source_entity_type", "source_entity_key", "source_workspace_id", "target_entity_type", "title",
        "content_hash", F.length("body_text").cast("long").alias("n_chars"))


# Two versions of a source table: the second drops some rows, alters others, adds new ones.
OLD = "SELECT doc_id, lang, source, text AS body FROM {documents} WHERE n_chars < 4000"
NEW = """SELECT doc_id, lang, concat(source, '-v2') AS source, CASE WHEN doc_id % 2 = 0 THEN text ELSE concat(text, ' new') END AS body
FROM {documents} WHERE n_chars >= 1000"""


@query("catalog_upsert", f"""
WITH o AS ({plain(OLD)}), n AS ({plain(NEW)})
SELECT doc_id, lang, source, sha256(body) AS content_hash FROM n UNION ALL
SELECT doc_id, lang, source, sha256(body) FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)
""")
def catalog_upsert(t: Tables):
    merged = keyed.upsert(t.derive(OLD), t.derive(NEW), ["doc_id"])
    return merged.select("doc_id", "lang", "source", F.sha2("body", 256).alias("content_hash"))


def _lines(df):
    return df.select("doc_id", F.posexplode(F.split("body", "\n")).alias("n", "line"))


@query("catalog_replace_chunks", f"""
WITH o AS ({plain(OLD)}), n AS ({plain(NEW)}), changed AS (SELECT n.* FROM n LEFT JOIN o USING (doc_id) WHERE o.body IS DISTINCT FROM n.body),
ol AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, unnest(range(0, len(string_split(body, chr(10))))) AS n FROM o),
nl AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, unnest(range(0, len(string_split(body, chr(10))))) AS n FROM changed)
SELECT doc_id, n, sha256(line) AS line_hash FROM nl UNION ALL
SELECT doc_id, n, sha256(line) FROM ol WHERE doc_id NOT IN (SELECT doc_id FROM changed)
""")
def catalog_replace_chunks(t: Tables):
    old, new = t.derive(OLD), t.derive(NEW)
    changed = new.join(old.select("doc_id", "body"), ["doc_id", "body"], "left_anti")
    out = keyed.replace_children(_lines(old), _lines(changed), "doc_id", changed)
    return out.select("doc_id", F.col("n").cast("long").alias("n"), F.sha2("line", 256).alias("line_hash"))


# The second run holds every altered document twice, the outdated row with a lower version, and is tried again.
_FIRST = """SELECT 'crm' AS source_system, 'doc' AS source_entity_type, CAST(doc_id AS STRING) AS source_entity_key, 'web' AS target_channel,
  lang AS title, body AS body_text, 0 AS version FROM o"""
_SECOND = """SELECT 'crm' AS source_system, 'doc' AS source_entity_type, CAST(doc_id AS STRING) AS source_entity_key, 'web' AS target_channel,
  lang AS title, body AS body_text, 1 AS version FROM n UNION ALL
SELECT 'crm', 'doc', CAST(doc_id AS STRING), 'web', lang, concat('outdated ', body), 0 FROM n WHERE doc_id % 3 = 0"""
_FINAL = f"""o AS ({plain(OLD)}), n AS ({plain(NEW)}), bodies AS (SELECT doc_id, body AS text FROM n UNION ALL
  SELECT doc_id, body FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n))"""


def _synced(t: Tables) -> ct.Catalog:
    catalog = ct.Catalog(t.spark, new_scratch(t.spark, "catalog"))
    first, second = (t.derive(f"WITH o AS ({OLD}), n AS ({NEW}) {sql}").withColumn("content_hash", F.sha2("body_text", 256))
                     for sql in (_FIRST, _SECOND))
    for run, documents in ((1, first), (2, second), (2, second), (3, first.limit(0))):
        catalog.sync(documents, run, ["version"])
    return catalog


@query("catalog_sync", f"""
WITH RECURSIVE {_FINAL}, {chunk_sql("bodies")}
SELECT doc_id::VARCHAR AS source_entity_key, sha256(text) AS document_hash, chunk_index::BIGINT AS chunk_index,
  sha256(chunk_text) AS chunk_hash, greatest(1, length(chunk_text) // 4)::BIGINT AS token_estimate
FROM bodies LEFT JOIN chunks USING (doc_id)
""")
def catalog_sync(t: Tables):
    """Sources and chunks as they are read back after two versions of the documents were synced."""
    catalog = _synced(t)
    sources = catalog.sources.read().select("source_entity_key", F.col("content_hash").alias("document_hash"), ct.source_id().alias("source_id"))
    return sources.join(catalog.chunks.read(), "source_id", "left").select(
        "source_entity_key", "document_hash", F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("content_hash").alias("chunk_hash"), F.col("token_estimate").cast("long").alias("token_estimate"))


@query("catalog_sync_runs", f"""
WITH RECURSIVE o AS ({plain(OLD)}), n AS ({plain(NEW)}), changed AS (SELECT n.* FROM n LEFT JOIN o USING (doc_id) WHERE o.body IS DISTINCT FROM n.body),
bodies AS (SELECT doc_id, body AS text FROM o UNION ALL SELECT -1 - doc_id, body FROM changed), {chunk_sql("bodies")}
SELECT 1::BIGINT AS run_id, 'completed' AS status, (SELECT count(*) FROM o)::BIGINT AS documents_seen, (SELECT count(*) FROM o)::BIGINT AS documents_upserted,
  0::BIGINT AS documents_unchanged, (SELECT count(*) FROM chunks WHERE doc_id >= 0)::BIGINT AS chunks_upserted
UNION ALL SELECT 2, 'completed', (SELECT count(*) + count(*) FILTER (WHERE doc_id % 3 = 0) FROM n), (SELECT count(*) FROM changed),
  (SELECT count(*) FROM n) - (SELECT count(*) FROM changed), (SELECT count(*) FROM chunks WHERE doc_id < 0)
UNION ALL SELECT 3, 'completed', 0, 0, 0, 0
""")
def catalog_sync_runs(t: Tables):
    return _synced(t).runs.read()


@query("seed_if_absent", f"""
WITH o AS ({plain(OLD)}), n AS ({plain(NEW)})
SELECT doc_id, source FROM o UNION ALL SELECT doc_id, source FROM n WHERE doc_id NOT IN (SELECT doc_id FROM o)
""")
def seed_if_absent(t: Tables):
    return keyed.insert_absent(t.derive(OLD), t.derive(NEW), ["doc_id"]).select("doc_id", "source")


@query("sync_run_metrics", """
WITH c AS (SELECT doc_id, sha256(line) AS h FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE trim(line) <> ''),
k AS (SELECT DISTINCT sha256(line) AS h FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang = 'fr'))
SELECT (SELECT count(*) FROM documents)::BIGINT AS documents_seen, (SELECT count(*) FROM documents)::BIGINT AS documents_upserted,
 (SELECT count(*) FROM c)::BIGINT AS chunks_upserted, (SELECT count(*) FROM c WHERE h IN (SELECT h FROM k))::BIGINT AS chunks_embedded,
 (SELECT count(*) FROM c WHERE h NOT IN (SELECT h FROM k))::BIGINT AS embeddings_skipped
""")
def sync_run_metrics(t: Tables):
    docs = t.documents.select(
        F.lit("s").alias("source_system"), F.lit("doc").alias("source_entity_type"),
        F.col("doc_id").alias("source_entity_key"), F.lit("web").alias("target_channel"))
    lines = t.documents.select("lang", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    chunks = lines.select("lang", F.sha2("line", 256).alias("content_hash"))
    return ct.run_metrics(docs, chunks, chunks.where("lang = 'fr'"))


@query("plan_features", f"""
WITH pf(plan_code, feature_code) AS (VALUES {', '.join(
    f"('{p}', '{f}')" for p, fs in fv.PLAN_FEATURES.items() for f in fs)}),
w AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'starter' WHEN 'MACHINERY' THEN 'operational'
  WHEN 'HOUSEHOLD' THEN 'premium_erp' ELSE 'enterprise_custom' END AS plan_code FROM customer)
SELECT plan_code, feature_code, count(*)::BIGINT AS n_workspaces FROM w JOIN pf USING (plan_code) GROUP BY ALL
""")
def plan_features(t: Tables):
    plan = (F.when(F.col("c_mktsegment") == "BUILDING", "starter")
            .when(F.col("c_mktsegment") == "MACHINERY", "operational")
            .when(F.col("c_mktsegment") == "HOUSEHOLD", "premium_erp").otherwise("enterprise_custom"))
    features = fixed_table(t.spark, ["plan_code", "feature_code"],
                           [(p, f) for p, fs in fv.PLAN_FEATURES.items() for f in fs])
    # Counted before the join: the lookup meets one row per plan.
    spaces = t.customer.groupBy(plan.alias("plan_code")).agg(F.count(F.lit(1)).alias("n_workspaces"))
    return spaces.join(features, "plan_code").select("plan_code", "feature_code", "n_workspaces")
