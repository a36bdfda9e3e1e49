"""Data-quality queries over the given tables and over defects derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom import fixed_values as fv
from opsloom.catalogue.registry import Tables, plain, query
from opsloom.catalogue.text import sql_in
from opsloom.operators import keyed
from opsloom.operators.literals import fixed_table
from opsloom.plans import quality as ql

_CHECK = "{n}::BIGINT AS violations, CASE WHEN {n} = 0 THEN 'passed' ELSE '{s}' END AS status"


def _sql(check: str, table: str, count: str, severity: str = "failed") -> str:
    return (f"SELECT '{check}' AS check_id, '{table}' AS table_name, '{severity}' AS severity, n::BIGINT AS violations, "
            f"CASE WHEN n = 0 THEN 'passed' ELSE '{severity}' END AS status FROM ({count})")


ENUM_RULES = (
    ql.TableRules("orders", rows=(
        ql.allowed("order_status", "o_orderstatus", ("F", "O")),
        ql.allowed("order_priority", "o_orderpriority", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))),
    ql.TableRules("events", rows=(
        ql.allowed("event_type", "event_type", ("signup", "view", "click", "purchase", "error")),)),
    ql.TableRules("documents", rows=(ql.allowed("lang", "lang", ("en", "fr", "es"), "warning"),)),
    ql.TableRules("conversations", rows=(ql.allowed("role", "role", ("system", "user", "assistant", "tool")),)),
    ql.TableRules("labels", rows=(ql.RowRule("label_values", "quality IN (0, 1) AND toxic IN (0, 1)"),)),
)


def _tables(t: Tables) -> dict:
    return {n: getattr(t, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                                       "events", "documents", "embeddings", "pages", "benchmark", "labels",
                                       "conversations")}


@query("dq_enum", " UNION ALL ".join([
    _sql("order_status", "orders", "SELECT count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS n FROM orders"),
    _sql("order_priority", "orders", "SELECT count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')) AS n FROM orders"),
    _sql("event_type", "events", "SELECT count(*) FILTER (WHERE event_type NOT IN ('signup', 'view', 'click', 'purchase', 'error')) AS n FROM events"),
    _sql("lang", "documents", "SELECT count(*) FILTER (WHERE lang NOT IN ('en', 'fr', 'es')) AS n FROM documents", "warning"),
    _sql("role", "conversations", "SELECT count(*) FILTER (WHERE role NOT IN ('system', 'user', 'assistant', 'tool')) AS n FROM conversations"),
    _sql("label_values", "labels", "SELECT count(*) FILTER (WHERE NOT (quality IN (0, 1) AND toxic IN (0, 1))) AS n FROM labels"),
]))
def dq_enum(t: Tables):
    return ql.evaluate(_tables(t), ENUM_RULES)


RANGE_RULES = (
    ql.TableRules("lineitem", rows=(
        ql.between("discount", "l_discount", 0, 0.1), ql.between("quantity", "l_quantity", 1, 45),
        ql.between("tax", "l_tax", 0, None), ql.RowRule("price_over_quantity", "l_extendedprice >= l_quantity"))),
    ql.TableRules("customer", rows=(ql.between("balance", "c_acctbal", 0, None, "warning"),)),
    ql.TableRules("embeddings", rows=(
        ql.RowRule("dimension", "size(embedding) = 64"), ql.between("label", "label", 0, 9))),
    ql.TableRules("documents", rows=(ql.RowRule("length_matches", "n_chars = length(text)"),)),
)


@query("dq_range", " UNION ALL ".join([
    _sql("discount", "lineitem", "SELECT count(*) FILTER (WHERE NOT l_discount BETWEEN 0 AND 0.1::DOUBLE) AS n FROM lineitem"),
    _sql("quantity", "lineitem", "SELECT count(*) FILTER (WHERE NOT l_quantity BETWEEN 1 AND 45) AS n FROM lineitem"),
    _sql("tax", "lineitem", "SELECT count(*) FILTER (WHERE l_tax < 0) AS n FROM lineitem"),
    _sql("price_over_quantity", "lineitem", "SELECT count(*) FILTER (WHERE l_extendedprice < l_quantity) AS n FROM lineitem"),
    _sql("balance", "customer", "SELECT count(*) FILTER (WHERE c_acctbal < 0) AS n FROM customer", "warning"),
    _sql("dimension", "embeddings", "SELECT count(*) FILTER (WHERE len(embedding) <> 64) AS n FROM embeddings"),
    _sql("label", "embeddings", "SELECT count(*) FILTER (WHERE label NOT BETWEEN 0 AND 9) AS n FROM embeddings"),
    _sql("length_matches", "documents", "SELECT count(*) FILTER (WHERE n_chars <> length(text)) AS n FROM documents"),
]))
def dq_range(t: Tables):
    return ql.evaluate(_tables(t), RANGE_RULES)


UNIQUE_RULES = (
    ql.TableRules("orders", unique=(("order_key", ("o_orderkey",), None),
                                    ("one_open_per_customer", ("o_custkey",), "o_orderstatus = 'O'"))),
    ql.TableRules("lineitem", unique=(("line_key", ("l_orderkey", "l_linenumber"), None),
                                      ("returned_part", ("l_partkey", "l_suppkey"), "l_returnflag = 'R'"))),
    ql.TableRules("documents", unique=(("doc_key", ("doc_id",), None),)),
)


def _dup(check: str, table: str, keys: str, where: str = "true") -> str:
    return _sql(check, table, f"SELECT count(*) AS n FROM (SELECT 1 FROM {table} WHERE {where} GROUP BY {keys} HAVING count(*) > 1)")


@query("dq_unique", " UNION ALL ".join([
    _dup("order_key", "orders", "o_orderkey"), _dup("one_open_per_customer", "orders", "o_custkey", "o_orderstatus = 'O'"),
    _dup("line_key", "lineitem", "l_orderkey, l_linenumber"), _dup("returned_part", "lineitem", "l_partkey, l_suppkey", "l_returnflag = 'R'"),
    _dup("doc_key", "documents", "doc_id"),
]))
def dq_unique(t: Tables):
    return ql.evaluate(_tables(t), UNIQUE_RULES)


FK_RULES = (
    ql.TableRules("orders", references=(("order_customer", "o_custkey", "customer", "c_custkey"),)),
    ql.TableRules("lineitem", references=(
        ("line_order", "l_orderkey", "orders", "o_orderkey"), ("line_part", "l_partkey", "part", "p_partkey"),
        ("line_supplier", "l_suppkey", "supplier", "s_suppkey"))),
    ql.TableRules("nation", references=(("nation_region", "n_regionkey", "region", "r_regionkey"),)),
    ql.TableRules("labels", references=(("label_document", "doc_id", "documents", "doc_id"),)),
    ql.TableRules("events", references=(("event_user", "user_id", "supplier", "s_suppkey"),)),
)


def _fk(check: str, child: str, key: str, parent: str, pkey: str) -> str:
    return _sql(check, child, f"SELECT count(*) AS n FROM {child} c WHERE c.{key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pkey} = c.{key})")


_FK_SQL = [_fk(name, r.table, key, parent, pkey) for r in FK_RULES for name, key, parent, pkey in r.references]


@query("dq_fk", " UNION ALL ".join(_FK_SQL))
def dq_fk(t: Tables):
    return ql.evaluate(_tables(t), FK_RULES)


@query("dq_rollup", "WITH r AS (" + " UNION ALL ".join(_FK_SQL) + """)
SELECT count(*) FILTER (WHERE status = 'passed')::BIGINT AS passed, count(*) FILTER (WHERE status = 'failed')::BIGINT AS failed,
 count(*) FILTER (WHERE status = 'warning')::BIGINT AS warnings, count(*) FILTER (WHERE status = 'skipped')::BIGINT AS skipped,
 CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed' ELSE 'passed' END AS overall FROM r
""")
def dq_rollup(t: Tables):
    return ql.rollup(ql.evaluate(_tables(t), FK_RULES))


@query("cascade_delete", """
WITH g AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
SELECT 'cascade' AS mode, l_linestatus AS bucket, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM g) GROUP BY 2
UNION ALL SELECT 'restrict', l_linestatus, count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM g) GROUP BY 2
UNION ALL SELECT 'set_null', l_linestatus, count(CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM g) THEN 1 END) FROM lineitem GROUP BY 2
""")
def cascade_delete(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_linestatus")
    gone = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    parts = [
        ql.delete_cascade(lines, "l_orderkey", gone, mode).groupBy(F.col("l_linestatus").alias("bucket")).agg(
            F.count("l_orderkey").alias("n")).select(F.lit(mode).alias("mode"), "bucket", "n")
        for mode in ("cascade", "restrict", "set_null")]
    return ql.union_all(parts)


BINDINGS = """
SELECT o_orderkey AS binding_id, c_nationkey AS workspace_id, CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'internal' WHEN 1 THEN 'workspace'
  WHEN 2 THEN 'assistant_instance' WHEN 3 THEN 'automation_package' ELSE 'package_worker' END AS binding_type,
 CASE WHEN o_totalprice < 5000 THEN NULL WHEN o_orderkey % 6 = 0 THEN CASE WHEN o_totalprice > 450000 THEN 1 END
  WHEN o_orderkey % 6 = 1 THEN CASE WHEN o_totalprice > 400000 THEN c_nationkey + 1 ELSE c_nationkey END ELSE o_custkey END AS bound_entity_id,
 o_orderstatus = 'F' AS is_default FROM {orders} JOIN {customer} ON c_custkey = o_custkey
"""
_T = "'workspace', 'assistant_instance', 'automation_package', 'package_worker'"


@query("dq_bindings", f"WITH b AS ({plain(BINDINGS)}) " + " UNION ALL ".join([
    _sql("internal_with_target", "knowledge_scope_bindings", "SELECT count(*) AS n FROM b WHERE binding_type = 'internal' AND bound_entity_id IS NOT NULL"),
    _sql("target_missing", "knowledge_scope_bindings", f"SELECT count(*) AS n FROM b WHERE binding_type IN ({_T}) AND bound_entity_id IS NULL"),
    _sql("workspace_target", "knowledge_scope_bindings", "SELECT count(*) AS n FROM b WHERE binding_type = 'workspace' AND (bound_entity_id IS NULL OR bound_entity_id <> workspace_id)"),
    _sql("ambiguous_defaults", "knowledge_scope_bindings", f"SELECT count(*) AS n FROM (SELECT 1 FROM b WHERE is_default AND bound_entity_id IS NULL AND binding_type IN ({_T}) GROUP BY binding_type HAVING count(*) > 1)"),
]))
def dq_bindings(t: Tables):
    return ql.check_bindings(t.derive(BINDINGS))


EMBEDDINGS = """
SELECT CASE WHEN vec_id % 50 = 49 THEN vec_id - 1 ELSE vec_id END AS chunk_id, CAST(label % 2 AS INT) AS model_id,
 CASE WHEN vec_id % 11 = 0 THEN 'src0' ELSE source END AS scope_id,
 CASE CAST(vec_id % 7 AS INT) WHEN 0 THEN 'pending' WHEN 1 THEN 'completed' ELSE 'ready' END AS embedding_status,
 CASE WHEN vec_id % 13 = 0 THEN NULL ELSE embedding END AS embedding FROM {embeddings} JOIN {documents} ON doc_id = vec_id
"""


@query("dq_embeddings", f"WITH e AS ({plain(EMBEDDINGS)}) " + " UNION ALL ".join([
    _sql("ready_without_vector", "knowledge_chunk_embeddings", "SELECT count(*) AS n FROM e WHERE embedding_status = 'ready' AND embedding IS NULL"),
    _sql("status_known", "knowledge_chunk_embeddings", f"SELECT count(*) AS n FROM e WHERE embedding_status NOT IN {sql_in(fv.EMBEDDING_STATUSES)}"),
    _sql("pair_unique", "knowledge_chunk_embeddings", "SELECT count(*) AS n FROM (SELECT 1 FROM e GROUP BY chunk_id, model_id HAVING count(*) > 1)"),
    _sql("scope_match", "knowledge_chunk_embeddings", "SELECT count(*) AS n FROM e JOIN documents ON doc_id = chunk_id WHERE scope_id <> source"),
]))
def dq_embeddings(t: Tables):
    scopes = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("scope_id"))
    return ql.check_embeddings(t.derive(EMBEDDINGS), scopes, fv.EMBEDDING_STATUSES)


@query("dq_tenant", """
WITH x AS (SELECT count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE CASE WHEN o_orderkey % 40 = 0 THEN c_nationkey + 1 ELSE c_nationkey END <> c_nationkey)
SELECT 'tenant_match' AS check_id, 'package_workers' AS table_name, 'warning' AS severity, n::BIGINT AS violations,
 CASE WHEN n = 0 THEN 'passed' ELSE 'warning' END AS status FROM x
UNION ALL SELECT 'tenant_match', 'empty_workers', 'warning', 0, 'skipped'
""")
def dq_tenant(t: Tables):
    packages = t.customer.select(F.col("c_custkey").alias("package_id"), F.col("c_nationkey").alias("workspace_id"))
    shift = F.when(F.col("o_orderkey") % 40 == 0, 1).otherwise(0)
    workers = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_custkey").alias("package_id"), (F.col("c_nationkey") + shift).alias("workspace_id"))
    none = workers.where("workspace_id < 0")
    return ql.check_tenant(workers, packages, "package_id", "package_workers").unionByName(
        ql.check_tenant(none, packages, "package_id", "empty_workers"))


@query("tenant_mismatch", """
SELECT o_orderkey AS worker_id, c_nationkey::BIGINT AS package_workspace FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 40 = 0
""")
def tenant_mismatch(t: Tables):
    shift = F.when(F.col("o_orderkey") % 40 == 0, 1).otherwise(0)
    pairs = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).withColumn(
        "worker_workspace", F.col("c_nationkey") + shift)
    return pairs.where("worker_workspace <> c_nationkey").select(
        F.col("o_orderkey").alias("worker_id"), F.col("c_nationkey").cast("long").alias("package_workspace"))


@query("scope_mismatch", f"WITH e AS ({plain(EMBEDDINGS)}) SELECT chunk_id, scope_id, source AS document_scope FROM e JOIN documents ON doc_id = chunk_id WHERE scope_id <> source")
def scope_mismatch(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_scope"))
    return t.derive(EMBEDDINGS).join(docs, "chunk_id").where("scope_id <> document_scope").select(
        "chunk_id", "scope_id", "document_scope")


@query("orphans", """
SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)
""")
def orphans(t: Tables):
    return keyed.orphans(t.events.select("event_id", "user_id"), "user_id", t.supplier, "s_suppkey")


@query("missing_items", """
SELECT doc_id, 'label' AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'embedding' FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
""")
def missing_items(t: Tables):
    kinds = F.explode(F.array(F.lit("label"), F.lit("embedding")))
    expected = t.documents.select("doc_id", kinds.alias("missing"))
    actual = t.labels.select("doc_id", F.lit("label").alias("missing")).unionByName(
        t.embeddings.select(F.col("vec_id").alias("doc_id"), F.lit("embedding").alias("missing")))
    return expected.join(actual, ["doc_id", "missing"], "left_anti")


@query("duplicates", """
SELECT l_partkey, l_suppkey, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1
""")
def duplicates(t: Tables):
    return keyed.duplicates(t.lineitem, ["l_partkey", "l_suppkey"])


@query("dq_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*)::BIGINT AS n_rows FROM {n} HAVING count(*) > 0" for n in (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
        "labels", "conversations")))
def dq_counts(t: Tables):
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
             for n, df in _tables(t).items()]
    return ql.union_all(parts).where("n_rows > 0")


@query("dq_schema", """
SELECT 'columns_present' AS check_id, table_name, 'failed' AS severity, n::BIGINT AS violations, CASE WHEN n = 0 THEN 'passed' ELSE 'failed' END AS status,
 CASE table_name WHEN 'orders' THEN (SELECT count(*) FROM orders) ELSE (SELECT count(*) FROM documents) END::BIGINT AS n_rows
FROM (SELECT 'orders' AS table_name, 3 - count(*) AS n FROM information_schema.columns WHERE table_name = 'orders' AND column_name IN ('o_orderkey', 'o_custkey', 'o_status')
UNION ALL SELECT 'documents', 2 - count(*) FROM information_schema.columns WHERE table_name = 'documents' AND column_name IN ('doc_id', 'text'))
""")
def dq_schema(t: Tables):
    rules = (ql.TableRules("orders", columns=("o_orderkey", "o_custkey", "o_status")),
             ql.TableRules("documents", columns=("doc_id", "text")))
    sizes = ql.union_all([
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in (("orders", t.orders), ("documents", t.documents))])
    return ql.evaluate(_tables(t), rules).join(sizes, "table_name")


@query("dq_seed", """
SELECT 'seed_rows' AS check_id, 'nation' AS table_name, 'failed' AS severity, n::BIGINT AS violations, CASE WHEN n = 0 THEN 'passed' ELSE 'failed' END AS status
FROM (SELECT count(*) AS n FROM (VALUES ('NATION_0'), ('NATION_7'), ('ATLANTIS')) v(x) WHERE x NOT IN (SELECT n_name FROM nation))
UNION ALL SELECT 'seed_rows', 'part', 'failed', n, CASE WHEN n = 0 THEN 'passed' ELSE 'failed' END
FROM (SELECT count(*) AS n FROM (VALUES ('PROMO', true), ('SMALL', false), ('TINY', true)) v(x, b)
  LEFT JOIN (SELECT p_type, bool_or(p_size > 10) AS big FROM part GROUP BY 1) ON p_type = x WHERE big IS NULL OR big <> b)
""")
def dq_seed(t: Tables):
    names = fixed_table(t.spark, ["n_name"], [("NATION_0",), ("NATION_7",), ("ATLANTIS",)])
    kinds = fixed_table(t.spark, ["p_type", "big"], [("PROMO", True), ("SMALL", False), ("TINY", True)])
    actual = t.part.groupBy("p_type").agg(F.bool_or(F.col("p_size") > 10).alias("big"))
    return ql.check_seeds(t.nation, names, "n_name", "nation").unionByName(
        ql.check_seeds(actual, kinds, "p_type", "part", ["big"]))


@query("dq_approval", _sql("approval_status", "task_runs", f"""SELECT count(*) AS n FROM (SELECT CASE WHEN value > 250 THEN 'bypassed' WHEN event_type = 'error' THEN 'rejected' ELSE 'approved' END AS s FROM events) WHERE s NOT IN {sql_in(fv.APPROVAL_STATUSES)}"""))
def dq_approval(t: Tables):
    runs = t.events.select(F.when(F.col("value") > 250, "bypassed").when(F.col("event_type") == "error", "rejected")
                           .otherwise("approved").alias("approval_status"))
    return ql.check_rows(runs, "task_runs", [ql.allowed("approval_status", "approval_status", fv.APPROVAL_STATUSES)])
