"""Queries over tenants and console counts. Nations are workspaces, regions
organisations, customers users, orders services and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom import fixed_values as fv
from opsloom.catalogue.registry import Tables, plain, query
from opsloom.operators import hierarchy, keyed
from opsloom.operators.literals import fixed_table
from opsloom.plans import tenancy as tn

SERVICES = """
SELECT o_orderkey AS service_id, c_nationkey AS workspace_id, o_custkey AS user_id,
  CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'warning' ELSE 'resolved' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'warning' ELSE 'info' END AS severity,
  o_totalprice > 200000 AS visible_to_client, o_orderdate AS created_at
FROM {orders} JOIN {customer} ON c_custkey = o_custkey
"""
# Accessible workspaces: the nations of two regions.
ACCESS = "SELECT n_nationkey AS workspace_id FROM {nation} JOIN {region} ON r_regionkey = n_regionkey WHERE r_name IN ('AMERICA', 'ASIA')"
_W = f"WITH s AS ({plain(SERVICES)}), a AS ({plain(ACCESS)}) "


@query("visible_rows", _W + """
SELECT service_id, 'technical' AS depth FROM s WHERE workspace_id IN (SELECT workspace_id FROM a)
UNION ALL SELECT service_id, 'business' FROM s WHERE workspace_id IN (SELECT workspace_id FROM a) AND visible_to_client
UNION ALL SELECT service_id, 'client' FROM s WHERE workspace_id = 2
UNION ALL SELECT service_id, 'open' FROM s WHERE status <> 'resolved' AND workspace_id IN (SELECT workspace_id FROM a)
""")
def visible_rows(t: Tables):
    s, a = t.derive(SERVICES), t.derive(ACCESS)
    parts = {
        "technical": tn.visible_services(s, a, "technical"), "business": tn.visible_services(s, a, "business"),
        "client": tn.narrow_to_active(s, "client", 2),
        "open": tn.visible(s.where(tn.is_open("status", "resolved")), a),
    }
    out = None
    for name, df in parts.items():
        part = df.select("service_id", F.lit(name).alias("depth"))
        out = part if out is None else out.unionByName(part)
    return out


@query("visible_users", """
WITH o AS (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE'),
w AS (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'AFRICA'),
m AS (SELECT o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE (c_nationkey + CAST(floor(o_totalprice) AS BIGINT)) % 25 IN (SELECT n_nationkey FROM w))
SELECT c_custkey AS user_id, c_name AS user_name FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE n_regionkey IN (SELECT r_regionkey FROM o) OR c_custkey IN (SELECT o_custkey FROM m)
""")
def visible_users(t: Tables):
    users = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"),
        F.col("n_regionkey").alias("organisation_id"))
    members = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_custkey").alias("user_id"),
        ((F.col("c_nationkey") + F.floor("o_totalprice")) % 25).cast("int").alias("workspace_id"))
    orgs = t.region.where("r_name = 'EUROPE'").select(F.col("r_regionkey").alias("organisation_id"))
    africa = t.region.where("r_name = 'AFRICA'").select(F.col("r_regionkey").alias("n_regionkey"))
    spaces = t.nation.join(africa, "n_regionkey").select(F.col("n_nationkey").alias("workspace_id"))
    return tn.visible_users(users, members, orgs, spaces).select("user_id", "user_name")


@query("lookup_default", """
SELECT o_orderkey, coalesce(s_name, 'Organización no disponible') AS owner_name,
  CASE WHEN c_nationkey = o_custkey % 25 THEN 'own' ELSE 'delegated' END AS access_mode,
  CASE WHEN c_nationkey <> o_custkey % 25 THEN c_nationkey END::BIGINT AS delegated_by
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = o_custkey
""")
def lookup_default(t: Tables):
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderkey", F.col("o_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("user_organisation"),
        (F.col("o_custkey") % 25).alias("workspace_organisation"))
    named = tn.with_default(rows, t.supplier, "s_suppkey", "s_name", "Organización no disponible")
    return tn.access_mode(named).select(
        "o_orderkey", F.col("s_name").alias("owner_name"), "access_mode",
        F.col("delegated_by").cast("long").alias("delegated_by"))


# Menu entries: (item, group, order, audiences, module, permissions, org types, needs workspace, needs services)
MENU = [
    ("home", "main", 1, ["owner", "operator", "partner", "client"], "core", [], None, False, False),
    ("organisations", "network", 2, ["owner", "partner"], "network", ["organizations.read", "organizations.read_descendants"], None, False, False),
    ("services", "main", 3, ["owner", "operator", "partner", "client"], "services", ["services.read"], None, True, False),
    ("reports", "main", 4, ["partner", "client"], "reports", ["reports.read"], ["direct_client", "partner"], True, True),
    ("runs", "ops", 5, ["operator", "owner"], "runs", ["runs.read"], None, True, True),
    ("settings", "admin", 6, ["owner"], "core", [], ["owner"], False, False),
]
USERS = """
SELECT c_custkey AS user_id, c_nationkey AS workspace_id, c_mktsegment,
  CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'organizations.read,services.read,runs.read' WHEN 1 THEN 'organizations.read_descendants,reports.read'
    WHEN 2 THEN 'services.read,reports.read' ELSE 'runs.read' END AS permissions,
  CASE CAST(c_nationkey % 4 AS INT) WHEN 0 THEN 'owner' WHEN 1 THEN 'partner' WHEN 2 THEN 'direct_client' ELSE 'partner_client' END AS organisation_type,
  CASE WHEN c_acctbal > 5000 THEN 'core,services,reports' ELSE 'core,network,runs,services' END AS modules,
  CASE WHEN c_acctbal < 0 THEN 0 ELSE 2 END AS n_services FROM {customer}
"""
_AUD = """CASE WHEN list_contains(p, 'organizations.read') THEN 'owner' WHEN organisation_type = 'owner' THEN 'operator'
  WHEN list_contains(p, 'organizations.read_descendants') THEN 'partner' ELSE 'client' END"""


@query("registry_visible", f"""
WITH u AS (SELECT *, string_split(permissions, ',') AS p, string_split(modules, ',') AS m FROM ({plain(USERS)})),
x AS (SELECT *, {_AUD} AS aud FROM u),
i AS (SELECT user_id, 1 AS o, 'main' AS g, 'home' AS item FROM x WHERE list_contains(m, 'core')
 UNION ALL SELECT user_id, 2, 'network', 'organisations' FROM x WHERE aud IN ('owner', 'partner') AND list_contains(m, 'network')
   AND list_has_any(p, ['organizations.read', 'organizations.read_descendants'])
 UNION ALL SELECT user_id, 3, 'main', 'services' FROM x WHERE list_contains(m, 'services') AND list_contains(p, 'services.read')
 UNION ALL SELECT user_id, 4, 'main', 'reports' FROM x WHERE aud IN ('partner', 'client') AND list_contains(m, 'reports') AND list_contains(p, 'reports.read')
   AND organisation_type IN ('direct_client', 'partner') AND n_services > 0
 UNION ALL SELECT user_id, 5, 'ops', 'runs' FROM x WHERE aud IN ('operator', 'owner') AND list_contains(m, 'runs') AND list_contains(p, 'runs.read') AND n_services > 0
 UNION ALL SELECT user_id, 6, 'admin', 'settings' FROM x WHERE aud = 'owner' AND list_contains(m, 'core') AND organisation_type = 'owner')
SELECT user_id, g AS menu_group, string_agg(item, '|' ORDER BY o) AS items, any_value(aud) AS audience FROM i JOIN x USING (user_id) GROUP BY ALL
""".replace("any_value(aud)", "any_value(x.aud)"))
def registry_visible(t: Tables):
    users = t.derive(USERS).withColumn("permissions", F.split("permissions", ",")).withColumn(
        "modules", F.split("modules", ","))
    users = users.withColumn("audience", tn.audience(F.col("permissions"), F.col("organisation_type")))
    entries = []
    for item, group, order, audiences, module, perms, types, space, services in MENU:
        words = lambda ws: F.array(*[F.lit(w) for w in ws]).cast("array<string>")
        show = tn.registry_visible(
            {"audiences": words(audiences), "module": F.lit(module), "permissions_any": words(perms),
             "organisation_types": words(types) if types else F.lit(None).cast("array<string>"),
             "requires_workspace": F.lit(space), "requires_services": F.lit(services)},
            {c: F.col(c) for c in ("audience", "modules", "permissions", "organisation_type", "workspace_id", "n_services")})
        entries.append(F.when(show, F.struct(F.lit(group).alias("g"), F.lit(order).alias("o"), F.lit(item).alias("item"))))
    shown = users.select("user_id", "audience", F.array_compact(F.array(*entries)).alias("e"))
    groups = shown.select("user_id", "audience", "e", F.explode(
        F.array_distinct(F.transform("e", lambda x: x["g"]))).alias("menu_group"))
    return groups.select(
        "user_id", "menu_group", "audience",
        F.array_join(F.transform(F.filter("e", lambda x: x["g"] == F.col("menu_group")), lambda x: x["item"]), "|")
        .alias("items"))


@query("child_bundle", """
WITH x AS (SELECT o_custkey, count(*) AS n, list(o_orderkey ORDER BY o_orderkey)[1:4] AS f FROM orders GROUP BY ALL),
y AS (SELECT o_custkey, count(*) AS n, list(o_orderkey ORDER BY o_orderkey)[1:4] AS f FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)
SELECT c_custkey, coalesce(x.n, 0)::BIGINT AS n_reports, coalesce(y.n, 0)::BIGINT AS n_alerts,
  array_to_string(x.f, '|') AS first_reports, array_to_string(y.f, '|') AS first_alerts
FROM customer LEFT JOIN x ON x.o_custkey = c_custkey LEFT JOIN y ON y.o_custkey = c_custkey
""")
def child_bundle(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    out = tn.bundle_children(
        t.customer.select("c_custkey"), "c_custkey",
        {"reports": (rows, "o_orderkey"), "alerts": (rows.where("o_orderpriority = '1-URGENT'"), "o_orderkey")}, 4)
    return out.select("c_custkey", "n_reports", "n_alerts", F.array_join("first_reports", "|").alias("first_reports"),
                      F.array_join("first_alerts", "|").alias("first_alerts"))


CARDS = {
    "owner": ["organisations_active", "partners_active", "direct_clients", "services_active"],
    "partner": ["partner_clients", "services_active", "reports_ready", "tasks_pending"],
    "operator": ["services_assigned", "runs_recent", "alerts_open", "tasks_pending"],
    "client": ["services_contracted", "reports_ready_here", "alerts_open_here", "tasks_pending_here"],
}


@query("console_cards", _W + """,
v AS (SELECT * FROM s WHERE workspace_id IN (SELECT workspace_id FROM a)),
o AS (SELECT count(*) FILTER (WHERE c_acctbal > 0) AS oa, count(*) FILTER (WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING') AS pa,
  count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS dc,
  count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD' AND c_nationkey IN (SELECT workspace_id FROM a)) AS pc FROM customer),
c AS (SELECT count(*) FILTER (WHERE status = 'active') AS sa, count(*) AS sn, count(*) FILTER (WHERE severity = 'info') AS rr,
  count(*) FILTER (WHERE status <> 'resolved') AS ao, count(*) FILTER (WHERE status <> 'resolved' AND severity <> 'critical') AS tp,
  count(*) FILTER (WHERE workspace_id = 2 AND visible_to_client) AS sc, count(*) FILTER (WHERE workspace_id = 2 AND severity = 'info') AS rh,
  count(*) FILTER (WHERE workspace_id = 2 AND status <> 'resolved') AS ah,
  count(*) FILTER (WHERE workspace_id = 2 AND status <> 'resolved' AND severity <> 'critical') AS th,
  count(*) FILTER (WHERE created_at >= TIMESTAMP '2001-01-01 00:00:00') AS rn FROM v)
SELECT * FROM (
 SELECT 'owner' AS audience, 1::BIGINT AS position, 'organisations_active' AS card, oa AS value FROM o UNION ALL SELECT 'owner', 2, 'partners_active', pa FROM o
 UNION ALL SELECT 'owner', 3, 'direct_clients', dc FROM o UNION ALL SELECT 'owner', 4, 'services_active', sa FROM c
 UNION ALL SELECT 'partner', 1, 'partner_clients', pc FROM o UNION ALL SELECT 'partner', 2, 'services_active', sa FROM c
 UNION ALL SELECT 'partner', 3, 'reports_ready', rr FROM c UNION ALL SELECT 'partner', 4, 'tasks_pending', tp FROM c
 UNION ALL SELECT 'operator', 1, 'services_assigned', sn FROM c UNION ALL SELECT 'operator', 2, 'runs_recent', rn FROM c
 UNION ALL SELECT 'operator', 3, 'alerts_open', ao FROM c UNION ALL SELECT 'operator', 4, 'tasks_pending', tp FROM c
 UNION ALL SELECT 'client', 1, 'services_contracted', sc FROM c UNION ALL SELECT 'client', 2, 'reports_ready_here', rh FROM c
 UNION ALL SELECT 'client', 3, 'alerts_open_here', ah FROM c UNION ALL SELECT 'client', 4, 'tasks_pending_here', th FROM c)
""")
def console_cards(t: Tables):
    """All cards of all audiences from one pass over services and one over organisations."""
    access = t.derive(ACCESS)
    served = tn.visible(t.derive(SERVICES), access)
    here, open_ = F.col("workspace_id") == 2, F.col("status") != "resolved"
    task = open_ & (F.col("severity") != "critical")
    counts = served.agg(
        F.count_if(F.col("status") == "active").alias("services_active"), F.count(F.lit(1)).alias("services_assigned"),
        F.count_if(F.col("severity") == "info").alias("reports_ready"), F.count_if(open_).alias("alerts_open"),
        F.count_if(task).alias("tasks_pending"), F.count_if(here & F.col("visible_to_client")).alias("services_contracted"),
        F.count_if(here & (F.col("severity") == "info")).alias("reports_ready_here"),
        F.count_if(here & open_).alias("alerts_open_here"), F.count_if(here & task).alias("tasks_pending_here"),
        F.count_if(F.col("created_at") >= F.expr("TIMESTAMP_NTZ'2001-01-01 00:00:00'")).alias("runs_recent"))
    reach = access.select(F.col("workspace_id").alias("c_nationkey"), F.lit(True).alias("_in"))
    kind = F.col("c_mktsegment")
    orgs = t.customer.join(reach, "c_nationkey", "left").agg(
        F.count_if(F.col("c_acctbal") > 0).alias("organisations_active"),
        F.count_if((F.col("c_acctbal") > 0) & (kind == "BUILDING")).alias("partners_active"),
        F.count_if(kind == "MACHINERY").alias("direct_clients"),
        F.count_if((kind == "HOUSEHOLD") & F.col("_in").isNotNull()).alias("partner_clients"))
    one = F.lit(1)
    row = counts.withColumn("_k", one).join(orgs.withColumn("_k", one), "_k")
    return tn.cards(row, CARDS).withColumn("position", F.col("position").cast("long"))


@query("notification_summary", _W + """
SELECT count(*) FILTER (WHERE status = 'active')::BIGINT AS unread_alerts, count(*) FILTER (WHERE severity = 'critical')::BIGINT AS critical_alerts,
 count(*) FILTER (WHERE severity <> 'critical')::BIGINT AS pending_tasks, count(*) FILTER (WHERE workspace_id = 2)::BIGINT AS active_workspace_alerts
FROM s WHERE status <> 'resolved' AND workspace_id IN (SELECT workspace_id FROM a)
""")
def notification_summary(t: Tables):
    rows = tn.visible(t.derive(SERVICES).where(tn.is_open("status", "resolved")), t.derive(ACCESS))
    return rows.agg(
        F.count_if(F.col("status") == "active").alias("unread_alerts"),
        F.count_if(F.col("severity") == "critical").alias("critical_alerts"),
        F.count_if(F.col("severity") != "critical").alias("pending_tasks"),
        F.count_if(F.col("workspace_id") == 2).alias("active_workspace_alerts"))


@query("health_split", _W + """
SELECT workspace_id::BIGINT AS workspace_id, count(*) FILTER (WHERE status = 'active')::BIGINT AS active_services,
 count(*) FILTER (WHERE status = 'warning' OR severity IN ('warning', 'critical'))::BIGINT AS needs_attention FROM s GROUP BY workspace_id
""")
def health_split(t: Tables):
    return t.derive(SERVICES).groupBy(F.col("workspace_id").cast("long").alias("workspace_id")).agg(
        F.count_if(F.col("status") == "active").alias("active_services"),
        F.count_if((F.col("status") == "warning") | F.col("severity").isin("warning", "critical")).alias("needs_attention"))


@query("alerts_by_type", _W + """
SELECT severity, CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END::BIGINT AS section, count(*)::BIGINT AS n FROM s
WHERE status <> 'resolved' GROUP BY severity
""")
def alerts_by_type(t: Tables):
    kinds = fixed_table(t.spark, ["severity", "section_order"], [("critical", 1), ("warning", 2), ("info", 3)])
    rows = t.derive(SERVICES).where(tn.is_open("status", "resolved"))
    return tn.grouped_in_order(rows, kinds, "severity").select("severity", F.col("section").cast("long").alias("section"), "n")


@query("client_lists", """
SELECT 'clients' AS list_name, c_custkey AS id FROM customer WHERE c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')
UNION ALL SELECT 'partners', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'elsewhere', o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> 2
""")
def client_lists(t: Tables):
    people = t.customer.select("c_mktsegment", F.col("c_custkey").alias("id"))
    clients = people.where(F.col("c_mktsegment").isin("MACHINERY", "HOUSEHOLD")).select(F.lit("clients").alias("list_name"), "id")
    partners = people.where("c_mktsegment = 'BUILDING'").select(F.lit("partners").alias("list_name"), "id")
    other = t.derive(SERVICES).where("workspace_id <> 2").select(
        F.lit("elsewhere").alias("list_name"), F.col("service_id").alias("id"))
    return clients.unionByName(partners).unionByName(other)


@query("child_counts", """
SELECT n_nationkey::BIGINT AS organisation_id, count(c_custkey)::BIGINT AS n_clients,
  count(c_custkey) FILTER (WHERE c_acctbal > 9900)::BIGINT AS n_large FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
""")
def child_counts(t: Tables):
    orgs = t.nation.select(F.col("n_nationkey").alias("c_nationkey"))
    out = tn.child_counts(orgs, t.customer, "c_nationkey", "n_clients")
    out = tn.child_counts(out, t.customer.where("c_acctbal > 9900"), "c_nationkey", "n_large")
    return out.select(F.col("c_nationkey").cast("long").alias("organisation_id"), "n_clients", "n_large")


EDGES = """
SELECT concat('r', CAST(r_regionkey AS STRING)) AS id, CAST(NULL AS STRING) AS parent FROM {region}
UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)) FROM {nation} WHERE n_name <> 'NATION_3'
UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)) FROM {customer}
"""


@query("org_tree", f"""
WITH RECURSIVE e AS ({plain(EDGES)}), w AS (
 SELECT id, id AS root, 0 AS depth, id AS path FROM e WHERE parent IS NULL OR parent NOT IN (SELECT id FROM e)
 UNION ALL SELECT e.id, w.root, w.depth + 1, w.path || '/' || e.id FROM w JOIN e ON e.parent = w.id)
SELECT id AS node, root, depth::BIGINT AS depth, path FROM w
""")
def org_tree(t: Tables):
    out = hierarchy.resolve_roots(t.derive(EDGES), "id", "parent")
    return out.withColumn("depth", F.col("depth").cast("long"))


@query("org_subtree", f"""
WITH RECURSIVE e AS ({plain(EDGES)}), w AS (
 SELECT id, id AS root, 0 AS depth, [id] AS path FROM e WHERE parent IS NULL OR parent NOT IN (SELECT id FROM e)
 UNION ALL SELECT e.id, w.root, w.depth + 1, list_append(w.path, e.id) FROM w JOIN e ON e.parent = w.id),
n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS low FROM w),
s AS (SELECT above AS id, count(*) AS below FROM (SELECT unnest(path) AS above FROM w) GROUP BY 1)
SELECT id AS node, root, depth::BIGINT AS depth, low::BIGINT AS low, (low + below - 1)::BIGINT AS high FROM n JOIN s USING (id)
""")
def org_subtree(t: Tables):
    out = hierarchy.subtree_intervals(t.derive(EDGES), "id", "parent")
    return out.withColumn("depth", F.col("depth").cast("long"))


# Each order replaces an earlier one of its customer: chains of records.
CHAIN = """
SELECT o_orderkey AS id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS replaced_by FROM {orders}
"""


@query("chain_current", """
WITH last AS (SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY ALL)
SELECT o_orderkey AS node, m AS current_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1)::BIGINT AS steps
FROM orders JOIN last USING (o_custkey)
""")
def chain_current(t: Tables):
    out = hierarchy.resolve_roots(t.derive(CHAIN), "id", "replaced_by", path=False)
    return out.select("node", F.col("root").alias("current_id"), F.col("depth").cast("long").alias("steps"))


@query("first_n_per_parent", """
SELECT o_custkey, o_orderkey, r AS rank_position FROM (SELECT o_custkey, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r <= 3
""")
def first_n_per_parent(t: Tables):
    out = keyed.first_n(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 3)
    return out.select("o_custkey", "o_orderkey", F.col("rank_position").cast("long").alias("rank_position"))


@query("latest_per_key", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
  FROM orders) WHERE r = 1
""")
def latest_per_key(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return keyed.latest_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("order_dedupe", """
WITH f AS (SELECT o_custkey, o_orderstatus, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)
SELECT o_custkey, o_orderstatus, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM f) WHERE r <= 6
""")
def order_dedupe(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey")
    return keyed.dedupe_ordered(rows, ["o_custkey"], ["o_orderstatus", "o_orderpriority"], "o_orderkey", 6)


# Permissions, plans, routing ---------------------------------------------------

_ROLE = {0: ["task.view", "task.approve"], 1: ["task.view"], 2: ["audit.view", "task.execute"], 3: ["dashboard.view"]}
_PROFILE = {0: ["task.view", "knowledge.view"], 1: ["task.execute"]}
_VAL_R = ", ".join(f"({r}, '{p}')" for r, ps in _ROLE.items() for p in ps)
_VAL_P = ", ".join(f"({r}, '{p}')" for r, ps in _PROFILE.items() for p in ps)
_PERM_SQL = f"""
rp(role_id, permission) AS (VALUES {_VAL_R}), pp(profile_id, permission) AS (VALUES {_VAL_P}),
e AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_nationkey END AS workspace_id, permission FROM customer JOIN rp ON role_id = c_nationkey % 5
 UNION SELECT c_custkey, c_nationkey, permission FROM customer JOIN pp ON profile_id = c_custkey % 3)
"""


def _permissions(t: Tables):
    roles = t.customer.select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_custkey") % 50 != 0, F.col("c_nationkey")).alias("workspace_id"),
        (F.col("c_nationkey") % 5).cast("int").alias("role_id"))
    profiles = t.customer.select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("workspace_id"),
        (F.col("c_custkey") % 3).cast("int").alias("profile_id"))
    rp = fixed_table(t.spark, ["role_id", "permission"], [(r, p) for r, ps in _ROLE.items() for p in ps])
    pp = fixed_table(t.spark, ["profile_id", "permission"], [(r, p) for r, ps in _PROFILE.items() for p in ps])
    return tn.effective_permissions(roles, rp, profiles, pp)


@query("effective_permissions", f"WITH {_PERM_SQL} SELECT user_id, workspace_id::BIGINT AS workspace_id, permission FROM e")
def effective_permissions(t: Tables):
    return _permissions(t).withColumn("workspace_id", F.col("workspace_id").cast("long"))


# How many pending tasks each user may act on. The pairs are counted per
# (workspace, permission), never listed: a workspace's users times its tasks
# would grow with the square of the data.
@query("actionable_tasks", f"""
WITH {_PERM_SQL}, tk AS (SELECT o_orderkey AS task_id, c_nationkey AS workspace_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'task.approve' WHEN '2-HIGH' THEN 'task.execute' ELSE 'task.view' END AS required_permission,
  CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE 'approved' END AS approval_status FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT e.user_id, count(DISTINCT task_id)::BIGINT AS n_tasks FROM e JOIN tk ON permission = required_permission
  AND (e.workspace_id IS NULL OR e.workspace_id = tk.workspace_id) WHERE approval_status = 'pending' GROUP BY e.user_id
""")
def actionable_tasks(t: Tables):
    need = (F.when(F.col("o_orderpriority") == "1-URGENT", "task.approve")
            .when(F.col("o_orderpriority") == "2-HIGH", "task.execute").otherwise("task.view"))
    tasks = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("task_id"), F.col("c_nationkey").alias("workspace_id"),
        need.alias("required_permission"),
        F.when(F.col("o_orderstatus") == "P", "pending").otherwise("approved").alias("approval_status"))
    return tn.actionable_task_counts(tasks, _permissions(t))


@query("action_allowed", """
SELECT event_id, (CASE WHEN event_type IN ('view', 'click', 'error') AND NOT (event_type = 'error' OR user_id % 10 = 0 AND event_type = 'click')
  THEN 1 ELSE 0 END)::BIGINT AS allowed FROM events
""")
def action_allowed(t: Tables):
    words = lambda *ws: F.array(*[F.lit(w) for w in ws])
    blocked = F.when(F.col("user_id") % 10 == 0, words("error", "click")).otherwise(words("error"))
    ok = tn.action_allowed(words("view", "click", "error"), blocked, F.col("event_type"))
    return t.events.select("event_id", F.when(ok, 1).otherwise(0).cast("long").alias("allowed"))


@query("due_tasks", """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1998-01-01 00:00:00'
""")
def due_tasks(t: Tables):
    tasks = t.orders.select("o_orderkey", F.col("o_orderdate").alias("next_run"),
                            F.when(F.col("o_orderstatus") == "O", "active").otherwise("paused").alias("status"))
    return tn.due_tasks(tasks, F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'")).select("o_orderkey")


@query("plan_limits", f"""
WITH pf(plan_code, feature_code) AS (VALUES {', '.join(f"('{p}', '{f}')" for p, fs in fv.PLAN_FEATURES.items() for f in fs)}),
s AS (SELECT c_custkey AS workspace_id, CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'starter' WHEN 1 THEN 'operational'
  WHEN 2 THEN 'premium_erp' ELSE 'enterprise_custom' END AS plan_code FROM customer WHERE c_acctbal > 0),
e AS (SELECT workspace_id, plan_code, feature_code, CASE plan_code WHEN 'starter' THEN 5 WHEN 'operational' THEN 10 WHEN 'premium_erp' THEN 15 END AS max_value
  FROM s JOIN pf USING (plan_code)),
u AS (SELECT o_custkey AS workspace_id, CASE o_orderstatus WHEN 'F' THEN 'diagnosis.basic' WHEN 'O' THEN 'rag.simple' ELSE 'erp.assisted' END AS feature_code,
  count(*) AS used FROM orders GROUP BY ALL)
SELECT workspace_id, feature_code, max_value::BIGINT AS max_value, coalesce(used, 0)::BIGINT AS used,
 CASE WHEN max_value IS NULL THEN 'unlimited' WHEN coalesce(used, 0) > max_value THEN 'exceeded' WHEN coalesce(used, 0) = max_value THEN 'at_limit' ELSE 'ok' END AS state
FROM e LEFT JOIN u USING (workspace_id, feature_code)
""")
def plan_limits(t: Tables):
    n = F.col("c_custkey") % 4
    plan = (F.when(n == 0, "starter").when(n == 1, "operational").when(n == 2, "premium_erp").otherwise("enterprise_custom"))
    subs = t.customer.select(F.col("c_custkey").alias("workspace_id"), plan.alias("plan_code"),
                             F.when(F.col("c_acctbal") > 0, "active").otherwise("ended").alias("status"))
    limits = {"starter": 5, "operational": 10, "premium_erp": 15}
    features = fixed_table(t.spark, ["plan_code", "feature_code", "max_value"],
                           [(p, f, limits.get(p)) for p, fs in fv.PLAN_FEATURES.items() for f in fs])
    feature = (F.when(F.col("o_orderstatus") == "F", "diagnosis.basic").when(F.col("o_orderstatus") == "O", "rag.simple")
               .otherwise("erp.assisted"))
    usage = t.orders.groupBy(F.col("o_custkey").alias("workspace_id"), feature.alias("feature_code")).agg(
        F.count(F.lit(1)).alias("used"))
    out = tn.limit_state(tn.entitlements(subs, features), usage)
    return out.withColumn("max_value", F.col("max_value").cast("long"))


RULES = [
    (1, 10, "view", "keyword", "9", "team_a", "2024-01-01 00:00:00", "2024-01-15 00:00:00"),
    (2, 20, "view", "any", None, "team_b", "2024-01-05 00:00:00", None),
    (3, 5, "click", "sender", "7", "team_c", None, None),
    (4, 30, "click", "any", None, "team_d", "2024-01-10 00:00:00", "2024-01-20 00:00:00"),
    (5, 10, "purchase", "any", None, "team_e", None, None),
    (6, 10, "purchase", "any", None, "team_f", None, None),
]


def rules(t: Tables):
    cols = ["rule_id", "priority", "channel_id", "match_type", "match_value", "target", "active_from", "active_to"]
    return fixed_table(t.spark, cols, RULES).withColumns(
        {c: F.to_timestamp_ntz(c) for c in ("active_from", "active_to")})


def messages(t: Tables):
    return t.events.select(F.col("event_id").alias("message_id"), F.col("event_type").alias("channel_id"),
                           F.col("user_id").cast("string").alias("sender"), F.col("props").alias("body"), "ts")


_RULE_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in RULES)


@query("routing_match", f"""
WITH r(rule_id, priority, channel_id, match_type, match_value, target, f, u) AS (VALUES {_RULE_VALUES}),
m AS (SELECT event_id, rule_id, target, row_number() OVER (PARTITION BY event_id ORDER BY priority, rule_id) AS n FROM events JOIN r ON channel_id = event_type
 AND (f IS NULL OR f::TIMESTAMP <= ts) AND (u IS NULL OR ts < u::TIMESTAMP) AND (match_type = 'any' OR match_type = 'sender' AND match_value = user_id::VARCHAR
 OR match_type = 'keyword' AND contains(props, match_value)))
SELECT e.event_id AS message_id, rule_id::BIGINT AS rule_id, target, CASE WHEN rule_id IS NULL THEN 'missed' ELSE 'matched' END AS routing
FROM events e LEFT JOIN (SELECT * FROM m WHERE n = 1) x USING (event_id)
""")
def routing_match(t: Tables):
    out = tn.route(messages(t), rules(t), "ts")
    return out.select("message_id", F.col("rule_id").cast("long").alias("rule_id"), "target", "routing")


@query("channel_resolve", """
WITH c AS (SELECT n_nationkey AS channel_id, n_name AS alias FROM nation WHERE n_regionkey <> 3),
num AS (SELECT s_nationkey AS channel_id, max(s_suppkey) AS number_id FROM supplier GROUP BY ALL),
cred AS (SELECT s_nationkey AS channel_id, s_suppkey AS credential_id, CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'workspace' WHEN 1 THEN 'platform' ELSE 'test' END AS scope FROM supplier),
best AS (SELECT channel_id, credential_id, scope, row_number() OVER (PARTITION BY channel_id ORDER BY CASE scope WHEN 'workspace' THEN 1 ELSE 2 END, credential_id) AS r FROM cred WHERE scope <> 'test')
SELECT o_orderkey AS send_id, c.channel_id::BIGINT AS channel_id, number_id, credential_id, scope AS credential_scope
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN c ON alias = n_name
 LEFT JOIN num ON num.channel_id = c.channel_id LEFT JOIN best ON best.channel_id = c.channel_id AND r = 1
""")
def channel_resolve(t: Tables):
    sends = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(
        t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("o_orderkey").alias("send_id"), F.col("n_name").alias("alias"))
    channels = t.nation.where("n_regionkey <> 3").select(
        F.col("n_name").alias("alias"), F.col("n_nationkey").cast("long").alias("channel_id"))
    numbers = t.supplier.groupBy(F.col("s_nationkey").cast("long").alias("channel_id")).agg(F.max("s_suppkey").alias("number_id"))
    n = F.col("s_suppkey") % 3
    creds = t.supplier.select(
        F.col("s_nationkey").cast("long").alias("channel_id"), F.col("s_suppkey").alias("credential_id"),
        F.when(n == 0, "workspace").when(n == 1, "platform").otherwise("test").alias("credential_scope"))
    best = tn.best_by_preference(creds, ["channel_id"], "credential_scope", ["workspace", "platform"], "credential_id")
    return sends.join(channels, "alias", "left").join(numbers, "channel_id", "left").join(best, "channel_id", "left").select(
        "send_id", "channel_id", "number_id", "credential_id", "credential_scope")


@query("inbound_resolve", """
SELECT event_id, c_custkey AS channel_id, c_nationkey::BIGINT AS workspace_id, CASE WHEN c_custkey IS NULL THEN 'missed' ELSE 'matched' END AS binding
FROM events LEFT JOIN customer ON c_custkey = user_id AND c_acctbal > 0
""")
def inbound_resolve(t: Tables):
    bindings = t.customer.where("c_acctbal > 0").select(
        F.col("c_custkey").alias("channel_id"), F.col("c_nationkey").cast("long").alias("workspace_id"))
    return t.events.join(bindings, F.col("channel_id") == F.col("user_id"), "left").select(
        "event_id", "channel_id", "workspace_id",
        F.when(F.col("channel_id").isNull(), "missed").otherwise("matched").alias("binding"))


@query("fallback_order", """
WITH p AS (SELECT c_custkey AS policy_id, [c_nationkey, (c_nationkey + 7) % 25, 99] AS f FROM customer),
x AS (SELECT policy_id, unnest(f) AS profile_id, unnest([0, 1, 2]) AS position FROM p)
SELECT policy_id, position::BIGINT AS position, n_name AS profile_name FROM x LEFT JOIN nation ON n_nationkey = profile_id
""")
def fallback_order(t: Tables):
    policies = t.customer.select(F.col("c_custkey").alias("policy_id"), F.array(
        F.col("c_nationkey"), ((F.col("c_nationkey") + 7) % 25).cast("int"), F.lit(99)).alias("fallback_profiles"))
    profiles = t.nation.select(F.col("n_nationkey").alias("profile_id"), F.col("n_name").alias("profile_name"))
    return tn.fallback_rows(policies, profiles).select("policy_id", F.col("position").cast("long").alias("position"), "profile_name")


@query("policy_resolve", """
SELECT o_orderkey AS automation_id, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_custkey % 10 END, CASE WHEN c_acctbal > 0 THEN 100 + c_nationkey END)::BIGINT AS profile_id,
 coalesce(CASE WHEN o_orderstatus = 'F' THEN 'workspace_first' END, CASE WHEN c_acctbal > 0 THEN 'platform_only' END, 'platform') AS key_scope,
 CASE WHEN o_orderstatus = 'F' THEN 'automation' WHEN c_acctbal > 0 THEN 'workspace' ELSE 'none' END AS policy_source
FROM orders JOIN customer ON c_custkey = o_custkey
""")
def policy_resolve(t: Tables):
    autos = t.orders.select(F.col("o_orderkey").alias("automation_id"), F.col("o_custkey").alias("workspace_id"))
    policies = t.orders.where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("automation_id"), (F.col("o_custkey") % 10).alias("profile_id"),
        F.lit("workspace_first").alias("key_scope"))
    defaults = t.customer.where("c_acctbal > 0").select(
        F.col("c_custkey").alias("workspace_id"), (F.col("c_nationkey") + 100).cast("long").alias("profile_id"),
        F.lit("platform_only").alias("key_scope"))
    return tn.model_policy(autos, policies, defaults).select("automation_id", "profile_id", "key_scope", "policy_source")


@query("scope_default", """
WITH b AS (SELECT c_custkey AS id, c_nationkey FROM customer WHERE c_acctbal > 3000), w AS (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0)
SELECT c.c_custkey AS entity_id, CASE WHEN b.id IS NOT NULL THEN 'scope-' || b.id WHEN n_nationkey IS NOT NULL THEN 'ws-' || n_nationkey END AS scope_id
FROM customer c LEFT JOIN b ON b.id = c.c_custkey LEFT JOIN w ON n_nationkey = c.c_nationkey
""")
def scope_default(t: Tables):
    entities = t.customer.select(
        F.lit("package_worker").alias("entity_type"), F.col("c_custkey").alias("entity_id"),
        F.col("c_nationkey").cast("long").alias("workspace_id"))
    own = t.customer.select(
        F.lit("package_worker").alias("binding_type"), F.col("c_custkey").alias("bound_entity_id"),
        F.concat(F.lit("scope-"), "c_custkey").alias("scope_id"), (F.col("c_acctbal") > 3000).alias("is_default"))
    spaces = t.nation.select(
        F.lit("workspace").alias("binding_type"), F.col("n_nationkey").cast("long").alias("bound_entity_id"),
        F.concat(F.lit("ws-"), "n_nationkey").alias("scope_id"), (F.col("n_nationkey") % 2 == 0).alias("is_default"))
    return tn.default_scope(entities, own.unionByName(spaces), ["workspace"]).select("entity_id", "scope_id")
