"""Tenants: who sees which rows, permissions, plans, routing, console counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.operators.keyed import first_n
from opsloom.operators.ranges import as_of, elementary_ranges


def visible(rows: DataFrame, access: DataFrame, key: str = "workspace_id") -> DataFrame:
    """Rows whose tenant is in the access set."""
    return rows.join(access.select(key).distinct(), key, "left_semi")


def visible_services(services: DataFrame, access: DataFrame, depth: str) -> DataFrame:
    """Tenant filter; the business depth also hides internal services."""
    picked = visible(services, access)
    return picked.where("visible_to_client") if depth == "business" else picked


def narrow_to_active(rows: DataFrame, audience: str, active_workspace: str) -> DataFrame:
    """Clients see only the active workspace."""
    return rows.where(F.col("workspace_id") == active_workspace) if audience == "client" else rows


def is_open(status: str, closed: str) -> Column:
    return F.col(status) != closed


def in_force(start: Column, end: Column, at: Column) -> Column:
    """``start <= at < end``; NULL bounds are open."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (at < end))


def visible_users(users: DataFrame, memberships: DataFrame, organisations: DataFrame,
                  workspaces: DataFrame) -> DataFrame:
    """Users of an accessible organisation or of any shared workspace.

    The OR becomes two semi joins and a union, both plain equi joins.
    """
    by_org = users.join(organisations, "organisation_id", "left_semi")
    members = memberships.join(workspaces, "workspace_id", "left_semi").select("user_id")
    by_space = users.join(members, "user_id", "left_semi")
    return by_org.unionByName(by_space).distinct()


def with_default(rows: DataFrame, dim: DataFrame, key: str, name: str, default: str) -> DataFrame:
    """Lookup with a default text when the key is unknown."""
    return rows.join(dim.select(key, name), key, "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(default)))


def access_mode(members: DataFrame) -> DataFrame:
    """``own`` when user and workspace share the organisation, else ``delegated``."""
    own = F.col("user_organisation") == F.col("workspace_organisation")
    return members.withColumn("access_mode", F.when(own, "own").otherwise("delegated")).withColumn(
        "delegated_by", F.when(~own, F.col("user_organisation")))


def audience(permissions: Column, organisation_type: Column, owner_type: str = "owner") -> Column:
    """Console audience: first matching test wins."""
    return (
        F.when(F.array_contains(permissions, "organizations.read"), "owner")
        .when(organisation_type == owner_type, "operator")
        .when(F.array_contains(permissions, "organizations.read_descendants"), "partner")
        .otherwise("client")
    )


def registry_visible(item: dict[str, Column], user: dict[str, Column]) -> Column:
    """Whether a menu entry shows: every condition that the entry sets must hold."""
    free = lambda c: c.isNull() | (F.size(c) == 0)
    return (
        F.array_contains(item["audiences"], user["audience"])
        & F.array_contains(user["modules"], item["module"])
        & (free(item["permissions_any"]) | F.arrays_overlap(item["permissions_any"], user["permissions"]))
        & (item["organisation_types"].isNull()
           | F.array_contains(item["organisation_types"], user["organisation_type"]))
        & (~item["requires_workspace"] | user["workspace_id"].isNotNull())
        & (~item["requires_services"] | (user["n_services"] > 0))
    )


def effective_permissions(user_roles: DataFrame, role_permissions: DataFrame,
                          user_profiles: DataFrame, profile_permissions: DataFrame) -> DataFrame:
    """(user, workspace, permission) through roles and through profiles, once each.

    A NULL workspace is a global grant.
    """
    by_role = user_roles.join(role_permissions, "role_id").select("user_id", "workspace_id", "permission")
    by_profile = user_profiles.join(profile_permissions, "profile_id").select(
        "user_id", "workspace_id", "permission")
    return by_role.unionByName(by_profile).distinct()


def actionable_tasks(tasks: DataFrame, permissions: DataFrame, user_id: object) -> DataFrame:
    """Pending tasks one user may act on.

    Global grants join on the permission alone, scoped ones also on workspace.
    """
    pending = tasks.where("approval_status = 'pending'")
    grants = permissions.where(F.col("user_id") == user_id).withColumnRenamed("permission", "required_permission")
    everywhere = pending.join(grants.where("workspace_id IS NULL").drop("workspace_id"), "required_permission")
    scoped = pending.join(grants.where("workspace_id IS NOT NULL"), ["workspace_id", "required_permission"])
    pair = ["user_id", "task_id"]
    return everywhere.select(*pair).unionByName(scoped.select(*pair)).distinct()


def actionable_task_counts(tasks: DataFrame, permissions: DataFrame) -> DataFrame:
    """Number of pending tasks each user may act on.

    Tasks are counted per (workspace, permission) before users join, so the
    work grows with tasks plus grants, not with their product. A user with a
    global and a scoped grant of one permission counts those tasks once.
    """
    per_space = tasks.where("approval_status = 'pending'").groupBy(
        "workspace_id", F.col("required_permission").alias("permission")
    ).agg(F.count(F.lit(1)).alias("n"))
    per_permission = per_space.groupBy("permission").agg(F.sum("n").alias("n"))
    everywhere = permissions.where("workspace_id IS NULL").select("user_id", "permission").distinct()
    scoped = permissions.where("workspace_id IS NOT NULL").join(
        everywhere, ["user_id", "permission"], "left_anti")
    counted = everywhere.join(per_permission, "permission").select("user_id", "n").unionByName(
        scoped.join(per_space, ["workspace_id", "permission"]).select("user_id", "n"))
    return counted.groupBy("user_id").agg(F.sum("n").alias("n_tasks"))


def action_allowed(allowed: Column, blocked: Column, action: Column) -> Column:
    return F.array_contains(allowed, action) & ~F.array_contains(blocked, action)


def due_tasks(tasks: DataFrame, at: Column) -> DataFrame:
    return tasks.where((F.col("status") == "active") & (F.col("next_run") <= at))


def entitlements(subscriptions: DataFrame, plan_features: DataFrame) -> DataFrame:
    """Features of the active subscription of each workspace."""
    active = subscriptions.where("status = 'active'")
    return active.join(plan_features, "plan_code").select("workspace_id", "plan_code", "feature_code", "max_value")


def limit_state(entitled: DataFrame, usage: DataFrame) -> DataFrame:
    """Use of each entitled feature against its limit; a NULL limit is unlimited."""
    used = F.coalesce(F.col("used"), F.lit(0))
    return entitled.join(usage, ["workspace_id", "feature_code"], "left").select(
        "workspace_id", "feature_code", "max_value", used.alias("used"),
        F.when(F.col("max_value").isNull(), "unlimited").when(used > F.col("max_value"), "exceeded")
        .when(used == F.col("max_value"), "at_limit").otherwise("ok").alias("state"),
    )


#: Longest piece of a keyword that rules are indexed by.
GRAM = 3
#: Days of a bucket in which messages meet the rules in force.
RULE_DAYS = 7


def _keyword_index(rules: DataFrame) -> DataFrame:
    """Keyword rules, each under the piece of its keyword that fewest rules of the channel hold."""
    size = F.least(F.length("match_value"), F.lit(GRAM))
    starts = F.sequence(F.lit(1), F.length("match_value") - size + 1)
    pieces = rules.withColumn("_size", size).withColumn(
        "_grams", F.array_distinct(F.transform(starts, lambda i: F.substring("match_value", i, F.col("_size")))))
    each = pieces.select("channel_id", "rule_id", F.explode("_grams").alias("_gram"))
    common = each.groupBy("channel_id", "_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = each.join(common, ["channel_id", "_gram"]).groupBy("rule_id").agg(F.min(F.struct("_n", "_gram")).getField("_gram").alias("_gram"))
    return pieces.join(rarest, "rule_id").drop("_grams")


def route(messages: DataFrame, rules: DataFrame, at: str) -> DataFrame:
    """First routing rule per message by (priority, rule_id): same channel, rule in force, type matches.

    Rules are taken apart by type. Those for any message, and those for one
    sender, become pieces of time with one winner each, so a message meets at
    most one of either. Keyword rules are indexed by a rare piece of their
    keyword, which a message's own pieces are joined to; the keyword itself is
    then looked for in the body. The least of the candidates wins. message_id
    is unique; a message without body or sender meets no such rule.
    """
    kinds = rules.where(F.col("channel_id").isNotNull()).withColumn(
        "_kind", F.when((F.col("match_type") == "keyword") & (F.col("match_value") == ""), "any").otherwise(F.col("match_type")))
    carried = ["priority", "rule_id", "target", "active_from", "active_to"]

    def won(kind: str, *keys: str) -> DataFrame:
        chosen = kinds.where(F.col("_kind") == kind).withColumn("sender", F.col("match_value"))
        pieces = elementary_ranges(chosen.select(*keys, *carried), keys, "active_from", "active_to", ["priority", "rule_id"], open_start=True)
        return as_of(messages.select("message_id", "channel_id", "sender", at), at, pieces, keys, "active_from", "active_to", "inner", RULE_DAYS)

    index = _keyword_index(kinds.where((F.col("_kind") == "keyword") & F.col("match_value").isNotNull()))
    grams = [F.regexp_extract_all("body", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, GRAM + 1)]
    wanted = {r[0] for r in index.select("_size").distinct().collect()}
    used = [g for n, g in enumerate(grams, 1) if n in wanted]
    found = [won("any", "channel_id"), won("sender", "channel_id", "sender")]
    if used:
        pieces = messages.select("message_id", "channel_id", "body", at, F.explode(F.array_distinct(F.concat(*used))).alias("_gram"))
        rule = index.select("channel_id", "_gram", "match_value", *carried)
        found.append(pieces.join(rule, ["channel_id", "_gram"]).where(
            F.col("body").contains(F.col("match_value")) & in_force(F.col("active_from"), F.col("active_to"), F.col(at))))
    best = None
    for part in found:
        part = part.select("message_id", F.struct("priority", "rule_id", "target").alias("_best"))
        best = part if best is None else best.unionByName(part)
    best = best.groupBy("message_id").agg(F.min("_best").alias("_best"))
    return messages.join(best, "message_id", "left").select(
        "message_id", "channel_id", F.col("_best.rule_id").alias("rule_id"), F.col("_best.target").alias("target"),
        F.when(F.col("_best").isNull(), "missed").otherwise("matched").alias("routing"))


def best_by_preference(candidates: DataFrame, keys: Sequence[str], preference: str,
                       order: Sequence[str], tie: str) -> DataFrame:
    """Best candidate per key by a list of preferred values, then the tie column."""
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(preference))
    usable = candidates.withColumn("_r", rank).where("_r > 0")
    return first_n(usable, keys, [F.col("_r").asc(), F.col(tie).asc()], 1, "_n").drop("_r", "_n")


def model_policy(automations: DataFrame, policies: DataFrame, defaults: DataFrame) -> DataFrame:
    """Automation policy if there is one, else the workspace default."""
    own = policies.select("automation_id", F.col("profile_id").alias("_own"),
                          F.col("key_scope").alias("_scope"))
    base = defaults.select("workspace_id", F.col("profile_id").alias("_base"),
                           F.col("key_scope").alias("_base_scope"))
    return (
        automations.join(own, "automation_id", "left").join(base, "workspace_id", "left")
        .select("automation_id", "workspace_id",
                F.coalesce("_own", "_base").alias("profile_id"),
                F.coalesce("_scope", "_base_scope", F.lit("platform")).alias("key_scope"),
                F.when(F.col("_own").isNotNull(), "automation").when(F.col("_base").isNotNull(), "workspace")
                .otherwise("none").alias("policy_source"))
    )


def fallback_rows(policies: DataFrame, profiles: DataFrame) -> DataFrame:
    """Fallback list of each policy as ordered rows."""
    listed = policies.select("policy_id", F.posexplode("fallback_profiles").alias("position", "profile_id"))
    return listed.join(profiles, "profile_id", "left")


def default_scope(entities: DataFrame, bindings: DataFrame, fallback: Sequence[str] = ()) -> DataFrame:
    """Default knowledge scope per entity.

    An entity's own default binding wins; ``fallback`` may name further binding
    types to try with the entity's workspace, in order (none by default).
    """
    defaults = bindings.where("is_default").select(
        "binding_type", F.col("bound_entity_id"), "scope_id")
    out = entities.join(
        defaults.withColumnRenamed("bound_entity_id", "entity_id")
        .withColumnRenamed("binding_type", "entity_type"), ["entity_type", "entity_id"], "left")
    for kind in fallback:
        other = defaults.where(F.col("binding_type") == kind).select(
            F.col("bound_entity_id").alias("workspace_id"), F.col("scope_id").alias("_other"))
        out = out.join(other, "workspace_id", "left").withColumn(
            "scope_id", F.coalesce("scope_id", "_other")).drop("_other")
    return out


# Console counts ------------------------------------------------------------


def cards(counts: DataFrame, layout: dict[str, Sequence[str]]) -> DataFrame:
    """One row of counters to (audience, position, card, value) rows."""
    items = [
        F.struct(F.lit(group).alias("audience"), F.lit(i + 1).alias("position"),
                 F.lit(name).alias("card"), F.col(name).cast("long").alias("value"))
        for group, names in layout.items() for i, name in enumerate(names)
    ]
    return counts.select(F.explode(F.array(*items)).alias("c")).select("c.*")


def child_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Children per parent including zero; counted before the join."""
    counted = children.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def bundle_children(parents: DataFrame, key: str, families: dict[str, tuple[DataFrame, str]],
                    n: int) -> DataFrame:
    """Detail page of a parent: per child family its count and first ``n`` ids.

    Lists are cut to ``n`` before they are collected, so they stay short
    whatever the number of children.
    """
    out = parents
    for name, (rows, order) in families.items():
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        firsts = first_n(rows.select(key, order), [key], [F.col(order).asc()], n, "_r").groupBy(key).agg(
            F.array_sort(F.collect_list(order)).alias(f"first_{name}"))
        out = out.join(counts, key, "left").join(firsts, key, "left").withColumn(
            f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out


def grouped_in_order(rows: DataFrame, kinds: DataFrame, key: str) -> DataFrame:
    """Counts per kind in the fixed section order of ``kinds(key, section_order)``."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(counts, key).withColumn("section", F.row_number().over(W.orderBy("section_order")))
