"""Data-quality rules: declared once, evaluated in one scan per table.

Every check yields a row (check_id, table_name, severity, violations, status).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.operators.keyed import duplicates, orphans


@dataclass(frozen=True)
class RowRule:
    """A condition every row must meet; NULL counts as met, as in a CHECK."""

    check_id: str
    condition: str
    severity: str = "failed"


@dataclass(frozen=True)
class TableRules:
    table: str
    rows: tuple[RowRule, ...] = ()
    unique: tuple[tuple[str, tuple[str, ...], str | None], ...] = ()
    references: tuple[tuple[str, str, str, str], ...] = ()
    columns: tuple[str, ...] = field(default=())


def allowed(check_id: str, column: str, values: Sequence[str], severity: str = "failed") -> RowRule:
    listed = ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)
    return RowRule(check_id, f"{column} IN ({listed})", severity)


def between(check_id: str, column: str, low: float | None = None, high: float | None = None,
            severity: str = "failed") -> RowRule:
    parts = ([f"{column} >= {low}"] if low is not None else []) + (
        [f"{column} <= {high}"] if high is not None else [])
    return RowRule(check_id, " AND ".join(parts), severity)


def _status(severity: Column, violations: Column) -> Column:
    return F.when(violations == 0, "passed").otherwise(severity)


def _result(df: DataFrame, check_id: str, table: str, severity: str = "failed",
            violations: Column | None = None) -> DataFrame:
    n = F.count(F.lit(1)) if violations is None else violations
    return df.agg(n.cast("long").alias("violations")).select(
        F.lit(check_id).alias("check_id"), F.lit(table).alias("table_name"),
        F.lit(severity).alias("severity"), "violations",
        _status(F.lit(severity), F.col("violations")).alias("status"))


def check_rows(df: DataFrame, table: str, rules: Sequence[RowRule]) -> DataFrame:
    """All row rules of a table from one scan and one aggregate row."""
    counts = df.agg(*[
        F.count_if(~F.coalesce(F.expr(r.condition), F.lit(True))).alias(r.check_id) for r in rules])
    items = F.array(*[
        F.struct(F.lit(r.check_id).alias("check_id"), F.lit(table).alias("table_name"),
                 F.lit(r.severity).alias("severity"), F.col(r.check_id).alias("violations"))
        for r in rules])
    return counts.select(F.explode(items).alias("c")).select(
        "c.*", _status(F.col("c.severity"), F.col("c.violations")).alias("status"))


def check_unique(df: DataFrame, table: str, check_id: str, keys: Sequence[str],
                 where: str | None = None) -> DataFrame:
    """Keys that occur more than once, optionally among the rows of a predicate."""
    picked = df.where(where) if where else df
    return _result(duplicates(picked, keys), check_id, table)


def check_reference(child: DataFrame, table: str, check_id: str, key: str, parent: DataFrame,
                    parent_key: str) -> DataFrame:
    return _result(orphans(child, key, parent, parent_key), check_id, table)


def check_columns(df: DataFrame, table: str, expected: Sequence[str]) -> DataFrame:
    """Expected columns that the table lacks; reads the schema, not the rows."""
    missing = sorted(set(expected) - set(df.columns))
    rows = df.sparkSession.range(1).select(F.lit(len(missing)).cast("long").alias("violations"))
    return rows.select(
        F.lit("columns_present").alias("check_id"), F.lit(table).alias("table_name"),
        F.lit("failed").alias("severity"), "violations",
        _status(F.lit("failed"), F.col("violations")).alias("status"))


def check_tenant(child: DataFrame, parent: DataFrame, on: str, table: str,
                 check_id: str = "tenant_match") -> DataFrame:
    """Child and parent must share a workspace; skipped when either side is empty."""
    pairs = child.select(on, F.col("workspace_id").alias("_c")).join(
        parent.select(on, F.col("workspace_id").alias("_p")), on)
    bad = pairs.where(F.col("_c") != F.col("_p")).agg(F.count(F.lit(1)).alias("violations"))
    sizes = child.select(F.lit("c").alias("side")).limit(1).unionByName(
        parent.select(F.lit("p").alias("side")).limit(1)).agg(F.count(F.lit(1)).alias("_sides"))
    one = F.lit(1)
    return bad.withColumn("_k", one).join(sizes.withColumn("_k", one), "_k").select(
        F.lit(check_id).alias("check_id"), F.lit(table).alias("table_name"),
        F.lit("warning").alias("severity"), "violations",
        F.when(F.col("_sides") < 2, "skipped").otherwise(_status(F.lit("warning"), F.col("violations")))
        .alias("status"))


BINDING_RULES = (
    RowRule("internal_with_target", "NOT (binding_type = 'internal' AND bound_entity_id IS NOT NULL)"),
    RowRule("target_missing",
            "NOT (binding_type IN ('workspace', 'assistant_instance', 'automation_package', "
            "'package_worker') AND bound_entity_id IS NULL)"),
    RowRule("workspace_target",
            "binding_type <> 'workspace' OR (bound_entity_id IS NOT NULL AND workspace_id IS NOT NULL "
            "AND bound_entity_id = workspace_id)"),
)


def check_bindings(bindings: DataFrame) -> DataFrame:
    """The binding convention and ambiguous defaults."""
    loose = bindings.where(
        "is_default AND bound_entity_id IS NULL AND binding_type IN "
        "('workspace', 'assistant_instance', 'automation_package', 'package_worker')")
    return check_rows(bindings, "knowledge_scope_bindings", BINDING_RULES).unionByName(
        _result(duplicates(loose, ["binding_type"]), "ambiguous_defaults", "knowledge_scope_bindings"))


def check_embeddings(embeddings: DataFrame, chunk_scopes: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Ready without vector, unknown status, repeated pair, scope unlike the document's."""
    table = "knowledge_chunk_embeddings"
    rules = (
        RowRule("ready_without_vector", "NOT (embedding_status = 'ready' AND embedding IS NULL)"),
        allowed("status_known", "embedding_status", statuses),
    )
    clash = embeddings.join(chunk_scopes.withColumnRenamed("scope_id", "_doc"), "chunk_id").where(
        F.col("scope_id") != F.col("_doc"))
    return union_all([
        check_rows(embeddings, table, rules),
        _result(duplicates(embeddings, ["chunk_id", "model_id"]), "pair_unique", table),
        _result(clash, "scope_match", table),
    ])


def check_seeds(actual: DataFrame, expected: DataFrame, key: str, table: str,
                values: Sequence[str] = ()) -> DataFrame:
    """Expected rows that are absent or, where values are named, differ."""
    known = actual.select(key, *[F.col(v).alias(f"_{v}") for v in values]).withColumn("_here", F.lit(True))
    joined = expected.join(known, key, "left")
    wrong = F.col("_here").isNull()
    for v in values:
        wrong = wrong | ~F.col(v).eqNullSafe(F.col(f"_{v}"))
    return _result(joined.where(wrong), "seed_rows", table)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def evaluate(tables: dict[str, DataFrame], rules: Sequence[TableRules]) -> DataFrame:
    """Run every declared rule; one scan per table for all its row rules."""
    parts = []
    for r in rules:
        df = tables[r.table]
        if r.rows:
            parts.append(check_rows(df, r.table, r.rows))
        parts += [check_unique(df, r.table, name, keys, where) for name, keys, where in r.unique]
        parts += [check_reference(df, r.table, name, key, tables[parent], parent_key)
                  for name, key, parent, parent_key in r.references]
        if r.columns:
            parts.append(check_columns(df, r.table, r.columns))
    return union_all(parts)


def rollup(results: DataFrame) -> DataFrame:
    """Passed, failed, warnings and skipped; overall fails when any check failed."""
    counts = results.agg(*[
        F.count_if(F.col("status") == s).alias(name)
        for s, name in (("passed", "passed"), ("failed", "failed"), ("warning", "warnings"), ("skipped", "skipped"))])
    return counts.withColumn("overall", F.when(F.col("failed") > 0, "failed").otherwise("passed"))


def delete_cascade(children: DataFrame, key: str, deleted: DataFrame, mode: str = "cascade") -> DataFrame:
    """Children after their parents are deleted: removed, unlinked or reported."""
    gone = deleted.select(key).distinct()
    if mode == "cascade":
        return children.join(gone, key, "left_anti")
    if mode == "restrict":
        return children.join(gone, key, "left_semi")
    marked = children.join(gone.withColumn("_gone", F.lit(True)), key, "left")
    return marked.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone").select(*children.columns)
