"""Catalog sync: documents from joined sources, chunks, run metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opsloom import fixed_values as fv
from opsloom.functions import text as tx
from opsloom.functions.chunking import line_chunks
from opsloom.functions.jsonx import labelled_json
from opsloom.operators import keyed
from opsloom.session import cut_lineage
from opsloom.sources.keyed_table import BUCKETS, EventLog, KeyedTable

#: What names a unit, the key of most values first: sorts compare by the first column's first bytes.
UNIT_KEYS = ("unit_id", "project_code", "workspace_id")
SOURCE_KEYS = ("source_system", "source_entity_type", "source_entity_key", "target_channel")


def _lines(df: DataFrame, title: Column, layout: list[tuple[str, str, str]]) -> Column:
    """Body text: the title line, then every labelled line that has a value.

    ``layout`` lists (label, column, "text" or "json"); NULL lines are skipped.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = [title]
    for label, column, kind in layout:
        if column not in kinds:
            continue
        value = F.col(column)
        parts.append(
            labelled_json(label, value, kinds[column]) if kind == "json"
            else tx.labelled_line(label, value)
        )
    return F.concat_ws("\n", *parts)


# Labels are fixed values of the document bodies, in line order.
PROJECT_LINES = [
    ("Codigo", "project_code", "text"), ("Estado", "project_status", "text"),
    ("Descripcion", "project_description", "text"), ("Ubicacion", "location", "json"),
    ("Tags", "project_tags", "json"), ("Desarrolladora", "developer_name", "text"),
    ("Amenidades", "amenities", "json"), ("Construccion", "construction", "json"),
    ("Financiacion", "financing", "json"), ("Inventario", "inventory_scope_label", "text"),
    ("Inventario completo", "inventory_is_complete", "text"),
    ("Resumen inventario", "status_breakdown", "json"),
    ("Advertencias de uso", "usage_warnings", "json"),
    ("Advertencias familia", "child_safety_warnings", "json"),
    ("Perfiles recomendados", "recommended_profiles", "json"),
    ("Assets marketing", "marketing_assets", "json"), ("Fuentes", "source_urls", "json"),
]
UNIT_LINES = [
    ("Proyecto", "project_code", "text"), ("Tipologia", "typology", "text"),
    ("Ambientes", "rooms_label", "text"), ("Dormitorios", "bedrooms", "text"),
    ("Banios", "bathrooms", "text"), ("Superficie total m2", "surface_total_m2", "text"),
    ("Superficie cubierta m2", "surface_covered_m2", "text"), ("Precio", "price_text", "text"),
    ("Disponibilidad", "availability_status", "text"), ("Features", "features", "json"),
    ("Orientacion", "orientation", "text"), ("Exposicion", "exposure", "text"),
    ("Vista", "view_text", "text"), ("Luz natural", "natural_light", "text"),
    ("Ventilacion cruzada", "cross_ventilation", "text"), ("Apto chicos", "children_suitable", "text"),
    ("Mascotas", "pets_allowed", "text"),
    ("Restricciones mascotas", "pets_restrictions_text", "text"), ("Patio", "has_patio", "text"),
    ("Jardin", "has_garden", "text"), ("Advertencias de uso", "usage_warnings", "json"),
    ("Advertencias familia", "child_safety_warnings", "json"),
    ("Features comerciales", "commercial_features", "json"),
    ("Perfiles recomendados", "recommended_profiles", "json"), ("Fuentes", "source_urls", "json"),
]
CAMPAIGN_LINES = [
    ("Proyecto", "project_code", "text"), ("Canal origen", "channel", "text"),
    ("Copy", "short_copy", "text"), ("Chips", "chips", "json"),
    ("WhatsApp prefill", "whatsapp_prefill", "text"), ("Activa", "is_active", "text"),
]


def ordered_assets(assets: DataFrame) -> DataFrame:
    """Assets of each project as one list by sort order.

    Aggregated before the join, so project columns are never grouped on. The
    list becomes one line of one document, so assets are expected to be
    distinct offers (a project and channel each), not raw activity.
    """
    item = F.struct("channel", "title", "short_copy")
    return assets.groupBy("project_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("sort_order", item.alias("item")))),
            lambda s: s["item"],
        ).alias("marketing_assets")
    )


def project_documents(projects: DataFrame, developers: DataFrame, facts: DataFrame,
                      profiles: DataFrame, assets: DataFrame, channel: str) -> DataFrame:
    """One document per project and matching fact and profile row."""
    rows = (
        projects.join(developers, "developer_id", "left")
        .join(facts, "project_code", "left")
        .join(profiles, "project_code", "left")
        .join(ordered_assets(assets), "project_id", "left")
    )
    title = F.concat(F.lit("Proyecto: "), tx.clean(F.col("project_name")))
    return rows.select(
        F.lit("project").alias("source_entity_type"),
        F.col("project_code").alias("source_entity_key"),
        F.col("workspace_id").alias("source_workspace_id"),
        F.col("project_code").alias("source_project_code"),
        F.lit(channel).alias("target_channel"), F.lit("catalog").alias("target_entity_type"),
        F.col("project_name").alias("title"), _lines(rows, title, PROJECT_LINES).alias("body_text"),
    )


def unit_documents(units: DataFrame, projects: DataFrame, profiles: DataFrame,
                   channel: str) -> DataFrame:
    """One document per unit of a known project, with its profile if any."""
    names = projects.select("project_code", "project_name")
    rows = units.join(names, "project_code").join(
        profiles, list(UNIT_KEYS), "left"
    )
    number = F.coalesce(F.nullif("unit_code", F.lit("")), "unit_id")
    rows = rows.withColumn(
        "price_text",
        F.concat_ws(" ", F.coalesce("currency", F.lit("")), F.coalesce(F.col("list_price").cast("string"), F.lit(""))),
    )
    title = F.concat(F.lit("Unidad: "), tx.clean(F.col("project_name")), F.lit(" "), number)
    return rows.select(
        F.lit("unit").alias("source_entity_type"),
        F.concat_ws(":", "project_code", "unit_id").alias("source_entity_key"),
        F.col("workspace_id").alias("source_workspace_id"),
        F.col("project_code").alias("source_project_code"),
        F.lit(channel).alias("target_channel"), F.lit("offer").alias("target_entity_type"),
        F.concat_ws(" ", "project_name", number).alias("title"),
        _lines(rows, title, UNIT_LINES).alias("body_text"),
    )


def campaign_documents(assets: DataFrame, projects: DataFrame, facts: DataFrame,
                       channel: str) -> DataFrame:
    names = projects.select("project_id", "project_code")
    spaces = facts.select("project_code", "workspace_id")
    rows = assets.join(names, "project_id").join(spaces, "project_code", "left")
    title = F.concat(F.lit("Campania marketing: "), tx.clean(F.col("title")))
    return rows.select(
        F.lit("marketing_asset").alias("source_entity_type"),
        F.col("asset_id").alias("source_entity_key"),
        F.col("workspace_id").alias("source_workspace_id"),
        F.col("project_code").alias("source_project_code"),
        F.lit(channel).alias("target_channel"), F.lit("campaign").alias("target_entity_type"),
        F.concat_ws(" ", "project_code", "title").alias("title"),
        _lines(rows, title, CAMPAIGN_LINES).alias("body_text"),
    )


def all_documents(*families: DataFrame, source_system: str = "catalog") -> DataFrame:
    """Union of document families with their content hash."""
    out = families[0]
    for part in families[1:]:
        out = out.unionByName(part)
    return out.select(
        F.lit(source_system).alias("source_system"), "*",
        tx.content_hash(F.col("body_text")).alias("content_hash"),
    )


def changed_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """New or altered documents, by key (which may hold NULLs) and content hash: bodies are not moved."""
    return keyed.join_same(new, old.select(*SOURCE_KEYS, "content_hash"), [*SOURCE_KEYS, "content_hash"], "left_anti")


def source_id() -> Column:
    """Stable id of a source row from its natural key."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in SOURCE_KEYS]), 256)


def chunk_rows(documents: DataFrame, max_chars: int = fv.CATALOG_MAX_CHARS,
               overlap: int = fv.CATALOG_OVERLAP) -> DataFrame:
    """Chunk records of catalog documents."""
    cut = documents.select(
        source_id().alias("source_id"),
        F.posexplode(line_chunks(F.col("body_text"), max_chars, overlap)).alias("chunk_index", "chunk_text"),
    )
    body = F.col("chunk_text")
    return cut.select(
        "source_id", "chunk_index", F.lit("semantic").alias("chunk_kind"), "chunk_text",
        tx.token_estimate(body).alias("token_estimate"), tx.content_hash(body).alias("content_hash"),
    )


def run_metrics(documents: DataFrame, chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """Counters of a sync run: documents, chunks, embedded, skipped."""
    seen = documents.agg(F.count(F.lit(1)).alias("documents_seen"),
                         F.count_distinct(*SOURCE_KEYS).alias("documents_upserted"))
    known = embedded.select("content_hash").distinct().withColumn("has_vector", F.lit(True))
    counted = chunks.join(known, "content_hash", "left").agg(
        F.count(F.lit(1)).alias("chunks_upserted"),
        F.count("has_vector").alias("chunks_embedded"),
    )
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(seen).join(one(counted), "_one").drop("_one").withColumn(
        "embeddings_skipped", F.col("chunks_upserted") - F.col("chunks_embedded")
    )


DOCUMENT_SCHEMA = ("source_system string, source_entity_type string, source_entity_key string, target_channel string, "
                   "title string, body_text string, content_hash string")
CHUNK_SCHEMA = ("source_id string, chunk_index int, chunk_kind string, chunk_text string, token_estimate int, "
                "content_hash string")
RUN_SCHEMA = ("run_id long, status string, documents_seen long, documents_upserted long, documents_unchanged long, "
              "chunks_upserted long")


class Catalog:
    """Sources, their chunks and the log of sync runs, kept under one folder."""

    def __init__(self, spark: SparkSession, folder: str, documents: StructType | str = DOCUMENT_SCHEMA, buckets: int = BUCKETS):
        self.spark = spark
        self.sources = KeyedTable(spark, f"{folder}/sources", documents, SOURCE_KEYS, buckets)
        self.chunks = KeyedTable(spark, f"{folder}/chunks", CHUNK_SCHEMA, ["source_id"], buckets)
        self.runs = EventLog(spark, f"{folder}/runs", RUN_SCHEMA)

    def sync(self, documents: DataFrame, run_id: int, order: Sequence[str] = ()) -> None:
        """Bring a set of documents in and log the run; run ids rise.

        Of several rows of a document the last by ``order`` counts. Unchanged
        documents keep their row and chunks; buckets without a change keep
        their files. Chunks are committed before the sources that decide what
        has changed, so a run that is broken off anywhere is simply run again;
        one that is through changes nothing.
        """
        past = self.runs.read()
        if past.where((F.col("run_id") == run_id) & (F.col("status") == "completed")).limit(1).count():
            return
        try:
            row = (run_id, "completed", *self._sync(documents, run_id, order))
            self._log(row, "sync", run_id)
        except Exception:
            self._log((run_id, "failed", None, None, None, None), "failed sync", past.where("status = 'failed'").count())
            raise

    def _log(self, row: tuple, writer: str, sequence: int) -> None:
        self.runs.append(self.spark.createDataFrame([row], RUN_SCHEMA), writer, sequence)

    def _sync(self, documents: DataFrame, run_id: int, order: Sequence[str]) -> tuple[int, int, int, int]:
        wanted = list(dict.fromkeys([*self.sources.schema.fieldNames(), *order]))
        last = keyed.one_per_key(documents.select(*wanted), SOURCE_KEYS, order).select(*self.sources.schema.fieldNames())
        touched = cut_lineage(changed_documents(self.sources.read(), last))
        fresh = cut_lineage(chunk_rows(touched))
        changed = touched.count()
        self.chunks.replace(touched.select(source_id().alias("source_id")), fresh, "sync", run_id)
        self.sources.upsert(touched, writer="sync", sequence=run_id, once=True)
        # Bodies are written once, with what has changed; the others are counted by their keys.
        keys = documents.select(*SOURCE_KEYS).distinct().count()
        return documents.count(), changed, keys - changed, fresh.count()
