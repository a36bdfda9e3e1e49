"""Keyword, full-text, vector and hybrid retrieval with telemetry rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opsloom import fixed_values as fv
from opsloom.functions import text as tx
from opsloom.functions.binding import bind
from opsloom.functions.jsonx import merge_maps
from opsloom.operators.literals import lookup
from opsloom.operators.postings import best_chunks
from opsloom.operators.topk import top_k
from opsloom.sources.keyed_table import EventLog, KeyedTable


def optional_filters(df: DataFrame, **wanted: object) -> DataFrame:
    """Apply a filter only where its argument is given."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def in_scope(chunks: DataFrame, scope: str, mode: str | None = "rag",
             scope_column: str = "scope") -> DataFrame:
    """Chunks of one scope; mode ``none`` retrieves nothing, blank means rag."""
    picked = chunks.where(F.col(scope_column) == scope)
    return picked.limit(0) if (mode or "rag") == "none" else picked


def keyword_score(text: Column, query: str) -> Column:
    """Term counts of the query's tokens over their number; repeats count.

    One pass over the row's own tokens: no explode, no shuffle.
    """
    wanted = Counter(tx.query_tokens(query))
    total = sum(wanted.values())
    if not total:
        return F.lit(0.0)
    hits = F.filter(tx.tokens(text), lambda t: t.isin(*wanted))
    if set(wanted.values()) == {1}:
        weight = F.size(hits)
    else:
        weight = F.aggregate(hits, F.lit(0), lambda acc, t: acc + lookup(t, dict(wanted)))
    return weight / F.lit(float(total))


def keyword_top_k(chunks: DataFrame, query: str, text: Sequence[str], tie: Sequence[str],
                  k: int = fv.KEYWORD_TOP_K) -> DataFrame:
    """Best chunks for one query: score descending, then the tie columns."""
    if k < 0:
        raise ValueError("k must not be negative")
    k = k or fv.KEYWORD_TOP_K
    body = F.concat_ws(" ", *[F.col(c) for c in text])
    scored = chunks.withColumn("_s", keyword_score(body, query))
    order = [F.col("_s").desc(), *[F.col(c).asc() for c in tie]]
    # Zero scores sort last, so they are dropped after the cut: a filter before
    # it would be pushed into the scan and score every row twice.
    best = top_k(scored, order, k).where("_s > 0")
    return best.withColumn("score", F.bround("_s", 4)).drop("_s")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, token, qtf, n_tokens) of a table of queries."""
    listed = queries.select("query_id", tx.tokens(F.col("query_text")).alias("_t"))
    return (
        listed.select("query_id", F.size("_t").alias("n_tokens"), F.explode("_t").alias("token"))
        .groupBy("query_id", "token", "n_tokens")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def keyword_top_k_batch(chunks: DataFrame, queries: DataFrame, chunk_id: str, text: str,
                        k: int = fv.KEYWORD_TOP_K) -> DataFrame:
    """Best chunks for every query of a table, ties by chunk id. See ``operators.postings``."""
    terms = query_terms(queries)
    bodies = chunks.select(F.lit(0).alias("scope"), F.col(chunk_id).alias("chunk_id"), tx.tokens(F.col(text)).alias("tokens"))
    weighted = terms.select("query_id", F.lit(0).alias("scope"), "token", F.col("qtf").alias("weight"))
    best = best_chunks(bodies, weighted, k or fv.KEYWORD_TOP_K)
    sizes = terms.groupBy("query_id").agg(F.first("n_tokens").alias("_n"))
    return best.join(sizes, "query_id").select(
        "query_id", "chunk_id", F.bround(F.col("total") / F.col("_n"), 4).alias("score"), "rank_position")


def matches_all(text: Column, query: str) -> Column:
    """Every query token occurs in the text; a query without tokens matches nothing."""
    wanted = sorted(set(tx.query_tokens(query)))
    if not wanted:
        return F.lit(False)
    found = F.array_intersect(tx.tokens(text), F.array(*[F.lit(w) for w in wanted]))
    return F.size(found) == len(wanted)


def cover_density(text: Column, query: str) -> Column:
    """Cover-density score: each minimal passage holding every query term adds
    ``0.1 / (1 + noise words inside it)``.

    Word positions count every word, stopwords too. No stemming is applied.
    """
    wanted = sorted(set(tx.query_tokens(query)))
    if not wanted:
        return F.lit(0.0)
    number = {word: i for i, word in enumerate(wanted)}
    placed = F.transform(
        tx.all_words(text), lambda w, i: F.struct(i.alias("p"), lookup(w, number).alias("t"))
    )
    found = F.filter(placed, lambda h: h["t"].isNotNull())
    start = F.struct(
        F.array(*[F.lit(-1)] * len(wanted)).alias("seen"), F.lit(0.0).alias("score")
    )

    def total(hits: Column) -> Column:
        """Fold over hit numbers; ``seen`` keeps the last hit of each query word."""

        def step(state: Column, n: Column) -> Column:
            word = F.get(hits, n)["t"]
            before = F.get(state["seen"], word)

            def grow(seen: Column) -> Column:
                left = F.array_min(seen)
                # Minimal: complete, and not already complete before this word.
                minimal = (left >= 0) & (before < left)
                apart = F.get(hits, n)["p"] - F.get(hits, left)["p"]
                gain = F.lit(fv.COVER_WEIGHT) / (1 + apart - (n - left))
                return F.struct(
                    seen.alias("seen"),
                    (state["score"] + F.when(minimal, gain).otherwise(0.0)).alias("score"))

            return bind(
                F.transform(state["seen"], lambda last, i: F.when(i == word, n).otherwise(last)), grow)

        numbers = F.when(F.size(hits) > 0, F.sequence(F.lit(0), F.size(hits) - 1)).otherwise(
            F.array().cast("array<int>"))
        return F.aggregate(numbers, start, step, lambda s: s["score"])

    return bind(found, total)


def lexical_top_k(chunks: DataFrame, query: str, text: str, chunk_id: str,
                  k: int = fv.CATALOG_TOP_K, **filters: object) -> DataFrame:
    """Full-text search: AND match, cover density, ties by id descending."""
    picked = optional_filters(chunks, **filters).where(matches_all(F.col(text), query))
    scored = picked.withColumn("lexical_score", cover_density(F.col(text), query).cast("float"))
    return top_k(scored, [F.col("lexical_score").desc(), F.col(chunk_id).desc()], k)


def semantic_top_k(chunks: DataFrame, query_vec: Sequence[float], vec: str, chunk_id: str,
                   k: int = fv.CATALOG_TOP_K, **filters: object) -> DataFrame:
    """Exact vector search for one query: a projection and a bounded sort."""
    from opsloom.functions.vectors import cosine_distance

    q = F.array(*[F.lit(float(x)) for x in query_vec])
    picked = optional_filters(chunks, **filters).where(F.col(vec).isNotNull())
    scored = picked.withColumn("cosine_distance", cosine_distance(F.col(vec), q))
    return top_k(scored, [F.col("cosine_distance").asc(), F.col(chunk_id).desc()], k)


# Telemetry -----------------------------------------------------------------


def retrieval_events(searches: DataFrame, default_channel: str = "web") -> DataFrame:
    """Opening rows of searches: channel default, top-k at least one, empty meta."""
    return searches.select(
        F.sha2(F.col("query_id").cast("string"), 256).alias("event_id"),
        "query_id", "conversation_id",
        tx.default_blank(F.col("channel"), default_channel).alias("channel"),
        "query_text", "retrieval_mode",
        tx.at_least_one(F.col("top_k")).alias("top_k"),
        "started_at",
        F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("meta"),
    )


def close_events(opened: DataFrame, finished: DataFrame) -> DataFrame:
    """Fold begin and finish rows: latest finish time, meta merged if given."""
    from opsloom.operators.keyed import latest_per_key

    last = latest_per_key(
        finished.select("event_id", "finished_at", F.to_json("meta").alias("_meta")),
        ["event_id"], ["finished_at"],
    )
    joined = opened.join(last, "event_id", "left")
    extra = F.from_json("_meta", "map<string,string>")
    return joined.withColumn("meta", merge_maps(F.col("meta"), extra)).drop("_meta")


def retrieval_hits(ranked: DataFrame, mode: str) -> DataFrame:
    """Hit rows of a ranked result, scores in the column of their mode."""
    cosine = F.col("score") if mode == "semantic" else F.lit(None)
    lexical = F.col("score") if mode == "lexical" else F.lit(None)
    return ranked.select(
        F.sha2(F.col("query_id").cast("string"), 256).alias("event_id"),
        tx.at_least_one(F.col("rank_position")).alias("rank_position"),
        "chunk_id",
        cosine.cast("double").alias("score_cosine"),
        lexical.cast("float").alias("score_lexical"),
        F.col("score").cast("double").alias("score_final"),
    )


def ai_turns(turns: DataFrame, default_channel: str = "web") -> DataFrame:
    """Model-turn rows with a stable id and defaults."""
    return turns.withColumn(
        "turn_id", F.sha2(F.concat_ws(":", "conversation_id", "turn"), 256)
    ).withColumn("channel", tx.default_blank(F.col("channel"), default_channel))


class TelemetryLog:
    """Searches, their hits and model turns as they are written while a service runs.

    Events have one row each, which is closed later; hits and turns are added.
    Every call is one commit, made once however often it is tried: ``batch``
    rises per kind of call.
    """

    def __init__(self, spark: SparkSession, folder: str, events: StructType | str, hits: StructType | str, turns: StructType | str):
        self.events = KeyedTable(spark, f"{folder}/events", events, ["event_id"])
        self.hits = EventLog(spark, f"{folder}/hits", hits)
        self.turns = EventLog(spark, f"{folder}/turns", turns)

    def open_events(self, rows: DataFrame, batch: int) -> None:
        self.events.upsert(rows, ["started_at"], "open", batch)

    def close_events(self, rows: DataFrame, batch: int) -> None:
        """Finish time and merged meta of events that are there; others are not opened by it."""
        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            rest = [c for c in old.columns if c not in ("event_id", "finished_at", "meta")]
            closing = new.groupBy("event_id").agg(F.max(F.struct("finished_at", F.to_json("meta").alias("_meta"))).alias("_last"))
            joined = old.join(closing, "event_id", "left")
            meta = merge_maps(F.col("meta"), F.from_json(F.col("_last._meta"), "map<string,string>"))
            return joined.select("event_id", *rest, F.coalesce("_last.finished_at", "finished_at").alias("finished_at"), meta.alias("meta"))

        self.events.merge(rows, combine, "close", batch)

    def add_hits(self, rows: DataFrame, batch: int) -> bool:
        return self.hits.append(rows, "hits", batch)

    def add_turns(self, rows: DataFrame, batch: int) -> bool:
        return self.turns.append(rows, "turns", batch)


def telemetry_chain(events: DataFrame, hits: DataFrame, chunks: DataFrame,
                    turns: DataFrame) -> DataFrame:
    """Event, its hits, their chunks and the turn that used them; links may be missing."""
    return (
        events.join(hits, "event_id", "left")
        .join(chunks, "chunk_id", "left")
        .join(turns, "event_id", "left")
    )


def retrieval_quality(events: DataFrame, hits: DataFrame) -> DataFrame:
    """Per mode: events, hits per event, share without hits, score spread, latency."""
    per_event = hits.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n_hits"), F.max("score_final").alias("hi"),
        F.min("score_final").alias("lo"),
    )
    latency = F.expr("timestampdiff(MILLISECOND, started_at, finished_at)")
    return (
        events.join(per_event, "event_id", "left")
        .groupBy("retrieval_mode")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.avg(F.coalesce("n_hits", F.lit(0))).alias("hits_per_event"),
            F.avg(F.when(F.col("n_hits").isNull(), 1.0).otherwise(0.0)).alias("zero_hit_rate"),
            F.avg(F.col("hi") - F.col("lo")).alias("score_spread"),
            F.avg(latency).alias("latency_ms"),
        )
    )


def ready_embeddings(embeddings: DataFrame, chunks: DataFrame, documents: DataFrame,
                     models: DataFrame) -> DataFrame:
    """Searchable vectors: ready, not NULL, scope equal to the document's."""
    picked = embeddings.where("embedding_status = 'ready' AND embedding IS NOT NULL")
    return (
        picked.join(chunks, "chunk_id")
        .join(documents.withColumnRenamed("scope_id", "_doc_scope"), "document_id")
        .join(models, "model_id")
        .where(F.col("scope_id") == F.col("_doc_scope"))
        .drop("_doc_scope")
    )
