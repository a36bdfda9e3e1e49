"""Quality selection by importance resampling with hashed n-gram models.

Target and raw text are described by bags of hashed n-grams: characters (five
bytes), words and word pairs. Raw text is the whole corpus; where labels name
kinds of text to reject, each kind is a raw model of its own, smoothed by the
corpus. A document's log weight is the sum of its n-grams' log ratios of target
to raw, less a cost per n-gram found on labelled rows that the models have not
seen; with several raw models the lowest counts. The sample is the top k of log
weight plus Gumbel noise.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from opsloom.llm.arrow import mix, text_pieces
from opsloom.llm.store import fresh, kept, numbered, quoted, small_side
from opsloom.llm.words import runs_of, words_of

BINS = 1 << 18
GRAM_BYTES = 5
FEATURES = 3
#: Labelled rows that models and thresholds are fitted on, at most.
LABELLED = 200_000
#: Kinds of labels, each of which is a model in memory; more are refused.
MOST_KINDS = 64
#: Strength of the corpus model in every other, in n-grams.
SMOOTHING = 1000.0
#: Standard deviations by which an n-gram's share has to differ to count.
CERTAIN = 5.0
#: Least log ratio that counts; below it lie shifts of topic or language between samples.
LEAST_RATIO = float(np.log(2.0))
_SLICES = 32
_GROUPS = 64


def hashed_ngrams(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text number, bin) of every n-gram, for each feature.

    A word that repeats the one before is one bin of its own among the pairs.
    """
    n = max(len(raw) - GRAM_BYTES + 1, 0)
    gram = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(GRAM_BYTES):
            gram = (gram << np.uint64(8)) + raw[j:j + n]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = owner[:n] == owner[GRAM_BYTES - 1:]
    w = words_of(raw, offsets)
    word_owner = np.repeat(np.arange(len(offsets) - 1), w.counts)
    pair = np.where(w.key[1:] == w.key[:-1], np.uint64(0), runs_of(w.key, 2))
    same = word_owner[1:] == word_owner[:-1]
    found = ((owner[:n][inside], gram[inside]), (word_owner, w.key), (word_owner[1:][same], pair[same]))
    return [(o, (mix(g) >> np.uint64(46)).astype(np.int64)) for o, g in found]


@dataclass
class RatioModel:
    """Log ratios of target to each raw model, and the cost of an n-gram."""

    kinds: list[str]
    ratio: np.ndarray        # kind, feature, bin
    cost: np.ndarray         # per kind

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log ratios of each kind and text, n-grams of each text)."""
        n = len(offsets) - 1
        out, total = np.zeros((len(self.kinds), n)), np.zeros(n)
        for f, (owner, bins) in enumerate(hashed_ngrams(raw, offsets)):
            total += np.bincount(owner, minlength=n)
            for k in range(len(self.kinds)):
                out[k] += np.bincount(owner, weights=self.ratio[k, f][bins], minlength=n)
        return out, total


def _counting(models: int):
    """Counts of one task: bins of each feature in the corpus and, where ``model`` names one, in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((models + 1, FEATURES, BINS), np.int64)
        for batch in batches:
            model = batch.column(1).fill_null(-1).to_numpy()
            for low, high, raw, offsets in text_pieces(batch.column(0)):
                named = model[low:high]
                for f, (owner, bins) in enumerate(hashed_ngrams(raw, offsets)):
                    total[0, f] += np.bincount(bins, minlength=BINS)
                    for m in np.unique(named[named >= 0]).tolist():
                        total[m + 1, f] += np.bincount(bins[named[owner] == m], minlength=BINS)
        if total.any():
            parts = total.reshape(models + 1, FEATURES, _SLICES, -1)
            yield from _slices((s, parts[:, :, s].reshape(-1)) for s in range(_SLICES))

    return run


def _slices(counted: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Counts as bytes, of the narrowest kind that holds them."""
    for part, counts in counted:
        kind = "<i4" if counts.max(initial=0) < 1 << 31 else "<i8"
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "kind": pa.array([kind]), "counts": pa.array([counts.astype(kind).tobytes()], pa.binary())})


def _adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, kind, raw in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("counts")):
            counts = np.frombuffer(raw.as_buffer(), kind)
            sums[part] = sums[part] + counts if part in sums else counts.astype(np.int64)
    yield from _slices(sums.items())


def fit_ratio_model(docs: DataFrame, labelled: DataFrame, text: str = "text", key: str = "doc_id",
                    target: str = "target", labelled_rows: int = LABELLED) -> RatioModel:
    """Fit on all ``docs`` (corpus counts) and ``labelled`` (key, kind).

    ``kind`` names the group of a labelled row; ``target`` is the wanted one.
    At most ``labelled_rows`` rows are used, those with the smallest hash of
    their key, and of equal texts of one kind one. Half of them fit the models, half the cost per n-gram. Labels
    without document, without key or without kind do not count; of several
    labels of one key the smallest kind does. With no other kind the corpus is
    the raw model, and with no target rows every ratio is 1.
    """
    spark = docs.sparkSession
    plain = docs.select(quoted(key).alias("key"), quoted(text).alias("text"))
    named = labelled.select(quoted(key).alias("key"), "kind").dropna().groupBy("key").agg(F.min("kind").alias("kind"))
    chosen = (plain.select("key", F.xxhash64("text").alias("copy")).join(named, "key")
              .groupBy("kind", "copy").agg(F.min("key").alias("key"))
              .select("key", "kind").distinct().orderBy(F.xxhash64("key"), "key").limit(labelled_rows))
    chosen = kept(chosen.withColumn("fits", F.pmod(F.xxhash64(F.lit("half"), "key"), F.lit(2)) == 0), "labels")
    found = [r[0] for r in chosen.select("kind").distinct().limit(MOST_KINDS + 1).collect()]
    if len(found) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of labels; merge rare ones")
    kinds = sorted(k for k in found if k != target)
    models = [target, *kinds]
    number = F.create_map(*[F.lit(x) for pair in zip(models, range(len(models))) for x in pair])
    fitting = F.broadcast(chosen.filter("fits").select("key", F.get(F.array(number[F.col("kind")]), F.lit(0)).alias("model")))
    counted = "part int, kind string, counts binary"
    # Added up in two steps, so no task receives a slice from every task that counts.
    rows = (plain.join(fitting, "key", "left").select("text", "model")
            .mapInArrow(_counting(len(models)), counted)
            .withColumn("group", F.spark_partition_id() % _GROUPS).repartition("part", "group").drop("group")
            .mapInArrow(_adding, counted).repartition("part").mapInArrow(_adding, counted).collect())
    total = np.zeros((len(models) + 1, FEATURES, _SLICES, BINS // _SLICES))
    for part, kind, raw in rows:
        total[:, :, part] = np.frombuffer(raw, kind).reshape(len(models) + 1, FEATURES, -1)
    total = total.reshape(len(models) + 1, FEATURES, BINS)
    raw_models = [(k, total[i + 2]) for i, k in enumerate(kinds)] or [("corpus", total[0])]
    ratio = np.stack([_log_ratio(total[1], counts, total[0]) for _, counts in raw_models])
    model = RatioModel([k for k, _ in raw_models], ratio.astype(np.float32), np.zeros(len(raw_models)))
    held = plain.join(F.broadcast(chosen.filter("NOT fits").select("key", "kind")), "key").select(
        F.lit(0).cast("long").alias("uid"), "kind", "text")
    scored = held.mapInArrow(_score(spark.sparkContext.broadcast(model)),
                             "uid long, order string, grams double, sums array<double>").toPandas()
    model.cost = np.array([_cost(scored, i, k, target, bool(kinds)) for i, (k, _) in enumerate(raw_models)])
    return model


def _log_ratio(target: np.ndarray, raw: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Per feature and bin; 0 where target and raw do not differ for certain."""
    prior = (corpus + 0.5) / (corpus + 0.5).sum(axis=1, keepdims=True)
    nt, nr = target.sum(axis=1, keepdims=True), raw.sum(axis=1, keepdims=True)
    if not (nt.all() and nr.all()):
        return np.zeros(target.shape)
    both = target + raw
    spread = np.sqrt(both * nt * nr) / (nt + nr) + 1e-9
    sure = np.abs(raw - both * nr / (nt + nr)) > CERTAIN * spread
    ratio = np.log((target + SMOOTHING * prior) / (nt + SMOOTHING)) - np.log(
        (raw + SMOOTHING * prior) / (nr + SMOOTHING))
    return np.where(sure & (np.abs(ratio) > LEAST_RATIO), ratio, 0.0)


def _cost(scored, place: int, kind: str, target: str, by_kind: bool) -> float:
    """The mean log ratio that best parts held-out rows of the target from the others."""
    if not len(scored):
        return 0.0
    mean = scored["sums"].map(lambda s: s[place]).to_numpy() / np.maximum(scored["grams"].to_numpy(), 1)
    good = mean[scored["order"] == target]
    bad = mean[(scored["order"] == kind) if by_kind else (scored["order"] != target)]
    if not len(good) or not len(bad):
        return 0.0
    edges = np.unique(np.concatenate([good, bad]))
    middle = (edges[1:] + edges[:-1]) / 2
    if not len(middle):
        return 0.0
    lost = np.searchsorted(np.sort(good), middle) / len(good)
    passed = 1 - np.searchsorted(np.sort(bad), middle) / len(bad)
    best = lost + passed
    at = np.flatnonzero(best <= best.min() + 1e-12)
    return float((middle[at[0]] + middle[at[-1]]) / 2)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = model.value
        for batch in batches:
            for low, high, raw, offsets in text_pieces(batch.column(2)):
                sums, grams = ratios.scores(raw, offsets)
                yield pa.RecordBatch.from_pydict({
                    "uid": batch.column(0).slice(low, high - low), "order": batch.column(1).slice(low, high - low),
                    "grams": pa.array(grams), "sums": pa.array(list(sums.T), pa.list_(pa.float64()))})

    return run


def log_weights(docs: DataFrame, model: RatioModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(uid, order, log_weight) of each row of the scan. A text without n-grams has log weight 0."""
    plain = numbered(docs.select(quoted(key).alias("order"), quoted(text).alias("text"))).select("uid", "order", "text")
    kind = plain.schema["order"].dataType.simpleString()
    scored = plain.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)),
                              f"uid long, order {kind}, grams double, sums array<double>")
    each = [F.get("sums", F.lit(i)) - F.lit(float(c)) * F.col("grams") for i, c in enumerate(model.cost)]
    return scored.select("uid", "order", (F.least(*each) if len(each) > 1 else each[0]).alias("log_weight"))


def gumbel(seed: int, *columns: Column) -> Column:
    """Gumbel noise that depends on the columns and the seed alone."""
    part = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return -F.log(-F.log((part + 0.5) / F.lit(float(1 << 53))))


def kth_largest(table: DataFrame, key: str, k: int, few: int = 10_000) -> tuple[float, float]:
    """(low, high): at most ``few`` rows, or rows of one value, lie in [low, high), the k-th largest among them.

    ``table`` is written. Each pass counts rows in equal intervals, so nothing
    but some thousand counts leaves the tasks, whatever k is.
    """
    low, top = table.agg(F.min(key), F.max(key)).first()
    high = float(np.nextafter(top, np.inf))
    while True:
        width = (high - low) / 2048
        if width <= 0 or low + width <= low:
            return low, high
        inside = table.filter((F.col(key) >= low) & (F.col(key) < high))
        above = table.filter(F.col(key) >= high).count()
        cell = F.least(F.floor((F.col(key) - low) / width), F.lit(2047)).cast("int")
        counts = dict(inside.groupBy(cell.alias("cell")).count().collect())
        if sum(counts.values()) <= few:
            return low, high
        for c in sorted(counts, reverse=True):
            if above + counts[c] >= k:
                break
            above += counts[c]
        bounds = inside.filter(cell == c).agg(F.min(key), F.max(key)).first()
        if (bounds[0], float(np.nextafter(bounds[1], np.inf))) == (low, high):
            return low, high
        low, high = bounds[0], float(np.nextafter(bounds[1], np.inf))


def gumbel_top_k(weighted: DataFrame, k: int | None = None, seed: int = 7) -> DataFrame:
    """The k rows of largest log weight plus noise, with ``sample_key``.

    ``weighted`` has uid, order and log_weight. Without k it is the number of
    rows with log weight 0 or more. Equal keys are taken by uid. k above the
    number of rows takes all, below 1 none.
    """
    table = kept(weighted.withColumn("sample_key", F.col("log_weight") + gumbel(seed, "order", "log_weight")), "keys")
    return _sampled(table, "uid", "log_weight", "sample_key", k)


def _sampled(table: DataFrame, uid: str, weight: str, sample_key: str, k: int | None) -> DataFrame:
    """The k rows of largest key of a written table: those above a threshold, without moving them."""
    n, wanted = table.agg(F.count("*"), F.count_if(quoted(weight) >= 0)).first()
    k = wanted if k is None else k
    if k >= n:
        return table
    if k < 1:
        return table.limit(0)
    keys = table.select(quoted(uid).alias("uid"), quoted(sample_key).alias("key"))
    low, high = kth_largest(keys, "key", k)
    rest = k - keys.filter(F.col("key") >= high).count()
    near = keys.filter((F.col("key") >= low) & (F.col("key") < high)).orderBy(F.desc("key"), "uid").limit(rest)
    near = kept(near.select(F.col("uid").alias(uid)), "near")
    at = quoted(sample_key)
    last = table.filter((at >= low) & (at < high)).join(small_side(near, max(rest, 0)), uid, "left_semi")
    return table.filter(at >= high).unionByName(last)


def label_kinds(labels: DataFrame) -> DataFrame:
    """(doc_id, kind) of rows with quality and toxic marks: target, junk or toxic."""
    kind = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(
        F.col("quality") == 1, "target")
    return labels.select("doc_id", kind.alias("kind"))


def resample(docs: DataFrame, labelled: DataFrame, k: int | None = None, seed: int = 7, **columns: str) -> DataFrame:
    """(uid, order, log_weight, sample_key) of the sampled rows of ``docs``.

    Null and empty texts weigh 0, the least that the default k counts, so they
    are not rejected for being empty. Repeated rows weigh the same and draw the
    same noise.
    """
    model = fit_ratio_model(docs, labelled, **columns)
    return gumbel_top_k(log_weights(docs, model, **columns), k, seed)


def selected_documents(docs: DataFrame, labelled: DataFrame, k: int | None = None, seed: int = 7, text: str = "text",
                       key: str = "doc_id", **options) -> DataFrame:
    """The sampled documents; columns as they were.

    Documents are written once with their weight and then filtered, so none is
    moved through a join with the sample.
    """
    uid, weight, sample_key = fresh(docs, "uid", "log_weight", "sample_key")
    model = docs.sparkSession.sparkContext.broadcast(fit_ratio_model(docs, labelled, text, key, **options))
    rows = numbered(docs, uid)
    weighed = rows.mapInArrow(_weigh(model, text, weight), StructType([*rows.schema.fields, StructField(weight, DoubleType())]))
    table = kept(weighed.withColumn(sample_key, quoted(weight) + gumbel(seed, quoted(key), quoted(weight))), "weighed")
    return _sampled(table, uid, weight, sample_key, k).select(*[quoted(c) for c in docs.columns])


def _weigh(model, text: str, weight: str):
    """Rows as they are, with the log weight of their text behind them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = model.value
        for batch in batches:
            for low, high, raw, offsets in text_pieces(batch.column(batch.schema.names.index(text))):
                sums, grams = ratios.scores(raw, offsets)
                least = (sums - ratios.cost[:, None] * grams).min(axis=0)
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, pa.array(least)], [*batch.schema.names, weight])

    return run
