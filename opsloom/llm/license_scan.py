"""Licence texts in documents by diagonal voting.

All rolling word k-grams of all documents are joined to the places they have in
the templates. A hit votes for the diagonal of its place in the document less
its place in the template. Neighbouring diagonals, which words put in or left
out drive apart, are merged, and the span they cover is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.llm.arrow import text_pieces
from opsloom.llm.license_texts import NOTICES, PHRASES
from opsloom.llm.store import kept, numbered, quoted, small_side
from opsloom.llm.words import Words, runs_of, words_of, words_of_text

#: Words of a gram: those of the shortest phrase.
GRAM = 3
SIMILARITY = 0.8
#: Templates of fewer words, where one word names another licence, have to be whole.
SHORT = 20
#: Share of a template's grams that make a span worth verifying. At SIMILARITY
#: replaced words leave 0.4 of them.
VOTES = 0.3
#: Diagonals of a template up to so many words apart are neighbours, on long templates.
APART = 16
#: Grams sent to Spark at once.
_ROWS = 200_000


def _grams(w: Words, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(number of the text, place, hash, spelling) of the k-grams of all texts, in stretches."""
    n = len(w.key) - k + 1
    size = np.zeros(len(w.key) + 1, np.int64)
    np.cumsum(w.end - w.start, out=size[1:])
    owner = np.repeat(np.arange(len(w.counts)), w.counts)
    for low in range(0, n, _ROWS):
        high = min(low + _ROWS, n)
        inside = np.flatnonzero(owner[low:high] == owner[low + k - 1:high + k - 1])
        begin, end = low, high + k - 1
        raw = w.raw[w.start[begin]:w.end[end - 1]]
        edge = np.zeros(len(raw) + 1, np.int8)
        np.add.at(edge, w.start[begin:end] - w.start[begin], 1)
        np.add.at(edge, w.end[begin:end] - w.start[begin], -1)
        spelled = np.ascontiguousarray(raw[np.cumsum(edge[:-1]) > 0])
        places = (size[begin:end + 1] - size[begin]).astype(np.int32)
        words = pa.StringArray.from_buffers(end - begin, pa.py_buffer(places), pa.py_buffer(spelled))
        gram = pc.binary_join_element_wise(*[words.slice(j, high - low) for j in range(k)], " ")
        yield owner[low:high][inside], inside + low - w.first[owner[low:high][inside]], runs_of(w.key[begin:end], k)[inside], gram.take(pa.array(inside))


def _scan(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, with its number of words, and one for each of its grams."""
    for batch in batches:
        for low, high, raw, offsets in text_pieces(batch.column(2)):
            w = words_of(raw, offsets)
            n = high - low
            uid = batch.column(0).slice(low, n)

            def rows(uid, name, words, place, key, gram):
                return pa.RecordBatch.from_arrays([uid, name, words, place, key, gram], ["uid", "id", "n_words", "place", "key", "gram"])

            yield rows(uid, batch.column(1).slice(low, n), pa.array(w.counts, pa.int64()),
                       pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()))
            for owner, place, key, gram in _grams(w, k):
                m = len(owner)
                yield rows(uid.take(pa.array(owner)), pa.nulls(m, batch.schema.field(1).type), pa.nulls(m, pa.int64()),
                           pa.array(place, pa.int64()), pa.array(key.view(np.int64)), gram)


def _template_grams(spark, templates: list[str], k: int) -> DataFrame:
    rows = []
    for number, text in enumerate(templates):
        for _, place, key, gram in _grams(words_of_text(text), k):
            rows += zip([number] * len(place), place.tolist(), key.view(np.int64).tolist(), gram.to_pylist())
    return small_side(spark.createDataFrame(rows, "template int, at long, key long, gram string"), len(rows))


def _chain(at: np.ndarray, place: np.ndarray) -> tuple[int, int, int]:
    """(words, first, last place) of the longest run of word pairs that ascends on both sides."""
    tails: list[int] = []
    link = np.full(len(at), -1)
    ends: list[int] = []
    order = np.lexsort((-place, at))
    for i in order.tolist():
        low = int(np.searchsorted(tails, place[i]))
        link[i] = ends[low - 1] if low else -1
        if low == len(tails):
            tails.append(int(place[i]))
            ends.append(i)
        else:
            tails[low], ends[low] = int(place[i]), i
    i, last = ends[-1], tails[-1]
    while link[i] >= 0:
        i = int(link[i])
    return len(tails), int(place[i]), last


def _verify(batches: Iterator[pa.RecordBatch], sizes: list[int], k: int) -> Iterator[pa.RecordBatch]:
    """Similarity of a merged span and its template: twice the words in common, in order, over the words of both."""
    for batch in batches:
        score = np.zeros(len(batch))
        for row, (template, lines) in enumerate(zip(batch.column("template").to_pylist(), batch.column("lines").to_pylist())):
            pairs = {(p - line["diagonal"] + j, p + j) for line in lines for p in line["places"] for j in range(k)}
            at, place = np.array(sorted(pairs)).T
            words, first, last = _chain(at, place)
            score[row] = 2 * words / (sizes[template] + last - first + 1)
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("template"), pa.array(score)], ["uid", "template", "score"])


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
                 phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES,
                 gram: int = GRAM, similarity: float = SIMILARITY) -> DataFrame:
    """Per document: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    ``phrases`` and ``notices`` are (label, text). Base places are the places
    at which all words of a phrase stand one after the other: diagonals with a
    vote of each of its grams, which are compared by spelling, not by hash
    alone. ``labels`` adds those of the templates of which a verified span has
    at least ``similarity`` (all words of templates below SHORT words); words count there that stand in a run of ``gram``
    words in common. ``score`` is 1 with a base place, else the highest
    similarity of a verified span, 0 without one.

    Every row of ``docs`` gives a row: repeated rows, null ids, null and empty
    texts (no words) too. A very long text is held by the task that reads it.
    ``docs`` is a table scan; its other columns are not read. Templates need
    ``gram`` words at least.
    """
    spark = docs.sparkSession
    templates = [*phrases, *notices]
    sizes = [len(words_of_text(text).key) for _, text in templates]
    if min(sizes) < gram:
        raise ValueError(f"a template has fewer than {gram} words")
    plain = numbered(docs.select(quoted(id_column).alias("id"), quoted(text_column).alias("text"))).select("uid", "id", "text")
    schema = T.StructType([T.StructField("uid", T.LongType()), plain.schema["id"], T.StructField("n_words", T.LongType()),
                           T.StructField("place", T.LongType()), T.StructField("key", T.LongType()), T.StructField("gram", T.StringType())])
    rows = plain.mapInArrow(partial(_scan, k=gram), schema)
    joined = rows.join(_template_grams(spark, [text for _, text in templates], gram), ["key", "gram"], "left")
    found = kept(joined.where("place is null or template is not null").select("uid", "id", "n_words", "place", "template", "at"), "hits")

    info = F.broadcast(spark.createDataFrame(
        [(i, label, i < len(phrases), size - gram + 1, max(1, min(APART, size // 4)), similarity if size >= SHORT else 1.0) for i, ((label, _), size) in enumerate(zip(templates, sizes))],
        "template int, label string, phrase boolean, grams long, apart long, least double"))
    lines = found.where("template is not null").groupBy("uid", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.array_sort(F.collect_list("place")).alias("places")).join(info, "template")
    base = lines.where(F.col("phrase") & (F.size("places") == F.col("grams"))).select(
        "uid", "label", F.col("diagonal").alias("start"), F.lit(1.0).alias("score"))

    along = Window.partitionBy("uid", "template").orderBy("diagonal")
    opens = F.col("diagonal") - F.lag("diagonal").over(along) > F.col("apart")
    spans = lines.where(~F.col("phrase")).withColumn("opens", F.coalesce(opens.cast("int"), F.lit(1))).withColumn("span", F.sum("opens").over(along))
    spans = spans.groupBy("uid", "template", "span").agg(
        F.collect_list(F.struct("diagonal", "places")).alias("lines"), F.sum(F.size("places")).alias("votes"), F.max("grams").alias("grams"))
    spans = spans.where(F.col("votes") >= VOTES * F.col("grams")).select("uid", "template", "lines").mapInArrow(
        partial(_verify, sizes=sizes, k=gram), "uid long, template int, score double")
    spans = spans.join(info, "template").select(
        "uid", F.when(F.col("score") >= F.col("least"), F.col("label")).alias("label"), F.lit(None).cast("long").alias("start"), "score")

    def listed(labels):
        return F.array_join(F.array_sort(F.collect_set(labels)), ",")

    per = base.unionByName(spans).groupBy("uid").agg(
        F.count("start").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"),
        listed(F.when(F.col("start").isNotNull(), F.col("label"))).alias("base_labels"), listed("label").alias("labels"),
        F.least(F.max("score"), F.lit(1.0)).alias("score"))
    whole = found.where("place is null").select("uid", F.col("id").alias("doc_id"), "n_words").join(per, "uid", "left")
    return whole.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
