"""Spelling variants: words one edit apart, grouped under their frequent form.

Two words one edit apart either share the front half or the back half of the
shorter one. Words are dealt by such halves; every half is the initial state of
a partition, in which the words' remainders are composed with a one-edit
transducer (``one_edit``). A half that very many words share is halved again,
until at last one symbol is open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.arrow import spans
from opsloom.llm.one_edit import one_edit_pairs
from opsloom.llm.store import kept, quoted, small_side

#: Code points of the shortest words that take part, and their least count.
LENGTH, COUNT = 7, 2
#: A form has at least so many times the count of its variant.
TIMES = 10
#: One of so many runs loses a code point (a seeded error model).
ERROR = 31
#: Rows of a partition from which on it is divided further.
CROWD = 30_000
#: Rows of whole partitions that are composed at once in a task.
BATCH = 60_000


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
                length: int = LENGTH, count: int = COUNT, error: int = ERROR) -> DataFrame:
    """(word, n): distinct words of all texts with their occurrences.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z in lower
    case. Where ``error`` divides h, the crc32 of ``<doc_id>:<run>``, the run
    loses code point h % length. A null text has no words; a null id is
    written as nothing. Runs shorter than ``length`` cannot give a word and are
    never split off.
    """
    runs = docs.select(
        F.coalesce(quoted(id_column).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(quoted(text_column), F.lit(f"[A-Za-zÀ-ÿ]{{{length},}}"), F.lit(0))).alias("run"))
    upper, lower = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    runs = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, lower)).otherwise(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    gone = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), gone), F.substring("run", gone + 2, F.length("run")))
    words = runs.select(F.when(h % error == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Name the partition: length of its shorter words, and what all of them share in front and at the back."""
    shares = F.concat(F.substring("word", F.lit(1), F.col("front")), F.lit(" "),
                      F.substring("word", F.length("word") - F.col("back") + 1, F.col("back")))
    return rows.withColumn("key", F.concat_ws(" ", "short", "front", shares))


def _partitions(words: DataFrame, length: int, crowd: int) -> DataFrame:
    """Rows (word, n, short, long, front, back, key): each word in its four partitions."""
    size = F.length("word")

    def share(short, long: bool, front, back):
        return F.struct(short.alias("short"), F.lit(long).alias("long"), front.cast("int").alias("front"), back.cast("int").alias("back"))

    options = []
    for short, long in ((size, False), (size - 1, True)):
        half = F.floor(short / 2)
        options += [share(short, long, half, F.lit(0)), share(short, long, F.lit(0), short - half)]
    rows = words.select("word", "n", F.inline(F.array(*options))).where(F.col("short") >= length)
    rows = _keyed(rows)
    settled = []
    while True:
        hot = rows.groupBy("key", (F.col("short") - F.col("front") - F.col("back")).alias("open")).count()
        hot = kept(hot.where((F.col("count") > crowd) & (F.col("open") > 1)).select("key"), "crowds")
        if not hot.limit(1).count():
            break
        hot = small_side(hot)
        settled.append(rows.join(hot, "key", "left_anti"))
        half = F.floor((F.col("short") - F.col("front") - F.col("back")) / 2).cast("int")
        ahead = F.struct((F.col("front") + half).alias("front"), F.col("back"))
        behind = F.struct(F.col("front"), (F.col("short") - F.col("front") - half).alias("back"))
        rows = rows.join(hot, "key", "left_semi").select("word", "n", "short", "long", F.inline(F.array(ahead, behind)))
        rows = kept(_keyed(rows), "halves")
    for part in settled:
        rows = rows.unionByName(part)
    return rows


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points below 256 of a string column, and where each string begins in them."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    lead = raw == 0xC3                 # the code points C0 to FF are C3 80 to C3 BF
    value = raw.copy()
    value[1:][lead[:-1]] += 0x40
    place = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(~lead, out=place[1:])
    return value[~lead], place[offsets - offsets[0]]


def _pairs(table: pa.Table) -> pa.RecordBatch | None:
    """Near words within the whole partitions of ``table``, summed up by word."""
    word = table.column("word").combine_chunks()
    n = table.column("n").to_numpy()
    key = table.column("key").combine_chunks().dictionary_encode()
    group = key.indices.to_numpy() * 2 + table.column("long").to_numpy()
    front, back = (table.column(c).to_numpy().astype(np.int64) for c in ("front", "back"))
    flat, place = _symbols(word)
    opens = np.ones(len(group), bool)
    opens[1:] = group[1:] != group[:-1]
    base = np.flatnonzero(opens)
    names = group[base]
    shorter = np.flatnonzero(names % 2 == 0)
    after = np.minimum(shorter + 1, len(names) - 1)
    longer = np.where(names[after] == names[shorter] + 1, after, -1)
    if not len(shorter):
        return None
    i, j = one_edit_pairs(flat, place[:-1] + front, np.diff(place) - front - back, group, shorter, longer, back[base[shorter]] == 0)
    if not len(i):
        return None
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    rank = np.empty(len(word), np.int64)
    rank[pc.sort_indices(word).to_numpy()] = np.arange(len(word))
    order = np.lexsort((rank[j], -n[j], rank[i]))
    i, j = i[order], j[order]
    new = np.flatnonzero(np.append(True, rank[i[1:]] != rank[i[:-1]]))
    near = np.diff(np.append(new, len(i)))
    return pa.RecordBatch.from_pydict({
        "word": word.take(pa.array(i[new])), "near": pa.array(near, pa.int64()),
        "most": pa.array(n[j[new]], pa.int64()), "form": word.take(pa.array(j[new]))})


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; whole partitions are worked on together."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < BATCH:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = table.column("key")[rows - 1]
        same = pc.equal(table.column("key"), last)
        whole = rows - pc.sum(same).as_py()       # the last partition may go on
        if whole:
            out = _pairs(table.slice(0, whole))
            if out is not None:
                yield out
        held = table.slice(whole).to_batches()
        rows -= whole
    if rows:
        out = _pairs(pa.Table.from_batches(held).combine_chunks())
        if out is not None:
            yield out


def near_words(words: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(word, n_near, most, near_form): for words (word, n) that have a word one edit apart.

    ``words`` is a written table of distinct words over ``[a-z\\u00C0-\\u00FF]``.
    ``near_form`` is the near word of largest n, ``most`` its n; of ties the
    smallest in code-point order.
    """
    rows = _partitions(words, length, crowd).repartition("key").sortWithinPartitions("key", "long", "word")
    rows = rows.select("key", "word", F.col("n").cast("long").alias("n"), F.col("long").cast("int").alias("long"), "front", "back")
    found = rows.mapInArrow(_compose, "word string, near long, most long, form string")
    best = F.min(F.struct((-F.col("most")).alias("less"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("most"), F.col("best.form").alias("near_form"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): follow (word, form) to the last, doubling the step each round.

    Counts rise at least ``TIMES``-fold along a chain, so it has no circle and
    is short.
    """
    at = kept(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        later = at.select(F.col("word").alias("root"), F.col("root").alias("later"))
        at = kept(at.join(later, "root", "left").select(
            "word", F.coalesce("later", "root").alias("root"), F.col("later").isNotNull().alias("moved")), "forms")
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")
        at = at.select("word", "root")


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
                      length: int = LENGTH, count: int = COUNT, times: int = TIMES, error: int = ERROR,
                      crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n): words and the frequent form of each.

    Words and counts are those of ``word_counts``, over all texts. A word's form
    is its near word of largest n, if that is at least ``times`` its own; root
    is the last form that follows, or the word itself. Tables without words give
    no rows; repeated rows of ``docs`` count each; other columns are not read.
    """
    words = kept(word_counts(docs, id_column, text_column, length=length, count=count, error=error), "words")
    near = near_words(words, length, crowd)
    found = kept(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("most") >= times * F.col("n"), F.struct(F.col("near_form").alias("form"), F.col("most").alias("form_n"))).alias("to")), "near")
    roots = _roots(found.where("to is not null").select("word", F.col("to.form").alias("form")))
    return found.join(roots, "word", "left").select(
        "word", F.col("to.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near",
        F.col("to.form_n").cast("long").alias("form_n"))
