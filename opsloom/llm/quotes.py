"""Conversations from messages that quote each other, by DataFrame functions alone.

Lines are read with their quote level. Paragraphs and single lines of every
level are normalised and hashed; what a message says itself is matched with
what later messages quote, and each message is linked to the one it answers.
Links are followed to the first message, and each conversation is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm.store import kept, quoted

#: First words and last words of lines that announce a quotation.
ANNOUNCES = (r"(?i)^\s*(on\b.{0,300}\bwrote|am\b.{0,300}\bschrieb.{0,300}|le\b.{0,300}\ba écrit"
             r"|el\b.{0,300}\bescribió|-+ ?original message ?-+)\s*:?\s*$")
_LEVEL = r"^[\s>]*>"
_BREAK, _TAG = "\u0001", "\u0002"
#: Units of ``sent`` that one piece of a hot passage's or conversation's history spans.
SPAN = 100_000_000


def read_lines(text: Column, announces: str = ANNOUNCES) -> Column:
    """array<struct<level:int, line:string>> of a message.

    A line that announces a quotation, and is followed by one but for blank
    lines, has level -1.
    """
    lines = F.split(text, "\n", -1)

    def code(line: Column) -> Column:
        return (F.when(line.rlike(_LEVEL), F.lit("q")).when(~line.rlike(r"\S"), F.lit("b"))
                .when(line.rlike(announces), F.lit("a")).otherwise(F.lit("o")))

    codes = F.regexp_replace(F.array_join(F.transform(lines, code), ""), "a(?=b*+q)", "A")

    def read(line: Column, code: Column) -> Column:
        marks = F.when(code == "q", F.length(F.regexp_replace(F.regexp_extract(line, _LEVEL, 0), r"\s", ""))).otherwise(F.lit(0))
        return F.struct(F.when(code == "A", F.lit(-1)).otherwise(marks).cast("int").alias("level"),
                        F.when(code == "q", F.regexp_replace(line, _LEVEL + r"\s?", "")).otherwise(line).alias("line"))

    return F.zip_with(lines, F.regexp_extract_all(codes, F.lit("."), F.lit(0)), read)


def normal_form(text: Column) -> Column:
    """Lower case, with runs of white space, and of the signs that this module marks with, as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x{a0}\x01\x02]+", " "))


def own_text(lines: Column) -> Column:
    """What a message says itself: its lines without quotations and their announcements."""
    own = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"])
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")


def passages(lines: Column) -> Column:
    """array<struct<level:int, form:string>>: each paragraph and each line of it, of all levels.

    A paragraph is a run of lines of one level without a blank line between.
    ``lines`` is a column of a table, so that it is read once: the work grows
    with the lines, however many levels there are.
    """
    forms = F.transform(lines, lambda x: F.struct(
        x["level"].alias("level"), F.when(x["level"] < 0, F.lit("")).otherwise(normal_form(x["line"])).alias("form")))
    before = F.concat(F.array(F.lit(None).cast("int")), F.transform(lines, lambda x: x["level"]))

    def tagged(x: Column) -> Column:
        return F.concat(x["level"].cast("string"), F.lit(_TAG), x["form"])

    def piece(x: Column, level: Column) -> Column:
        goes_on = x["level"].eqNullSafe(level)
        return (F.when(x["form"].isNull(), F.lit("")).when(x["form"] == "", F.concat(F.lit(_BREAK), tagged(x)))
                .when(goes_on, x["form"]).otherwise(F.concat(F.lit(_BREAK), tagged(x))))

    paragraphs = F.transform(F.split(F.array_join(F.zip_with(forms, before, piece), " "), _BREAK),
                             lambda s: F.concat_ws(_TAG, F.substring_index(s, _TAG, 1), F.trim(F.substring_index(s, _TAG, -1))))
    each = F.transform(forms, tagged)
    found = F.filter(F.array_distinct(F.concat(paragraphs, each)), lambda s: s.rlike("(?s)" + _TAG + "."))

    def untagged(s: Column) -> Column:
        return F.struct(F.substring_index(s, _TAG, 1).cast("int").alias("level"), F.substring_index(s, _TAG, -1).alias("form"))

    return F.transform(found, untagged)


def link_quotes(messages: DataFrame, key: str = "id", sent: str = "sent", text: str = "text",
                span: int = SPAN, announces: str = ANNOUNCES) -> DataFrame:
    """Written table: id, sent, text (own words), parent.

    The parent is the message whose words are quoted: at the lowest level of
    which something is found, the one with most characters quoted, then the
    latest, then the largest id. Of several messages that say the same passage,
    the latest sent before the quotation is meant, and of these the largest id.

    ``id`` is unique and ``sent`` a whole number; rows without id are left out,
    those without ``sent`` neither quote nor are quoted. Null and empty texts
    say and quote nothing. Repeated rows count once. A passage that very many
    messages share is worked on in pieces of ``span`` units of ``sent``.
    """
    plain = messages.select(quoted(key).alias("id"), quoted(sent).cast("long").alias("sent"),
                            F.coalesce(quoted(text), F.lit("")).alias("text")).filter("id IS NOT NULL").distinct()
    parsed = kept(plain.select("id", "sent", read_lines(F.col("text"), announces).alias("lines")), "messages")
    said = kept(parsed.filter("sent IS NOT NULL").select("id", "sent", F.inline(passages(F.col("lines")))).select(
        "id", "sent", "level", F.md5("form").alias("hash"), F.length("form").alias("size"),
        F.floor(F.col("sent") / span).alias("piece")), "passages")
    asked = said.filter("level > 0").select("hash").distinct()
    said = said.join(asked, "hash")
    one = Window.partitionBy("hash", "piece").orderBy("sent").rangeBetween(Window.unboundedPreceding, -1)
    speaker = F.when(F.col("level") == 0, F.struct("sent", "id"))
    within = said.withColumn("near", F.max(speaker).over(one)).filter("level > 0")
    last = said.filter("level = 0").groupBy("hash", "piece").agg(F.max(F.struct("sent", "id")).alias("last"))
    pieces = last.select("hash", "piece").union(said.filter("level > 0").select("hash", "piece")).distinct()
    before = Window.partitionBy("hash").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.join(last, ["hash", "piece"], "left").select(
        "hash", "piece", F.max("last").over(before).alias("far"))
    votes = (within.join(carried, ["hash", "piece"], "left")
             .select("id", "level", "size", F.coalesce("near", "far").alias("source")).filter("source IS NOT NULL")
             .groupBy("id", "level", "source").agg(F.sum("size").alias("size")))
    parents = votes.groupBy("id").agg(F.min(F.struct("level", (-F.col("size")).alias("less"))).alias("best"))
    chosen = (votes.join(parents, "id").filter("level = best.level AND size = -best.less")
              .groupBy("id").agg(F.max("source").getField("id").alias("parent")))
    return kept(parsed.join(chosen, "id", "left").select(
        "id", "sent", own_text(F.col("lines")).alias("text"), "parent"), "linked")


def first_messages(linked: DataFrame) -> DataFrame:
    """(id, root, depth) of every linked message: links are followed in doubling steps.

    A step joins only messages whose way is not finished, so the number of
    steps is the logarithm of the longest chain of replies.
    """
    step = kept(linked.select("id", F.coalesce("parent", "id").alias("root"),
                              F.col("parent").isNotNull().cast("int").alias("depth"),
                              F.col("parent").isNull().alias("done")), "steps")
    while step.filter("NOT done").limit(1).count():
        further = step.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"),
                              F.col("done").alias("ends"))
        moved = step.filter("NOT done").join(further, "root").select(
            "id", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"),
            F.col("ends").alias("done"))
        step = kept(step.filter("done").union(moved), "steps")
    return step.select("id", "root", "depth")


def conversations(messages: DataFrame, key: str = "id", sent: str = "sent", text: str = "text",
                  span: int = SPAN, announces: str = ANNOUNCES) -> DataFrame:
    """conversation (its first message), position (from 1), depth, id, parent, text without quotes.

    Messages follow in the order sent, so each stands behind the one it answers;
    equal times by id, missing times last. See ``link_quotes`` for the links.
    """
    linked = link_quotes(messages, key, sent, text, span, announces)
    placed = kept(linked.join(first_messages(linked), "id").withColumn(
        "piece", F.coalesce(F.floor(F.col("sent") / span), F.lit((1 << 63) - 1))), "placed")
    sizes = placed.groupBy("root", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("root").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("root", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("root", "piece").orderBy("sent", "id")
    return placed.withColumn("place", F.row_number().over(order)).join(offsets, ["root", "piece"]).select(
        F.col("root").alias("conversation"), (F.col("offset") + F.col("place")).alias("position"), "depth", "id",
        "parent", "text")


#: Units of ``sent`` between two stand-in conversations.
APART = 1_000_000


def quoted_mails(turns: DataFrame) -> DataFrame:
    """Messages made from a table of turns: each quotes the turn before it, and that one's quotation in turn.

    id is ``conv_id/turn``; the quotation stands below, behind an announcing line.
    """
    t = turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))

    def earlier(n: int) -> DataFrame:
        return t.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(f"text_{n}"))

    def marked(name: str, mark: str) -> Column:
        return F.concat(F.lit("\n"), F.regexp_replace(name, r"(?m)^", mark))

    body = F.concat("text", F.coalesce(F.concat(F.lit("\n\nOn some day someone wrote:"), marked("text_1", "> ")), F.lit("")),
                    F.coalesce(marked("text_2", "> > "), F.lit("")))
    return t.join(earlier(1), ["conv_id", "turn"], "left").join(earlier(2), ["conv_id", "turn"], "left").select(
        F.concat_ws("/", "conv_id", "turn").alias("id"), (F.col("conv_id") * APART + F.col("turn")).alias("sent"),
        body.alias("text"))


def thread_report(turns: DataFrame) -> DataFrame:
    """The conversations that quotations alone give back for a table of turns."""
    found = conversations(quoted_mails(turns))
    return found.select("conversation", F.col("position").cast("long").alias("position"),
                        F.col("depth").cast("long").alias("depth"), "id", "parent", F.md5("text").alias("text_md5"),
                        F.length("text").cast("long").alias("n_chars"))


#: A turn answers the one before it if that one says anything.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, concat(conv_id, '/', turn) AS id,
         regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS own
  FROM conversations
), linked AS (
  SELECT m.*, CASE WHEN p.own <> '' THEN p.id END AS parent
  FROM t m LEFT JOIN t p ON p.conv_id = m.conv_id AND p.turn = m.turn - 1
), runs AS (
  SELECT *, max(CASE WHEN parent IS NULL THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS first
  FROM linked
)
SELECT concat(conv_id, '/', first) AS conversation,
       row_number() OVER (PARTITION BY conv_id, first ORDER BY turn) AS position,
       row_number() OVER (PARTITION BY conv_id, first ORDER BY turn) - 1 AS depth,
       id, parent, md5(own) AS text_md5, length(own)::BIGINT AS n_chars
FROM runs
"""
