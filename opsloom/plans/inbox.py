"""Inbox work: page metrics, question summaries, intents, slots, tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom import fixed_values as fv
from opsloom.functions import html as hx
from opsloom.functions import text as tx
from opsloom.functions.binding import bind
from opsloom.operators.literals import text_array
from opsloom.operators.settle import settle


LAYER_WORDS = ("banner", "onboarding", "coachmark", "tour", "wizard", "modal", "dialog", "overlay",
               "backdrop")


def with_body(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """Pages with their bare body markup, computed once."""
    return settle(pages.select(page_id, html), {"_body": hx.body(F.col(html))})


def page_metrics(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    c = F.col("_body")
    lines = settle(with_body(pages, page_id, html), {"_lines": hx.text_lines(c)})
    return lines.select(
        page_id, hx.count_tags(c, "a").alias("anchor_count"), hx.count_tags(c, "button").alias("button_count"),
        hx.count_tags(c, "iframe").alias("iframe_count"),
        F.length(F.array_join("_lines", "\n")).alias("body_text_length"),
        F.length(F.regexp_extract(html, hx.BODY, 1)).alias("body_html_length"),
        F.size("_lines").alias("n_lines"),
    )


def inspect_pages(pages: DataFrame, keywords: Sequence[str], page_id: str = "page_id",
                  html: str = "html", links: int = hx.LINKS, buttons: int = hx.BUTTONS) -> DataFrame:
    """Texts, links, buttons, candidates and warnings of stored pages."""
    c = F.col("_body")
    base = settle(with_body(pages, page_id, html), {
        "texts": hx.text_chunks(c), "links": hx.elements(c, "a", links), "buttons": hx.elements(c, "button", buttons),
        "layer": hx.has_layer(c, LAYER_WORDS)})

    def candidates(column: str) -> Column:
        return F.filter(column, lambda e: tx.item_matches(
            [e["text"], e["href"], e["aria_label"], e["title"]], keywords))

    found = settle(base, {"candidate_links": candidates("links"), "candidate_buttons": candidates("buttons")})
    none = lambda name: F.size(name) == 0
    checks = (
        (none("texts"), "text"), (none("links"), "links"), (none("buttons"), "buttons"),
        (none("candidate_links") & none("candidate_buttons"), "candidates"),
    )
    return found.withColumn("warnings", F.array_compact(F.array(*[
        F.when(test, F.lit(fv.CAPTURE_WARNINGS[name])) for test, name in checks])))


def filter_affordances(pages: DataFrame, keywords: Sequence[str] = fv.QUESTION_FILTER, page_id: str = "page_id",
                       html: str = "html", limit: int = 12) -> DataFrame:
    """Links and buttons that filter or switch a list: their words match, distinct, the first ``limit``."""
    c = F.col("_body")
    found = settle(with_body(pages, page_id, html), {"_all": F.concat(hx.elements(c, "a"), hx.elements(c, "button"))})
    matched = F.filter("_all", lambda e: tx.item_matches([e["text"], e["href"], e["aria_label"], e["title"]], keywords))
    return found.select(page_id, F.slice(F.array_distinct(matched), 1, limit).alias("affordances"))


def onboarding(pages: DataFrame, keywords: Sequence[str] = fv.WIZARD,
               page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Onboarding flag: keyword hit and an action button, banner or dialog."""
    c = F.col("_body")
    base = settle(with_body(pages, page_id, html), {
        "texts": hx.text_chunks(c, 30, 160), "buttons": hx.elements(c, "button", 20),
        "layer": hx.has_layer(c, LAYER_WORDS)})
    labels = F.transform("buttons", lambda b: F.concat_ws(" ", b["text"], b["aria_label"], b["title"]))
    hits = settle(base, {
        "matched_keywords": tx.keyword_hits(F.concat("texts", labels), keywords),
        "matched_buttons": F.slice(F.filter("buttons", lambda b: tx.item_matches(
            [b["text"], b["href"], b["aria_label"], b["title"]], fv.WIZARD_ACTION)), 1, 6)})
    return hits.select(
        page_id, "matched_keywords", "matched_buttons", "layer",
        ((F.size("matched_keywords") > 0) & ((F.size("matched_buttons") > 0) | F.col("layer"))).alias("detected"))


def question_summary(items: DataFrame) -> DataFrame:
    """Eight short fields of a question entry.

    ``items`` holds ``raw_text``, ``links`` (text, href), ``cta_texts`` and
    ``status_texts``; further columns pass through. Every step settles its
    arrays, so later steps read them.
    """
    texts = F.filter(F.transform("links", lambda e: e["text"]), lambda s: s != "")
    base = settle(items, {"_lines": tx.visible_lines(F.col("raw_text")), "_link_texts": texts})
    # Every text is folded once; all later tests read its form.
    base = settle(base, {"_pairs": tx.with_forms(F.col("_lines")), "_links": tx.with_forms(F.col("_link_texts")),
                         "_ctas": tx.with_forms(F.col("cta_texts")), "_states": tx.with_forms(F.col("status_texts"))})
    base = settle(base, {
        "_forms": F.filter("_pairs", lambda p: ~tx.is_noise_form(p["form"])),
        "_cta": tx.first_form_match(F.concat("_ctas", "_links"), fv.QUESTION_CTA),
        "_status": tx.first_form_match(F.concat("_states", "_pairs"), fv.QUESTION_STATUS),
        "_product": tx.first_form_match(F.concat("_links", "_pairs"), fv.QUESTION_PRODUCT),
        "_named_buyer": tx.first_form_match(F.col("_pairs"), fv.QUESTION_BUYER),
        "_time": tx.first_form_time(F.col("_pairs")),
        "_href": F.coalesce(F.get(F.filter(
            F.transform("links", lambda e: e["href"]),
            lambda h: h.contains(fv.PRODUCT_LINK_HOST)), F.lit(0)), F.lit("")),
    })
    base = settle(base, {"_content": F.transform("_forms", lambda p: p["line"])})
    bracketed = F.filter("_content", lambda s: s.contains("(") & s.contains(")") & (F.length(s) <= 80))
    buyer = F.when(F.col("_named_buyer") != "", F.col("_named_buyer")).otherwise(
        tx.first_long_text(bracketed, 6))
    base = settle(base, {"_buyer": buyer})
    base = settle(base, {
        "_nb": tx.match_form(F.col("_buyer")), "_np": tx.match_form(F.col("_product")),
        "_ns": tx.match_form(F.col("_status")), "_nc": tx.match_form(F.col("_cta")),
        "_nt": tx.match_form(F.col("_time")),
    })
    hints = F.array("_nb", "_np", "_ns", "_nc")
    # The line after the buyer that repeats no hint and is not the time.
    after = F.filter(
        F.slice(F.col("_forms"), F.array_position(F.transform("_forms", lambda s: s["form"]), F.col("_nb")).cast("int") + 1,
                F.size("_forms") + 1),
        lambda s: ~F.array_contains(hints, s["form"]) & ((F.col("_time") == "") | (s["form"] != F.col("_nt"))))
    known_buyer = (F.col("_nb") != "") & F.exists("_forms", lambda s: s["form"] == F.col("_nb"))
    context = F.when(known_buyer, F.slice(F.transform(after, lambda s: s["line"]), 1, 1)).otherwise(
        F.array().cast("array<string>"))
    line = lambda kept: F.transform(kept, lambda s: s["line"])
    asking = line(F.filter("_forms", lambda s: s["line"].contains("?") & (s["form"] != F.col("_nb"))))
    other = line(F.filter("_forms", lambda s: ~F.array_contains(hints, s["form"])))
    rest = F.when(F.size("_content") > 0, F.col("_content")).otherwise(F.col("_lines"))
    blank_null = lambda c: F.nullif(c, F.lit(""))
    snippet = F.coalesce(
        blank_null(tx.first_long_text(context, 12)), blank_null(tx.first_long_text(asking, 12)),
        blank_null(tx.first_long_text(other, 12)), tx.first_long_text(rest, 6))
    linked = line(F.filter("_links", lambda s: (s["form"] != F.col("_nc")) & ~s["form"].contains("sku ")))
    product = F.when(F.col("_product") != "", F.col("_product")).otherwise(tx.first_long_text(linked, 8))
    values = {
        "text_snippet": snippet, "product_hint": product, "product_href": F.col("_href"),
        "buyer_hint": F.col("_buyer"), "time_hint": F.col("_time"), "status_hint": F.col("_status"),
        "cta_hint": F.col("_cta"), "raw_text": tx.clean(F.col("raw_text"), 200),
    }
    kept = [c for c in items.columns if c not in {*values, "links", "cta_texts", "status_texts"}]
    summary = base.select(*kept, *[
        F.substring(c, 1, fv.SUMMARY_LENGTHS[name]).alias(name) for name, c in values.items()])
    return settle(summary, {name: F.col(name) for name in values})


def looks_like_question() -> Column:
    """Accept tests in order, after the metrics-card exclusion."""
    fields = list(fv.SUMMARY_LENGTHS)
    form = tx.match_form(F.concat_ws(" ", *fields))
    asks = F.col("text_snippet").contains("?") | F.col("raw_text").contains("?")
    product = (F.col("product_hint") != "") | (F.col("product_href") != "")
    response = (F.col("cta_hint") != "") | (F.col("status_hint") != "")
    card = tx.contains_any(form, fv.QUESTION_METRICS_CARD) & ~(asks | (product & response))
    accept = (
        (product & (response | asks)) | tx.contains_any(form, fv.QUESTION_LIST) | (response & asks)
        | ((F.length("text_snippet") >= 20) & ((F.col("time_hint") != "") | product))
    )
    return ~card & accept


def collect_questions(summaries: DataFrame, page: str, selector: str, position: str,
                      limit: int = 10) -> DataFrame:
    """Questions of each page from its best selector, deduplicated in order.

    The best selector is the first, in selector order, with a real question;
    without one, the first selector's first entry stands in.
    """
    fields = ["text_snippet", "product_hint", "buyer_hint", "time_hint", "status_hint", "cta_hint"]
    keyed = summaries.withColumn("_key", F.concat_ws("|", *fields)).where(F.trim("_key") != "")
    firsts = keyed.groupBy(page, selector, "_key").agg(
        F.min(F.struct(position, "is_question", "text_snippet")).alias("_r")
    ).select(page, selector, F.col(f"_r.{position}").alias(position), "_r.is_question", "_r.text_snippet")
    best = firsts.groupBy(page).agg(
        F.min(F.when(F.col("is_question"), F.col(selector))).alias("_best"),
        F.min(F.struct(selector, position)).alias("_first"))
    from opsloom.operators.keyed import first_n

    joined = firsts.join(best, page)
    picked = joined.where(
        (F.col("is_question") & (F.col(selector) == F.col("_best")))
        | (F.col("_best").isNull() & (F.struct(selector, position) == F.col("_first"))))
    return first_n(picked, [page], [F.col(position).asc()], limit, "question_rank").drop("_best", "_first")


# Intents and tags ------------------------------------------------------------


def best_rule(text: Column, rules: Sequence[tuple[str, int, Sequence[str]]]) -> Column:
    """Name of the matching rule with the lowest priority number, then list order.

    Rules are fixed phrase lists, so matching is one expression per row.
    """
    ordered = sorted(enumerate(rules), key=lambda r: (r[1][1], r[0]))

    def pick(form: Column) -> Column:
        out = None
        for _, (name, _, phrases) in ordered:
            test = tx.contains_any(form, phrases)
            out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
        return out

    return bind(tx.match_form(text), pick)


def all_rules(text: Column, rules: Sequence[tuple[str, int, Sequence[str]]]) -> Column:
    """Every matching tag, by priority and then list order."""
    ordered = sorted(enumerate(rules), key=lambda r: (r[1][1], r[0]))
    return F.array_compact(bind(tx.match_form(text), lambda form: F.array(*[
        F.when(tx.contains_any(form, phrases), F.lit(name)) for _, (name, _, phrases) in ordered])))


INTENT_RULES = [(name, priority, phrases) for name, priority, _, phrases in fv.INTENTS]


def missing_slots(intent: Column, filled: Column) -> Column:
    """Required slots of an intent that are not filled yet."""
    required = None
    for name, slots in fv.INTENT_SLOTS.items():
        value = text_array(slots)
        required = F.when(intent == name, value) if required is None else required.when(intent == name, value)
    return F.array_except(F.coalesce(required, F.array().cast("array<string>")), filled)


def needs_handoff(text: Column, intent: Column, missing: Column, turns: Column,
                  patience: int = 3) -> Column:
    """A person takes over: the buyer does not know, mentions altered parts, or
    an intent is still missing data after ``patience`` turns."""
    return tx.contains_any(tx.match_form(text), fv.HANDOFF_PHRASES) | (
        intent.isNotNull() & (F.size(missing) > 0) & (turns >= patience))
