"""Localised labels and templated phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom import fixed_values as fv


def normal_locale(c: Column) -> Column:
    return F.when(c.isin("en", "he"), c).otherwise("es")


def with_label(rows: DataFrame, labels: DataFrame, domain: str, key: str = "key",
               locale: str = "locale") -> DataFrame:
    """Add ``label``: the locale's text, else Spanish, else the key itself.

    Labels are folded to one row per key, so each row meets one lookup join.
    """
    texts = (
        labels.where(F.col("domain") == domain)
        .groupBy(F.col("key").alias("_k"))
        .agg(F.map_from_entries(F.collect_list(F.struct("locale", "label"))).alias("_texts"))
    )
    joined = rows.join(texts, F.col(key) == F.col("_k"), "left")
    own = F.try_element_at("_texts", normal_locale(F.col(locale)))
    spanish = F.try_element_at("_texts", F.lit("es"))
    return joined.withColumn("label", F.coalesce(own, spanish, F.col(key))).drop("_k", "_texts")


def unknown_label(domain: str, key: Column) -> Column:
    """What is shown for a key that the domain does not have."""
    return F.replace(key, F.lit("_"), F.lit(" ")) if domain in fv.SPACED_DOMAINS else key


def fixed_label(domain: str, key: Column, locale: Column) -> Column:
    """The same lookup as an expression over the fixed label table."""
    texts = fv.LABELS[domain]
    chosen = [
        F.try_element_at(F.create_map(*[F.lit(x) for word, each in texts.items() for x in (word, each[n])]), key)
        for n in range(len(fv.LOCALES))
    ]
    shown = F.when(locale == "en", chosen[1]).when(locale == "he", chosen[2]).otherwise(chosen[0])
    return F.coalesce(shown, unknown_label(domain, key))


def _joined_labels(domain: str, text: Column, locale: Column) -> Column:
    """``a and b`` translated part by part and joined in the locale's manner."""
    parts = F.transform(F.split(text, r"\s+and\s+"), lambda p: fixed_label(domain, p, locale))
    return (
        F.when(locale == "en", F.array_join(parts, " and "))
        .when(locale == "he", F.array_join(parts, " ו"))
        .otherwise(F.array_join(parts, " y "))
    )


def translate_phrase(phrase: Column, locale: Column) -> Column:
    """Known step phrases in the wanted locale; others are returned unchanged."""
    lang = normal_locale(locale)
    out = None
    for pattern, domains, texts in fv.PHRASES:
        groups = []
        for n, domain in enumerate(domains, start=1):
            part = F.regexp_extract(phrase, pattern, n)
            groups.append(
                _joined_labels(domain[:-1], part, lang) if domain.endswith("*")
                else fixed_label(domain, part, lang)
            )

        def fill(text: str) -> Column:
            pieces, rest = [], text
            for n, group in enumerate(groups):
                before, _, rest = rest.partition("{%d}" % n)
                pieces += [F.lit(before), group]
            return F.concat(*pieces, F.lit(rest))

        shown = (
            F.when(lang == "en", fill(texts["en"])).when(lang == "he", fill(texts["he"]))
            .otherwise(fill(texts["es"]))
        )
        test = phrase.rlike(pattern)
        out = F.when(test, shown) if out is None else out.when(test, shown)
    whole = {word: each for domain in fv.PHRASE_DOMAINS for word, each in fv.LABELS[domain].items()}
    for n, name in enumerate(fv.LOCALES):
        known = F.create_map(*[F.lit(x) for word, each in whole.items() for x in (word, each[n])])
        out = out.when(lang == name, F.coalesce(F.try_element_at(known, phrase), phrase))
    return out.otherwise(phrase)


def map_rows(rows: DataFrame, id_column: str, sources: str, locale: str) -> DataFrame:
    """One (entity, source) row per entry of a map, both labelled."""
    return rows.select(id_column, locale, F.explode(sources).alias("_e", "_s")).select(
        id_column,
        fixed_label("entity", F.col("_e"), normal_locale(F.col(locale))).alias("entity"),
        fixed_label("system", F.col("_s"), normal_locale(F.col(locale))).alias("source"),
    )
