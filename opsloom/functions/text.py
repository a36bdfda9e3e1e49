"""Column expressions for cleaning, matching and tokenising text.

All of them stay inside the JVM; none needs a Python worker.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsloom import fixed_values as fv
from opsloom.functions.binding import bind

# Python's notion of white space: the Unicode property plus four separators.
WS = r"[\s\x1c-\x1f]"
# Runs of it that are not one plain blank: the others stay as they are.
_WS_RUN = f"(?U) {WS}+|[\\s\\x1c-\\x1f&&[^ ]]{WS}*"
_WS_CHARS = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(c, F.lit(_WS_CHARS))


def clean(c: Column, max_chars: int | None = None) -> Column:
    """Collapse white space runs, trim, NULL to empty, optionally cut.

    Blanks are the only white space that is left to trim, which needs no list of characters.
    """
    out = F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), _WS_RUN, " "))
    return out if max_chars is None else F.substring(out, 1, max_chars)


def default_blank(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def at_least_one(c: Column) -> Column:
    return F.greatest(c, F.lit(1))


def labelled_line(label: str, c: Column) -> Column:
    """``label: value``, or NULL when the cleaned value is blank."""
    return F.concat(F.lit(f"{label}: "), F.nullif(clean(c), F.lit("")))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def preview(c: Column, limit: int = 160) -> Column:
    return bind(strip(c), lambda text: F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    ).otherwise(text))


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility folds from Unicode decompositions, without marks.

    Letters that fold to one other (for ``translate``), and those that fold to
    several, with what they fold to. Hangul syllables are left out: they
    decompose into other letters of their own script.
    """
    source, target, several = [], [], {}
    for code in range(0x80, 0x1FC00):
        letter = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or unicodedata.combining(letter):
            continue
        base = "".join(m for m in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(m))
        if base == letter:
            continue
        if len(base) == 1:
            source.append(letter)
            target.append(base)
        elif base:
            several[letter] = base
    return "".join(source), "".join(target), several


_FOLD_FROM, _FOLD_TO, _FOLD_SEVERAL = _fold_tables()


def _near_ranges(codes: list[int], gap: int = 16) -> str:
    """A pattern for one of the codes or, in the same narrow range, a neighbour."""
    ranges: list[list[int]] = []
    for code in sorted(codes):
        if ranges and code - ranges[-1][1] <= gap:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in ranges) + "]"


_ANY_SEVERAL = _near_ranges([ord(c) for c in _FOLD_SEVERAL])


def _unfold(c: Column) -> Column:
    """Replace letters that fold to several, one map lookup per character."""
    table = F.create_map(*[F.lit(x) for pair in _FOLD_SEVERAL.items() for x in pair])
    return bind(table, lambda m: F.array_join(
        F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), lambda x: F.coalesce(F.try_element_at(m, x), x)), ""))


def match_form(c: Column) -> Column:
    """Accent-free lower case with single spaces, for keyword matching.

    Compatibility forms (ligatures, full-width letters, fractions, signs) become
    the letters they stand for, and every combining mark goes. ASCII texts need
    none of it; of others only the rest that is not ASCII is searched for forms
    of several letters.
    """
    def fold(text: Column) -> Column:
        def several(near: Column) -> Column:
            rest = F.regexp_replace(near, r"[\x00-\x7F]+", "")
            return F.when(rest.rlike(_ANY_SEVERAL), _unfold(near)).otherwise(near)

        other = F.regexp_replace(bind(F.translate(text, _FOLD_FROM, _FOLD_TO), several), r"\p{M}+", "")
        return F.when(F.octet_length(text) == F.length(text), text).otherwise(other)

    return clean(F.lower(bind(F.coalesce(c, F.lit("")), fold)))


def match_key(word: str) -> str:
    """The same form for a keyword known at planning time."""
    bare = "".join(
        m for m in unicodedata.normalize("NFKD", word or "") if not unicodedata.combining(m)
    )
    return " ".join(bare.lower().split())


def any_of(keywords: Sequence[str]) -> str:
    """Pattern that finds any keyword in text already in match form."""
    keys = sorted({match_key(k) for k in keywords} - {""})
    return "|".join(re.escape(k) for k in keys)


def contains_any(haystack: Column, keywords: Sequence[str]) -> Column:
    """Whether text already in match form holds any keyword.

    One pattern, so the haystack is evaluated once even inside a lambda.
    """
    return haystack.rlike(any_of(keywords))


def item_matches(fields: Sequence[Column], keywords: Sequence[str]) -> Column:
    """Keyword test over several text fields of one item."""
    return contains_any(F.concat_ws(" ", *[match_form(f) for f in fields]), keywords)


def keyword_hits(values: Column, keywords: Sequence[str], limit: int = 8) -> Column:
    """Keywords, in declared order, found in any of the values; first ``limit``."""
    words = list(dict.fromkeys(keywords))

    def search(forms: Column) -> Column:
        def among(key: str) -> Column:
            return F.exists(forms, lambda v: v.contains(key))

        return F.array(*[F.when(among(match_key(word)), F.lit(word)) for word in words])

    return F.slice(F.array_compact(bind(F.transform(values, match_form), search)), 1, limit)


def first_text_match(values: Column, keywords: Sequence[str]) -> Column:
    """First value that holds a keyword, cleaned and cut; empty when none."""
    hit = F.filter(values, lambda v: contains_any(match_form(v), keywords))
    return F.coalesce(clean(F.get(hit, F.lit(0)), 200), F.lit(""))


def with_forms(values: Column) -> Column:
    """Each value next to its match form, so that several tests fold it once: struct<line, form>."""
    return F.transform(values, lambda v: F.struct(v.alias("line"), match_form(v).alias("form")))


def first_form_match(pairs: Column, keywords: Sequence[str]) -> Column:
    """``first_text_match`` over values ``with_forms``."""
    hit = F.filter(pairs, lambda p: contains_any(p["form"], keywords))
    return F.coalesce(clean(F.get(hit, F.lit(0))["line"], 200), F.lit(""))


def first_long_text(values: Column, min_len: int = 3) -> Column:
    """First value of at least ``min_len`` characters after cleaning."""
    cleaned = F.transform(values, lambda v: clean(v, 200))
    hit = F.filter(cleaned, lambda v: F.length(v) >= min_len)
    return F.coalesce(F.get(hit, F.lit(0)), F.lit(""))


_CLOCK = r"(?U)\b\d{1,2}:\d{2}\b"
_DATE = r"(?U)\b\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?\b"


def looks_like_time(c: Column) -> Column:
    return bind(clean(c, 200), lambda text: contains_any(match_form(text), fv.QUESTION_TIME)
                | text.rlike(f"{_CLOCK}|{_DATE}"))


def first_time_hint(values: Column) -> Column:
    hit = F.filter(values, looks_like_time)
    return F.coalesce(clean(F.get(hit, F.lit(0)), 200), F.lit(""))


def first_form_time(pairs: Column) -> Column:
    """``first_time_hint`` over values ``with_forms``."""
    hit = F.filter(pairs, lambda p: contains_any(p["form"], fv.QUESTION_TIME) | p["line"].rlike(f"{_CLOCK}|{_DATE}"))
    return F.coalesce(clean(F.get(hit, F.lit(0))["line"], 200), F.lit(""))


def is_noise_form(form: Column) -> Column:
    return form.rlike(r"(?U)^$|^\d+\s*/\s*\d+|" + any_of(fv.QUESTION_NOISE))


def is_noise_line(c: Column) -> Column:
    return is_noise_form(match_form(c))


# Line ends that Python's splitlines knows.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def visible_lines(c: Column) -> Column:
    """Compact, non-empty lines of a text, each cut to 200 characters."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), LINE_END), lambda s: clean(s, 200))
    return F.filter(lines, lambda s: s != "")


def tokens(c: Column) -> Column:
    """Lower-case word tokens without stopwords; NULL text gives an empty list."""
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({fv.TOKEN_PATTERN})"))
    return F.filter(F.transform(words, F.lower), lambda t: ~t.isin(*fv.STOPWORDS))


def all_words(c: Column) -> Column:
    """Lower-case words including stopwords: positions for cover density."""
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({fv.TOKEN_PATTERN})"))
    return F.transform(words, F.lower)


def query_tokens(text: str) -> list[str]:
    """Tokens of a query given as a plain string."""
    words = re.findall(fv.TOKEN_PATTERN, text or "")
    return [w.lower() for w in words if w.lower() not in fv.STOPWORDS]


def known_systems(c: Column) -> Column:
    """Systems named in a text as whole words, in list order."""
    def named(low: Column) -> Column:
        # The name comes first in the pattern: word ends are tested where it stands, not at every letter.
        return F.array_compact(F.array(*[
            F.when(low.contains(s) & low.rlike(rf"(?U){re.escape(s)}\b(?<=\b{re.escape(s)})"), F.lit(s))
            for s in fv.KNOWN_SYSTEMS]))

    return bind(F.lower(F.coalesce(c, F.lit(""))), named)


def kpi_source(kpi: Column, area: Column) -> Column:
    """Source of a KPI by the first rule whose word occurs in area and name."""
    text = F.lower(F.concat_ws(" ", F.coalesce(area, F.lit("")), F.coalesce(kpi, F.lit(""))))
    out = None
    for words, source in fv.KPI_SOURCE_RULES:
        test = text.rlike("|".join(re.escape(w) for w in words))
        out = F.when(test, source) if out is None else out.when(test, source)
    return out.otherwise(fv.KPI_SOURCE_DEFAULT)


def score_band(c: Column) -> Column:
    """Message for a score: at least 80, at least 50, or lower; NULL has none."""
    high, mid, low = fv.SCORE_BANDS
    return F.when(c >= high[0], high[1]).when(c >= mid[0], mid[1]).when(c.isNotNull(), low[1])


def database_name(url: Column) -> Column:
    """Path of a connection URL without its leading slash, or ``unknown``."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.nullif(F.ltrim(path, F.lit("/")), F.lit("")), F.lit("unknown"))


def noon_utc(c: Column) -> Column:
    """A date-only value read as noon of that day."""
    return F.to_timestamp_ntz(F.concat(c.cast("string"), F.lit(" 12:00:00")))


def sheet_column(ref: Column) -> Column:
    return F.regexp_replace(ref, r"\d+", "")


def numbered_prompt(chunks: Column) -> Column:
    """``[n] title`` and content blocks for an ordered array of chunks."""
    parts = F.transform(
        chunks,
        lambda x, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] "), x["title"], F.lit("\n"), x["content"]
        ),
    )
    return F.array_join(parts, "\n\n")
