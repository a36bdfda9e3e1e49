"""JSON columns: stable text, shape guards, merging, secret scan."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom import fixed_values as fv
from opsloom.functions.binding import bind
from opsloom.functions.text import strip


def _quoted(c: Column) -> Column:
    """One JSON string literal, escaped by the engine's own writer."""
    wrapped = F.to_json(F.array(c))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def stable_json(c: Column, kind: T.DataType) -> Column:
    """JSON text with sorted keys, ``", "`` and ``": "`` between items."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        items = [
            F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "),
                     stable_json(c[f.name], f.dataType))
            for f in fields
        ]
        body = F.concat(F.lit("{"), F.concat_ws(", ", *items), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: stable_json(x, kind.elementType))
        body = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(
            F.array_sort(F.map_entries(c)),
            lambda e: F.concat(_quoted(e["key"]), F.lit(": "),
                               stable_json(e["value"], kind.valueType)),
        )
        body = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    elif isinstance(kind, T.StringType):
        body = _quoted(c)
    else:
        body = c.cast("string")
    return F.coalesce(body, F.lit("null"))


def labelled_json(label: str, c: Column, kind: T.DataType) -> Column:
    """``label: json``; dropped for NULL, an empty list, map or string."""
    empty = c.isNull()
    if isinstance(kind, (T.ArrayType, T.MapType)):
        empty = empty | (F.size(c) == 0)
    elif isinstance(kind, T.StringType):
        empty = empty | (c == "")
    return F.when(~empty, F.concat(F.lit(f"{label}: "), stable_json(c, kind)))


def json_shape(text: Column) -> Column:
    """``object``, ``array``, ``string`` ... of a JSON text; NULL when invalid."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return (
        F.when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.isin("BIGINT") | kind.startswith("DECIMAL") | kind.isin("DOUBLE"), "number")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
    )


def object_or_empty(text: Column) -> Column:
    return F.when(json_shape(text) == "object", text).otherwise("{}")


def list_or_empty(text: Column) -> Column:
    return F.when(json_shape(text) == "array", text).otherwise("[]")


def merge_maps(left: Column, right: Column) -> Column:
    """Shallow merge, right side wins; a NULL right side keeps the left."""
    kept = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.when(right.isNull(), left).otherwise(F.map_concat(kept, right))


def holds_secret_key(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(fv.SECRET_KEYS))


def record_is_valid(text: Column) -> Column:
    """Three text fields and two lists are present in a JSON record."""
    v = F.try_parse_json(text)

    def kind(field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))

    test = F.lit(True)
    for field in ("version", "feasibility", "automation_mode"):
        test = test & (kind(field) == "STRING")
    for field in ("channels", "systems"):
        test = test & kind(field).startswith("ARRAY")
    return F.coalesce(test, F.lit(False))


@F.pandas_udf(T.StringType())
def _decoded_object(text: pd.Series) -> pd.Series:
    """The object at the first brace of each text, whatever follows it: nesting cannot be tracked by a pattern."""
    decoder = json.JSONDecoder()

    def read(body: str | None) -> str | None:
        at = -1 if body is None else body.find("{")
        if at < 0:
            return None
        try:
            _, end = decoder.raw_decode(body, at)
        except ValueError:
            return None
        return body[at:end]

    return text.map(read)


def first_json_object(text: Column) -> Column:
    """First JSON object inside a model reply; NULL when there is none.

    Code fences go first. Where all from the first brace to the last is one
    JSON value it is the object, which the JVM finds; only what is left (words
    with braces behind the object, loose JSON) is decoded in Python.
    """
    body = strip(F.coalesce(text, F.lit("")))
    body = bind(body, lambda b: F.when(b.startswith("```"), F.regexp_replace(b, r"(?s)^[^\n]*\n?", "")).otherwise(b))
    body = bind(body, lambda b: F.when(b.endswith("```"), F.substring(b, 1, F.length(b) - 3)).otherwise(b))
    whole = F.regexp_extract(body, r"(?s)\{.*\}", 0)

    def alone(w: Column) -> Column:
        # Within brackets nothing may follow the value, and it has to be the only one.
        listed = F.try_parse_json(F.concat(F.lit("["), w, F.lit("]")))
        return F.when((w != "") & listed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull(), w)

    found = bind(whole, alone)
    rest = F.when(found.isNull() & body.contains("{"), body)
    return F.coalesce(found, _decoded_object(rest))
