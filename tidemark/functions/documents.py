"""Canonical JSON: keys sorted at every depth, two spaces of indentation, text as it is, by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INDENT = 2
#: Characters that JSON writes as hexadecimal numbers with letters: small letters here.
CONTROLS = [f"{i:04X}" for i in range(32) if f"{i:04X}" != f"{i:04x}"]


def quoted(text: Column) -> Column:
    """A text as a JSON string: quotes, backslashes and control characters are escaped, nothing else."""
    raw = F.to_json(F.struct(text.alias("t")))
    out = F.substring(raw, F.lit(6), F.length(raw) - 6)
    small = out
    for c in CONTROLS:
        small = F.regexp_replace(small, rf"(?<!\\)((?:\\\\)*)\\u{c}", rf"$1\\u{c.lower()}")
    return F.when(text.isNotNull(), F.when(F.contains(out, F.lit("\\u00")), small).otherwise(out))


def scalar(v: Column, kind: Column) -> Column:
    """A whole number that was written with a point keeps one digit after it."""
    plain = F.to_json(v)
    pointed = kind.rlike(r"^DECIMAL\(\d+,0\)") & (F.length(plain) < 19)
    return F.when(kind == "STRING", quoted(F.try_variant_get(v, "$", "string"))).when(pointed, F.concat(plain, F.lit(".0"))).otherwise(plain)


def canonical(v: Column, depth: int = 12, level: int = 0) -> Column:
    """A VARIANT as an indented JSON text with sorted keys.

    Children of objects and arrays are taken alike, as pairs of key and value, so one expression stands in the next for each level.
    A value deeper than ``depth`` is an error, never a shortened text. Numbers are written as Spark writes them: a number with an
    exponent or more digits than a double holds keeps that form.
    """
    kind = F.schema_of_variant(v)
    is_object, is_array = kind.startswith("OBJECT"), kind.startswith("ARRAY")
    if level == depth:
        return F.when(is_object | is_array, F.raise_error(F.lit(f"a document is nested more than {depth} deep"))).otherwise(scalar(v, kind))
    pair = "array<struct<key:string,value:variant>>"
    of_object = F.array_sort(F.transform(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), lambda k: k))
    members = F.transform(of_object, lambda k: F.struct(k.alias("key"), F.element_at(F.try_variant_get(v, "$", "map<string,variant>"), k).alias("value")))
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    children = F.when(is_object, members.cast(pair)).when(is_array, items.cast(pair))
    pad, inner = " " * (INDENT * level), " " * (INDENT * (level + 1))
    line = lambda c: F.concat(F.lit(inner), F.coalesce(F.concat(quoted(c["key"]), F.lit(": ")), F.lit("")), canonical(c["value"], depth, level + 1))
    body = F.concat(F.lit("\n"), F.array_join(F.transform(children, line), ",\n"), F.lit(f"\n{pad}"))
    opening, closing = F.when(is_object, "{").otherwise("["), F.when(is_object, "}").otherwise("]")
    full = F.concat(opening, F.when(F.size(children) > 0, body).otherwise(""), closing)
    return F.when(is_object | is_array, full).otherwise(scalar(v, kind))


def canonical_json(document: Column, depth: int = 12) -> Column:
    """A JSON text in canonical form, with a newline at its end; null where it is no JSON."""
    return F.concat(canonical(F.try_parse_json(document), depth), F.lit("\n"))
