"""Nested documents: a walk over JSON as variant values, in one pass.

Each round turns a row of the depth reached into itself and its children, so the rows stream through as many generators as there are
levels; nothing is joined or shuffled, and no level is parsed again.

Defined results. Null texts, and texts that are no JSON (also those with a key twice in one object), give no rows. The top value itself has the
path ``$`` and depth 0. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The methods of an interface description.
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def _kind(value: Column) -> Column:
    name = F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)
    return F.when(name == "OBJECT", "object").when(name == "ARRAY", "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number")


def walk(docs: DataFrame, ident: str, column: str, *, depth: int = 4) -> DataFrame:
    """``ident, keys, path, depth, kind, value``: every value down to ``depth``; ``value`` is a text, and null for objects, arrays and null."""
    entry = "struct<keys:array<string>,path:string,depth:int,v:variant>"
    start = F.struct(F.lit([]).cast("array<string>").alias("keys"), F.lit("$").alias("path"), F.lit(0).alias("depth"), F.try_parse_json(column).alias("v")).cast(entry)
    rows = docs.select(ident, start.alias("e")).where("e.v is not null")
    for level in range(depth):
        made = lambda key, path, v: F.struct(F.concat("e.keys", F.array(key)).alias("keys"), F.concat("e.path", path).alias("path"), F.lit(level + 1).alias("depth"), v.alias("v")).cast(entry)  # noqa: E731, B023
        fields = F.transform(F.map_entries(F.try_variant_get("e.v", "$", "map<string,variant>")), lambda x: made(x["key"], F.concat(F.lit("."), x["key"]), x["value"]))
        items = F.transform(F.try_variant_get("e.v", "$", "array<variant>"), lambda v, i: made(i.cast("string"), F.concat(F.lit("["), i.cast("string"), F.lit("]")), v))
        children = F.when(F.col("e.depth") == level, F.coalesce(fields, items, F.lit([]).cast(f"array<{entry}>"))).otherwise(F.lit([]).cast(f"array<{entry}>"))
        rows = rows.select(ident, F.explode(F.concat(F.array("e"), children)).alias("e"))
    kind = _kind(F.col("e.v"))
    text = F.when(kind.isin("object", "array"), None).otherwise(F.try_variant_get("e.v", "$", "string"))
    return rows.select(ident, "e.keys", "e.path", "e.depth", kind.alias("kind"), text.alias("value"))


def type_profile(docs: DataFrame, ident: str, column: str, *, depth: int = 4) -> DataFrame:
    """``path, kind, n``: places, with any place of an array as ``[]``, by the kinds of what stands there."""
    place = F.regexp_replace("path", r"\[\d+\]", "[]")
    return walk(docs, ident, column, depth=depth).groupBy(place.alias("path"), "kind").agg(F.count("*").alias("n"))


def contracts(docs: DataFrame, ident: str, column: str) -> DataFrame:
    """``ident, endpoint, method, operation, summary`` of interface descriptions in JSON: each method beneath ``paths``."""
    rows = walk(docs, ident, column, depth=4).where((F.get("keys", F.lit(0)) == "paths") & F.get("keys", F.lit(2)).isin(*METHODS))
    field = lambda name: F.max(F.when((F.col("depth") == 4) & (F.get("keys", F.lit(3)) == name), F.col("value")))
    return rows.groupBy(ident, F.get("keys", F.lit(1)).alias("endpoint"), F.get("keys", F.lit(2)).alias("method")).agg(field("operationId").alias("operation"), field("summary").alias("summary"))
