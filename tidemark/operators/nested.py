"""Nested documents as rows of their scalars, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def _children(level: DataFrame) -> DataFrame:
    """doc, place, key, text and kind of what the objects and arrays of ``level`` (doc, place, text, kind) hold, in their order.

    An object is read twice in the order of its text: as texts, and as variants that tell what the texts are. A variant alone
    would not do: it keeps the fields of an object in the order of their names.
    """
    as_text, as_kind = F.from_json("text", "map<string,string>"), F.from_json("text", "map<string,variant>")
    fields = level.where("kind = 'OBJECT'").select("doc", "place", F.arrays_zip(F.map_keys(as_text).alias("key"), F.map_values(as_text).alias("text"), F.transform(F.map_values(as_kind), _kind).alias("kind")).alias("held"))
    items_text, items_kind = F.from_json("text", "array<string>"), F.from_json("text", "array<variant>")
    items = level.where("kind = 'ARRAY'").select("doc", "place", F.transform(F.arrays_zip(items_text.alias("text"), F.transform(items_kind, _kind).alias("kind")), lambda v, i: F.struct(i.cast("string").alias("key"), v["text"].alias("text"), v["kind"].alias("kind"))).alias("held"))
    each = fields.unionByName(items).select("doc", "place", F.posexplode("held").alias("at", "h"))
    return each.select("doc", F.concat("place", F.array("at")).alias("place"), F.col("h.key").alias("key"), F.col("h.text").alias("text"), F.coalesce("h.kind", F.lit("VOID")).alias("kind"))


def scalars(documents: DataFrame, most_levels: int = 100) -> DataFrame:
    """doc, place, key, value of every scalar in documents (doc, text as JSON); null stays null, texts are without quotes.

    ``place`` holds the positions from the top, so its order is that in which the document is read; an item's key is its
    number. Each level of all documents is one pass, written to the shared folder, and there are as many as the deepest
    document has; no document is read by recursion. Texts that are no object or array give no rows.
    """
    parsed = F.try_parse_json("text")
    level = written(documents.select("doc", F.array().cast("array<int>").alias("place"), F.lit(None).cast("string").alias("key"), "text", F.when(parsed.isNotNull(), _kind(parsed)).alias("kind")).where("kind in ('OBJECT', 'ARRAY')"), "level")
    out = None
    for _ in range(most_levels):
        below = written(_children(level), "level")
        leaves = below.where("kind not in ('OBJECT', 'ARRAY')").select("doc", "place", "key", F.when(F.col("kind") != "VOID", F.col("text")).alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        level = below.where("kind in ('OBJECT', 'ARRAY')")
        if level.isEmpty():
            return out
    raise ValueError(f"documents are nested more than {most_levels} levels deep")


def flattened(documents: DataFrame) -> DataFrame:
    """doc, name, value: each document's scalars by name, letters and digits of the key in small letters; the last one of a name wins.

    A name is one row, however often it occurs: tasks combine theirs before the exchange.
    """
    name = F.regexp_replace(F.lower("key"), "[^a-z0-9]", "")
    return scalars(documents).groupBy("doc", name.alias("name")).agg(F.max_by("value", "place").alias("value"))
