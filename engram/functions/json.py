"""JSON objects changed key by key: what isn't named keeps its type and its place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.text import col

VALUES = "map<string,variant>"


def with_keys(metadata, values: dict[str, Column]) -> Column:
    """A JSON object (null or no object: an empty one) with these keys set, in order behind the others; values are variants, and a null value leaves the key as it is."""
    old = F.coalesce(F.from_json(col(metadata), VALUES), F.from_json(F.lit("{}"), VALUES))
    keys = F.array(*[F.when(v.isNotNull(), F.lit(k)) for k, v in values.items()])
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.array_contains(F.array_compact(keys), k), F.lit(False)))
    new = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values())), lambda _, v: v.isNotNull())
    return F.to_json(F.map_concat(kept, new))


def merged(metadata, patch) -> Column:
    """A JSON object with the keys of another put over its own."""
    a, b = (F.coalesce(F.from_json(col(c), VALUES), F.from_json(F.lit("{}"), VALUES)) for c in (metadata, patch))
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))


def variant(value) -> Column:
    """A text, number or boolean as a JSON value."""
    return col(value).cast("variant")


def variants(value) -> Column:
    """An array, struct or map as a JSON value."""
    return F.to_variant_object(col(value))
