"""Expressions over the free-form JSON metadata column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "{}"


def as_map(c: Column) -> Column:
    """JSON object text as ``map<string,variant>``; null for anything that is not an object."""
    return F.from_json(c, "MAP<STRING, VARIANT>")


def as_json(c: Column) -> Column:
    """``map<string,variant>`` back to JSON text."""
    return F.to_json(F.to_variant_object(c))


def decoded(c: Column) -> Column:
    """Parsed metadata as VARIANT; malformed text gives null, the row stays."""
    return F.try_parse_json(c)


def encoded(c: Column) -> Column:
    """Metadata text as stored: an empty object when nothing was given."""
    return F.coalesce(c, F.lit(EMPTY))


def merged(old: Column, new: Column) -> Column:
    """Shallow merge: keys of ``new`` replace keys of ``old``, nested objects are replaced whole.

    A null ``new`` leaves ``old`` untouched; a malformed ``old`` counts as empty.
    """
    new_map = as_map(new)
    old_map = F.coalesce(as_map(old), as_map(F.lit(EMPTY)))
    kept = F.map_filter(old_map, lambda k, _: ~F.map_contains_key(new_map, k))
    return F.when(new_map.isNull(), old).otherwise(as_json(F.map_concat(kept, new_map)))


def access_count(c: Column) -> Column:
    """Numeric ``access_count`` above zero, otherwise 1.0.

    Strings and booleans count as absent; reading the one field with a numeric
    schema refuses both.
    """
    n = F.from_json(c, "access_count DOUBLE", {"allowNonNumericNumbers": "false"})["access_count"]
    return F.when(n > 0, n).otherwise(F.lit(1.0))
