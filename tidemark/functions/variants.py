"""JSON documents as VARIANT: parsed once a row, then asked for any number of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import unused


def parsed_json(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with ``column`` parsed as ``name``, once a row whatever is asked of it; null where it is no JSON."""
    if name in rows.columns:
        raise ValueError(f"there is a column {name} already")
    # an exploded list of one is a barrier: paths above it do not parse the text again
    return rows.select("*", F.explode(F.array(F.try_parse_json(column))).alias(name))


def paths(rows: DataFrame, column: str, **asked: tuple[str, str]) -> DataFrame:
    """``rows`` with a column for each ``name=(path, type)``. A path that is missing, a value that cannot be taken for the
    type and a text that is no JSON are null."""
    name = unused(rows, "_json", *asked)
    if clash := sorted(set(asked) & set(rows.columns)):
        raise ValueError(f"there are columns {clash} already")
    found = parsed_json(rows, column, name)
    return found.select(*rows.columns, *(F.try_variant_get(F.col(name), path, kind).alias(n) for n, (path, kind) in asked.items()))


def kinds(rows: DataFrame, column: str, path: str) -> DataFrame:
    """(kind, n): the type of the value at a path, as ``schema_of_variant`` names it, over all rows."""
    name = unused(rows, "_json")
    at = F.try_variant_get(F.col(name), path, "variant")
    return parsed_json(rows, column, name).groupBy(F.schema_of_variant(at).alias("kind")).agg(F.count("*").alias("n"))


def exploded(rows: DataFrame, column: str, path: str, kind: str, position: str = "pos", value: str = "value") -> DataFrame:
    """A row for each element of the array at ``path``, with its position from 0; rows without one are left out."""
    name, items = unused(rows, "_json"), unused(rows, "_items")
    if clash := sorted({position, value} & set(rows.columns)):
        raise ValueError(f"there are columns {clash} already")
    listed = parsed_json(rows, column, name).select(*rows.columns, F.try_variant_get(F.col(name), path, "array<variant>").alias(items))
    return listed.select(*rows.columns, F.posexplode(items).alias(position, "_item")).select(*rows.columns, position, F.try_variant_get(F.col("_item"), "$", kind).alias(value))
