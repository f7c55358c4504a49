"""Exact distinct counts that roll up: bitmaps of whole numbers by bucket, or-ed to any span."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .timeseries import distinct_names


def bitmaps(rows: DataFrame, start: Column, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bucket_start, part, bits): which numbers each bucket has seen, in bitmaps of 32,768 numbers.

    A row a bucket, key and bitmap that has a number at all: for numbers that lie close, as ids that are counted
    upwards, this is a bit for each. Nulls are not counted; a column of other values is refused.
    """
    distinct_names(keys, "bucket_start", "part", "bits")
    if not isinstance(rows.schema[column].dataType, IntegralType):
        raise ValueError(f"{column} has to be of whole numbers")
    number = F.col(column).cast("bigint")
    part, place = F.floor(number / 32_768), F.pmod(number, F.lit(32_768))
    seen = rows.where(F.col(column).isNotNull()).groupBy(*keys, start.alias("bucket_start"), part.alias("part"))
    return seen.agg(F.bitmap_construct_agg(place.cast("bigint")).alias("bits"))


def merged(parts: DataFrame, start: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Bitmaps of coarser buckets (or of fewer keys) from those of finer ones; no raw row is read."""
    return parts.groupBy(*keys, start.alias("_start"), "part").agg(F.bitmap_or_agg("bits").alias("bits")).withColumnRenamed("_start", "bucket_start").select(
        *keys, "bucket_start", "part", "bits"
    )


def counted(parts: DataFrame, keys: Sequence[str] = (), name: str = "n") -> DataFrame:
    """The distinct numbers of each bucket."""
    distinct_names([*keys, "bucket_start"], name)
    return parts.groupBy(*keys, "bucket_start").agg(F.sum(F.bitmap_count("bits")).alias(name))


def counted_between(parts: DataFrame, since: str, until: str, keys: Sequence[str] = (), name: str = "n") -> DataFrame:
    """The distinct numbers of all buckets that start in [since, until)."""
    span = parts.where((F.col("bucket_start") >= F.lit(since).cast("timestamp_ntz")) & (F.col("bucket_start") < F.lit(until).cast("timestamp_ntz")))
    return span.groupBy(*keys, "part").agg(F.bitmap_or_agg("bits").alias("bits")).groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias(name))
