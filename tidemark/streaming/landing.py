"""Streams land raw rows only; aggregates are made from the landed table by batch queries, so they are exact.

A watermark would drop late rows; landing sets none, and a late row shows in the next batch query. ``once`` and
``closed_buckets`` do set one, for sources whose lateness is known.
"""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.buckets import SCALE, exact_sum
from ..operators.timeseries import distinct_names
from ..session import unused
from ..sources.measurements import SCHEMA, checked, write_batch, write_rejects


def stream(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = SCHEMA, files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).format(fmt).load(path)


def land(rows: DataFrame, table: str, rejects: str, checkpoint: str, scale: int = SCALE):
    """Write what has arrived and stop. A micro-batch is a batch of the table, so a retried one replaces itself.

    Batches are named by the id that the checkpoint gives the stream and by their number: streams with
    checkpoints of their own, be they over one source, never replace each other's batches.
    """
    spark = rows.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        about = "".join(r.value for r in spark.read.text(f"{checkpoint.rstrip('/')}/metadata").collect())
        name = f"stream-{json.loads(about)['id']}-{number}"
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)  # good and bad rows of one reading
        try:
            good, bad = checked(batch, scale)
            write_batch(good, table, name)
            write_rejects(bad, rejects, name)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(rows: DataFrame, width: str, keys=(), scale: int = SCALE):
    """Counts and exact totals of all that a stream has brought, for a sink in complete mode."""
    distinct_names(keys, "bucket_start", "n", "total")
    w = unused(rows, "w")
    return rows.groupBy(F.window("ts", width).alias(w), *keys).agg(
        F.count("value").alias("n"), exact_sum("value", scale).alias("total")
    ).select(F.col(f"{w}.start").alias("bucket_start"), *keys, "n", "total")


def instant(ts: str) -> Column:
    """A timestamp_ntz in UTC as an instant, which watermarks ask for; the session's zone plays no part."""
    c = F.col(ts)
    seconds = F.unix_date(c.cast("date")).cast("bigint") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return F.timestamp_micros(seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint"))


def once(rows: DataFrame, key: list[str], within: str) -> DataFrame:
    """Rows of a stream without those whose key has come before, if no more than ``within`` lies between their times.

    The state holds keys for that long. A row with a null time has no place in it and goes.
    """
    kept = rows.columns
    name = unused(rows, "at")
    return rows.where("ts is not null").withColumn(name, instant("ts")).withWatermark(name, within).dropDuplicatesWithinWatermark(key).select(*kept)


def closed_buckets(rows: DataFrame, width: str, late: str, keys=(), scale: int = SCALE) -> DataFrame:
    """Exact aggregates of buckets that are over for ``late`` and longer, each sent once, for a sink in append mode.

    What comes even later is dropped by the watermark: only a source that is never later may be read this way,
    for others land the rows and ask the table.
    """
    distinct_names(keys, "bucket_start", "n", "total")
    name, w = unused(rows, "at"), unused(rows, "w")
    timed = rows.withColumn(name, instant("ts")).withWatermark(name, late)
    out = timed.groupBy(F.window(name, width).alias(w), *keys).agg(F.count("value").alias("n"), exact_sum("value", scale).alias("total"))
    start = F.expr("timestamp_ntz '1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.unix_seconds(f"{w}.start").cast("decimal(18,6)"))
    return out.select(start.alias("bucket_start"), *keys, "n", "total")


def closed_sessions(rows: DataFrame, gap: str, late: str, keys, scale: int = SCALE) -> DataFrame:
    """Sessions of keys, rows with less than ``gap`` between neighbours, that are over for ``late`` and longer, each sent once,
    for a sink in append mode.

    The state holds a key's open sessions, and rows that come late join or bridge them. What comes even later is dropped by
    the watermark, as are rows without a time; for sources of unknown lateness land the rows and ask ``sessions``.
    """
    distinct_names(keys, "session_start", "last_ts", "n", "total")
    name, w = unused(rows, "at"), unused(rows, "w")
    timed = rows.where("ts is not null").withColumn(name, instant("ts")).withWatermark(name, late)
    out = timed.groupBy(F.session_window(name, gap).alias(w), *keys).agg(F.count("*").alias("n"), exact_sum("value", scale).alias("total"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.select(*keys, F.col("first").alias("session_start"), F.col("last").alias("last_ts"), "n", "total")


def appended(rows: DataFrame, path: str, checkpoint: str):
    """Write what a stream has brought to a table and stop; the sink's log makes each micro-batch count once."""
    return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
