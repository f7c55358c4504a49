"""Bucket totals of a stream that correct themselves: a late row takes its bucket's old total back and sends the new one.

The result is a change log. A row with ``sign`` 1 sends what a bucket amounts to now, one with -1 takes back what was sent
before, so that the log, added up, equals the aggregates of all rows at any time, however late they came within the bound.
Keyed state holds what was sent for each bucket; a timer at the bucket's end, as the watermark sees it, clears it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.buckets import SCALE, exact
from ..operators.timeseries import distinct_names, seconds_of
from ..session import unused
from .landing import instant

#: Keyed state with timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Corrections(StatefulProcessor):
    """For each key and bucket (and slice): what was sent last, and a timer that forgets it."""

    def __init__(self, keys: int, wide_ms: int, scale: int):
        self.keys, self.wide_ms, self.scale = keys, wide_ms, scale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", f"n bigint, total decimal(38,{self.scale})")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        n, total = 0, None
        for part in rows:
            values = [v for v in part["v"] if v is not None and v == v]
            n += len(values)
            if values:
                total = sum(values, total if total is not None else Decimal(0))
        out = []
        if self.sent.exists():
            old_n, old_total = self.sent.get()
            if n == 0:  # nothing that counts has come
                return
            out.append((-1, old_n, old_total))
            n, total = n + old_n, (total or Decimal(0)) + (old_total if old_total is not None else Decimal(0))
        else:
            self.handle.registerTimer((int(key[0]) + 1) * self.wide_ms)
        out.append((1, n, total))
        self.sent.update((n, total))
        yield pd.DataFrame([(s, key[0], *key[1 : 1 + self.keys], m, t) for s, m, t in out], columns=["sign", "number", *(f"k{i}" for i in range(self.keys)), "n", "total"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.sent.clear()
        return iter(())

    def close(self) -> None:
        pass


def corrected_buckets(rows: DataFrame, width: str, within: str, keys: Sequence[str] = (), scale: int = SCALE, slices: int = 1) -> DataFrame:
    """(sign, bucket_start, keys, n, total): the change log of exact bucket totals of a stream, for a sink
    in update mode that keeps every row (``logged``).

    Rows that come no later than ``within`` after the latest one correct their bucket; what comes even later is dropped by
    the watermark, as is a row without a time, so for sources of unknown lateness land the rows instead. Each
    bucket of a key is one task's state unless ``slices`` deals it to several: these send sums of their own, which add up.
    """
    distinct_names(keys, "sign", "bucket_start", "n", "total", "number", "v")
    seconds = seconds_of(width)
    at = unused(rows, "at")
    names = [f"k{i}" for i in range(len(keys))]
    timed = rows.where("ts is not null").withColumn(at, instant("ts")).withWatermark(at, within)
    number = F.floor(F.unix_micros(at) / (seconds * 1_000_000)).cast("bigint")
    slim = timed.select(
        at, number.alias("number"), *(F.col(k).alias(n) for k, n in zip(keys, names)), F.pmod(F.xxhash64(*rows.columns), F.lit(slices)).cast("int").alias("slice"), exact("value", scale).alias("v")
    )
    kinds = ", ".join([*(f"{n} {rows.schema[k].dataType.simpleString()}" for k, n in zip(keys, names)), f"n bigint, total decimal(38,{scale})"])
    log = slim.groupBy("number", *names, "slice").transformWithStateInPandas(
        Corrections(len(keys), seconds * 1000, scale), f"sign int, number bigint, {kinds}", "Update", "EventTime"
    )
    start = F.expr("timestamp_ntz '1970-01-01 00:00:00'") + F.make_dt_interval(secs=(F.col("number") * seconds).cast("decimal(18,6)"))
    return log.select("sign", start.alias("bucket_start"), *(F.col(n).alias(k) for k, n in zip(keys, names)), "n", "total")


def logged(changes: DataFrame, path: str, checkpoint: str):
    """Append a change log to a table and stop; a micro-batch that is tried again replaces its own rows.

    The stream gets the store that keyed state with timers needs; other streams of the session keep theirs.
    """
    conf, name = changes.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    before = conf.get(name, None)
    conf.set(name, STORE)
    try:
        return _started(changes, write, checkpoint)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def _started(changes: DataFrame, write, checkpoint: str):
    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str, changes: DataFrame) -> DataFrame:
    """The change log that ``logged`` has written, by the schema of the changes."""
    return spark.read.schema(changes.schema).parquet(path)


def folded(log: DataFrame, keys: Sequence[str] = (), scale: int = SCALE) -> DataFrame:
    """The totals that a change log amounts to; a bucket in which no value counts has n 0 and no total."""
    n, total = F.sum(F.col("sign") * F.col("n")), F.sum(F.col("sign") * F.col("total"))
    return log.groupBy("bucket_start", *keys).agg(n.alias("n"), F.when(n > 0, total).cast(f"decimal(38,{scale})").alias("total"))
