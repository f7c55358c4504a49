"""A load of measurements as a Spark data source of its own: ``spark.read.format("measurements")``.

Options: ``rows``, ``start``, ``seconds`` between rows, ``partitions``. Rows are the same for any number of
partitions; no row is held beyond its Arrow batch.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .measurements import SCHEMA

KINDS = ("click", "view", "purchase", "signup", "error")
BATCH = 10_000


class Span(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.rows, self.parts = int(options.get("rows", 1000)), max(1, int(options.get("partitions", 8)))
        self.start, self.seconds = dt.datetime.fromisoformat(options.get("start", "2024-01-01")), int(options.get("seconds", 30))

    def partitions(self) -> list[Span]:
        edges = [self.rows * k // self.parts for k in range(self.parts + 1)]
        return [Span(a, b) for a, b in zip(edges, edges[1:])]

    def read(self, partition: Span) -> Iterator:
        import numpy as np
        import pyarrow as pa

        first = np.datetime64(self.start, "us")
        for low in range(partition.low, partition.high, BATCH):
            at = np.arange(low, min(low + BATCH, partition.high), dtype=np.int64)
            mix = (at * 2_654_435_761 + 12_345) % (1 << 31)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(first + at * self.seconds * np.timedelta64(1_000_000, "us")), pa.array(mix % 150), pa.array([KINDS[k] for k in mix % 5]),
                 pa.array((mix % 50_000) / 100), pa.array([f'{{"k": {k}}}' for k in mix % 100])],
                names=["event_id", "ts", "user_id", "event_type", "value", "props"],
            )


class Measurements(DataSource):
    @classmethod
    def name(cls) -> str:
        return "measurements"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def load(spark: SparkSession, rows: int, **options) -> DataFrame:
    """``rows`` generated measurements."""
    spark.dataSource.register(Measurements)
    return spark.read.format("measurements").options(rows=rows, **options).load()
