"""A log of measurements as a Spark data source that is written and read, in batches and as streams.

``df.write.format("measurement_log").mode("append").save(path)``, ``df.writeStream.format("measurement_log")``,
``spark.read`` and ``spark.readStream`` of the same. A task writes a segment of its own, in Parquet, and tells its name; the
driver commits the segments of a write by one numbered file that names them. Readers see segments of commits alone, so a
task that fails, is tried again or runs twice leaves nothing that anybody reads, and a write that fails deletes its
segments. A stream's offset is the number of commits it has read: a restart goes on behind them. A streaming write commits
under its ``stream`` (an option) and batch number, once: a batch that is tried again finds its commit and adds nothing.

The path is a folder that driver and executors share, in any file system that pyarrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from .measurements import SCHEMA

FORMAT = "measurement_log"


class _Log:
    """Segments and commits of a log."""

    def __init__(self, options: dict):
        from pyarrow import fs

        path = options["path"]
        path = f"file://{path}" if path.startswith("/") else path
        self.fs, self.path = fs.FileSystem.from_uri(path)

    def commits(self) -> list[str]:
        """Names of commits, oldest first."""
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.path}/commits", allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name.endswith(".json"))

    def segments(self, first: int, last: int | None = None) -> list[str]:
        """Segments of the commits from ``first`` on, up to, not including, ``last``."""
        out = []
        for name in self.commits()[first:last]:
            with self.fs.open_input_stream(f"{self.path}/commits/{name}") as f:
                out += json.loads(f.read())["segments"]
        return out

    def put(self, batches: Iterator, key: str) -> tuple[str | None, int]:
        """Write a segment of a writer; a task without rows writes none."""
        import pyarrow.parquet as pq

        name, rows, writer = f"{key}-{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in batches:
                if writer is None:
                    self.fs.create_dir(f"{self.path}/segments", recursive=True)
                    writer = pq.ParquetWriter(f"{self.path}/segments/{name}", batch.schema, filesystem=self.fs)
                writer.write_batch(batch)
                rows += batch.num_rows
        except BaseException:
            if writer is not None:
                writer.close()
                self.drop([name])
            raise
        if writer is not None:
            writer.close()
        return (name if writer is not None else None), rows

    def drop(self, names: list[str]) -> None:
        for name in names:
            try:
                self.fs.delete_file(f"{self.path}/segments/{name}")
            except FileNotFoundError:
                pass

    def abandon(self, key: str) -> None:
        """Delete what a writer has written and not committed, of tasks too that ended before they were heard of."""
        from pyarrow import fs

        kept = {*self.segments(0)}
        found = self.fs.get_file_info(fs.FileSelector(f"{self.path}/segments", allow_not_found=True))
        self.drop([f.base_name for f in found if f.base_name.startswith(f"{key}-") and f.base_name not in kept])

    def commit(self, messages: list, key: str) -> None:
        """Make segments part of the log, under the next number; a key that has its commit gets no other."""
        names = [m.segment for m in messages if m is not None and m.segment]
        before = self.commits()
        if any(c.endswith(f"~{key}.json") for c in before):
            return self.drop(names)
        number = 1 + max((int(c.split("~")[0]) for c in before), default=-1)
        self.fs.create_dir(f"{self.path}/commits", recursive=True)
        staged, final = f"{self.path}/_{uuid.uuid4().hex}", f"{self.path}/commits/{number:012d}~{key}.json"
        with self.fs.open_output_stream(staged) as f:
            f.write(json.dumps({"segments": names, "rows": sum(m.rows for m in messages if m is not None)}).encode())
        self.fs.move(staged, final)


@dataclass
class Written(WriterCommitMessage):
    segment: str | None
    rows: int


@dataclass
class Segment(InputPartition):
    name: str


def _read(log: _Log, name: str) -> Iterator:
    import pyarrow.parquet as pq

    with pq.ParquetFile(f"{log.path}/segments/{name}", filesystem=log.fs) as f:
        yield from f.iter_batches(10_000)


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.options, self.key = dict(options), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        return Written(*_Log(self.options).put(iterator, self.key))

    def commit(self, messages: list) -> None:
        _Log(self.options).commit(messages, self.key)

    def abort(self, messages: list) -> None:
        _Log(self.options).abandon(self.key)


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        if not options.get("stream", "").isalnum():
            raise ValueError("a streaming write needs an option stream, letters and digits, that names it through restarts")
        self.options, self.key = dict(options), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        return Written(*_Log(self.options).put(iterator, self.key))

    def commit(self, messages: list, batchId: int) -> None:
        _Log(self.options).commit(messages, f"{self.options['stream']}-{batchId}")

    def abort(self, messages: list, batchId: int) -> None:
        _Log(self.options).abandon(self.key)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Segment]:
        return [Segment(s) for s in _Log(self.options).segments(0)] or [Segment("")]

    def read(self, partition: Segment) -> Iterator:
        return _read(_Log(self.options), partition.name) if partition.name else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": len(_Log(self.options).commits())}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return [Segment(s) for s in _Log(self.options).segments(start["commits"], end["commits"])]

    def read(self, partition: Segment) -> Iterator:
        return _read(_Log(self.options), partition.name)

    def commit(self, end: dict) -> None:
        """What is read stays in the log for others."""


class MeasurementLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("a log is appended to, not overwritten")
        return Writer(self.options)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options)


def registered(spark: SparkSession) -> SparkSession:
    """The session, with the format known to it."""
    spark.dataSource.register(MeasurementLog)
    return spark
