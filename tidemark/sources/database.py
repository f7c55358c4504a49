"""Batches in a database that executors reach through Python's DB-API: replay-safe writes, scans in ranges.

As ``measurements.write_jdbc`` and ``read_jdbc``, for databases with a DB-API driver (PEP 249) and no jar. ``connect`` opens
a connection and is sent to the executors, so what it opens has to be one database from wherever it is called: a server,
or an SQLite file in a folder that driver and executors share (``shared_file``).

Columns are whole numbers, doubles, texts, bytes and times without a zone, which are stored as microseconds since 1970.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Callable
from contextlib import closing

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE PRECISION", "string": "TEXT", "binary": "BLOB", "timestamp_ntz": "BIGINT"}
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
#: Rows that are sent to or taken from the database at once.
ROWS = 20_000


def shared_file(path: str, patience: float = 3600) -> Callable:
    """Connections to an SQLite file; one writes at a time, others wait for it, for so many seconds at most."""
    path = path.removeprefix("file://")

    def connect():
        return sqlite3.connect(path, timeout=patience, isolation_level="IMMEDIATE")

    return connect


def _kinds(schema: StructType) -> list[str]:
    if odd := [f.name for f in schema if f.dataType.simpleString() not in _KINDS]:
        raise ValueError(f"columns of a type that is not stored: {odd}")
    return [_KINDS[f.dataType.simpleString()] for f in schema]


def _plain(column: pa.Array) -> list:
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.int64())
    elif pa.types.is_floating(column.type) and pc.any(pc.is_nan(column)).as_py():
        raise ValueError("a database may keep no NaN")
    return column.to_pylist()


def write(rows: DataFrame, connect: Callable, table: str, batch_id: str, mark: str = "?") -> None:
    """Write a batch to a table with a column ``batch_id``; writing it again replaces it. The table is made if there is none.

    Tasks fill a table of the batch's own, ``<table>_fresh``, each in one transaction that notes the task in ``<table>_tasks``,
    so a task that runs again adds nothing; then one transaction on the driver takes the batch's old rows out and the new ones in, within the
    database, so readers see either. Writers to one table must not overlap. ``mark`` is the driver's sign for a parameter.
    """
    rows, fresh, tasks = rows.drop("batch_id"), f"{table}_fresh", f"{table}_tasks"
    names = ", ".join(f'"{c}"' for c in rows.columns)
    columns = ", ".join(f'"{c}" {kind}' for c, kind in zip(rows.columns, _kinds(rows.schema)))
    put = f"INSERT INTO {fresh} VALUES ({', '.join([mark] * len(rows.columns))})"

    def run(batches):
        part = TaskContext.get().partitionId()
        with closing(connect()) as link:
            cursor = link.cursor()
            cursor.execute(f"SELECT 1 FROM {tasks} WHERE task = {mark}", (part,))
            if cursor.fetchone():
                return
            cursor.execute(f"INSERT INTO {tasks} VALUES ({mark})", (part,))
            for batch in batches:
                for low in range(0, batch.num_rows, ROWS):
                    some = batch.slice(low, ROWS)
                    cursor.executemany(put, zip(*map(_plain, some.columns)))
            link.commit()
        yield from ()

    with closing(connect()) as link:
        cursor = link.cursor()
        for name in (fresh, tasks):
            cursor.execute(f"DROP TABLE IF EXISTS {name}")
        cursor.execute(f"CREATE TABLE {fresh} ({columns})")
        cursor.execute(f"CREATE TABLE {tasks} (task BIGINT PRIMARY KEY)")
        cursor.execute(f"CREATE TABLE IF NOT EXISTS {table} ({columns}, batch_id TEXT)")
        link.commit()
        rows.mapInArrow(run, "done int").write.format("noop").mode("overwrite").save()
        cursor.execute(f"DELETE FROM {table} WHERE batch_id = {mark}", (batch_id,))
        cursor.execute(f"INSERT INTO {table} ({names}, batch_id) SELECT {names}, {mark} FROM {fresh}", (batch_id,))
        for name in (fresh, tasks):
            cursor.execute(f"DROP TABLE {name}")
        link.commit()


def read(spark: SparkSession, connect: Callable, table: str, schema: str, column: str, bounds: tuple, parts: int = 16, mark: str = "?") -> DataFrame:
    """Rows of a table in parallel ranges of a column of whole numbers; the bounds only deal the rows to the tasks, and all are read."""
    made = StructType.fromDDL(schema)
    _kinds(made)
    kinds = [f.dataType.simpleString() for f in made]
    names = ", ".join(f'"{c}"' for c in made.names)
    low, high = (0, 0) if None in bounds else bounds
    edges = sorted({low + (high + 1 - low) * k // parts for k in range(1, parts)}) if parts > 1 else []

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                wanted, values = [], []
                if k:
                    wanted, values = [f'"{column}" >= {mark}'], [edges[k - 1]]
                if k < len(edges):
                    wanted, values = [*wanted, f'"{column}" < {mark}'], [*values, edges[k]]
                where = " AND ".join(wanted) or "1 = 1"
                with closing(connect()) as link:
                    cursor = link.cursor()
                    cursor.execute(f'SELECT {names} FROM {table} WHERE {where}' + ("" if k else f' OR "{column}" IS NULL'), values)
                    while found := cursor.fetchmany(ROWS):
                        yield pa.RecordBatch.from_arrays([_array(c, kind) for c, kind in zip(zip(*found), kinds)], names=made.names)

    ranges = spark.range(0, len(edges) + 1, 1, len(edges) + 1)
    return ranges.mapInArrow(run, made)


def _array(values: tuple, kind: str) -> pa.Array:
    if kind == "timestamp_ntz":
        return pa.array(values, pa.int64()).cast(pa.timestamp("us"))
    return pa.array(values, _ARROW[kind])
