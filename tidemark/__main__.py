"""Commands: ``python -m tidemark load|ingest|query|reconcile|layouts ...``; each prints one JSON line."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import time

from pyspark.sql import functions as F

from .functions.buckets import bucket, micros
from .operators.timeseries import coarser, reconciled
from .plans.query import BucketQuery
from .session import session
from .sources import clustered, generator
from .sources import measurements as m


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    load = commands.add_parser("load", help="generate rows and write them as a batch")
    load.add_argument("--rows", type=int, default=100_000)
    ingest = commands.add_parser("ingest", help="check a file and write its good rows as a batch")
    ingest.add_argument("--file", required=True)
    ingest.add_argument("--format", default="parquet")
    for command in (load, ingest):
        command.add_argument("--batch", required=True)
    query = commands.add_parser("query", help="time exact aggregates by bucket")
    query.add_argument("--width", default="1 hour")
    query.add_argument("--since")
    query.add_argument("--until")
    query.add_argument("--by", nargs="*", default=[])
    check = commands.add_parser("reconcile", help="compare days from raw rows with days from hours")
    layouts = commands.add_parser("layouts", help="what a query of some hours reads of rows as they came, sorted by time, and split by day")
    layouts.add_argument("--rows", type=int, default=1_000_000)
    layouts.add_argument("--hours", type=int, default=2)
    for command in (load, ingest, query, check, layouts):
        command.add_argument("--table", required=True)
    return top


def _layouts(spark, path: str, rows: int, hours: int) -> dict:
    """For each layout of the same generated rows: rows and files that the scan of one range hands on, and seconds."""
    made = generator.load(spark, rows, seconds=5).withColumn(m.INDEX, micros("ts"))
    made.repartition(8, F.rand(3)).write.mode("overwrite").option("parquet.block.size", 1 << 20).parquet(f"{path}/as_it_came")
    clustered.sorted_table(made, f"{path}/sorted", ["ts"], 8, 1 << 20)
    m.write_batch(made, f"{path}/by_day", "all")
    number = f"{m.SCHEMA}, {m.INDEX} bigint"
    tables = {"as_it_came": m.read(spark, f"{path}/as_it_came", schema=number), "sorted": m.read(spark, f"{path}/sorted", schema=number)}
    tables |= {"sorted, by the timestamp alone": m.read(spark, f"{path}/sorted"), "by_day": m.read_table(spark, f"{path}/by_day"), "by_day, with the number": m.read_table(spark, f"{path}/by_day", indexed=True)}
    start = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rows * 5 // 2)
    ask = BucketQuery("15 minutes").between(str(start), str(start + dt.timedelta(hours=hours)))
    out = {}
    for name, table in tables.items():
        began, found = time.perf_counter(), ask.run(table)
        buckets = len(found.collect())
        out[name] = {"buckets": buckets, "seconds": round(time.perf_counter() - began, 2)} | clustered.scanned(found)
    return out


def main(words: list[str] | None = None) -> dict:
    given = arguments().parse_args(words)
    spark, began = session(), time.perf_counter()
    out: dict = {"command": given.command}
    if given.command == "load":
        m.write_batch(generator.load(spark, given.rows), given.table, given.batch)
        out["rows"] = given.rows
    elif given.command == "ingest":
        good, bad = m.checked(m.read(spark, given.file, given.format))
        m.write_batch(m.deduplicated(good), given.table, given.batch)
        m.write_rejects(bad, f"{given.table.rstrip('/')}-rejects", given.batch)
        out["refused"] = bad.count()
    elif given.command == "layouts":
        out |= _layouts(spark, given.table, given.rows, given.hours)
    elif given.command == "query":
        found = BucketQuery(given.width).between(given.since, given.until).by(*given.by).run(m.read_table(spark, given.table, indexed=True))
        out |= found.agg(F.count("*").alias("buckets"), F.sum("n").alias("rows"), F.sum("total").cast("string").alias("total")).first().asDict()
    else:
        rows = m.read_table(spark, given.table)
        days = coarser(BucketQuery("1 hour").run(rows), bucket("bucket_start", "1 day")).select("bucket_start", "n", "total")
        out["differences"] = reconciled(days, BucketQuery("1 day").run(rows).select("bucket_start", "n", "total")).count()
    out["seconds"] = round(time.perf_counter() - began, 3)
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
