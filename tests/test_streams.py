"""Corrections of bucket totals, and the log that is written and streamed."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.buckets import bucket, exact_sum
from tidemark.operators import timeseries as t
from tidemark.sources import log
from tidemark.sources.measurements import SCHEMA
from tidemark.streaming import corrections as c
from tidemark.streaming import landing

START = datetime(2024, 1, 1)


def made(spark, rows):
    return spark.createDataFrame([(i, at, None, kind, value, None) for i, at, kind, value in rows], SCHEMA)


def batch_result(rows):
    return rows.where("ts is not null").groupBy(bucket("ts", "1 hour").alias("bucket_start"), "event_type").agg(F.count("value").alias("n"), exact_sum("value").alias("total"))


@pytest.mark.parametrize("slices", [1, 3])
def test_a_change_log_adds_up_through_late_rows_and_a_restart(spark, tmp_path, slices):
    rnd = random.Random(1)
    rows = [(k, START + timedelta(minutes=rnd.randint(0, 600)), rnd.choice(["a", "b", None]), rnd.choice([0.25, 1.5, None])) for k in range(300)] + [(999, None, "a", 1.0), (1000, START, "n", None)]
    rnd.shuffle(rows)
    parts = [made(spark, rows[k::4]) for k in range(4)]
    for k, part in enumerate(parts):
        if k == 2:  # and go on after a restart, with rows as early as the first
            run(spark, tmp_path, slices)
            run(spark, tmp_path, slices)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "source"))
    run(spark, tmp_path, slices)
    got = spark.read.parquet(str(tmp_path / "log"))
    assert got.where("sign = -1").count() > 0
    assert t.reconciled(c.folded(got, ["event_type"]), batch_result(made(spark, rows)).select("bucket_start", "event_type", "n", "total")).count() == 0
    standing = got.where("sign = 1").count() - got.where("sign = -1").count()
    buckets = got.select("bucket_start", "event_type").distinct().count()
    assert standing == buckets if slices == 1 else buckets < standing <= slices * buckets


def run(spark, path, slices):
    source = landing.stream(spark, str(path / "source"), files_at_once=1)
    c.logged(c.corrected_buckets(source, "1 hour", "2 days", ["event_type"], slices=slices), str(path / "log"), str(path / "checkpoint")).awaitTermination()


def test_state_goes_when_its_bucket_is_over(spark, tmp_path):
    for k, hours in enumerate((0, 10, 20)):
        made(spark, [(k, START + timedelta(hours=hours), "a", 1.0)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "source"))
        source = landing.stream(spark, str(tmp_path / "source"), files_at_once=1)
        query = c.logged(c.corrected_buckets(source, "1 hour", "1 hour", ["event_type"]), str(tmp_path / "log"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
    progress = [p.stateOperators[0] for p in query.recentProgress if p.stateOperators]
    assert progress[-1].numRowsTotal <= 4  # the last buckets' values and timers, not those of all three


def test_log_round_trip_and_schema(spark, tmp_path):
    log.registered(spark)
    rows = made(spark, [(k, START + timedelta(minutes=k), "a", k / 4) for k in range(100)])
    rows.repartition(3).write.format(log.FORMAT).mode("append").save(str(tmp_path / "l"))
    rows.limit(0).write.format(log.FORMAT).mode("append").save(str(tmp_path / "l"))
    read = spark.read.format(log.FORMAT).load(str(tmp_path / "l"))
    assert t.reconciled(read, rows).count() == 0
    with pytest.raises(Exception, match="appended to"):
        rows.write.format(log.FORMAT).mode("overwrite").save(str(tmp_path / "l"))
    assert spark.read.format(log.FORMAT).load(str(tmp_path / "none")).count() == 0


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    log.registered(spark)
    rows = made(spark, [(k, START, "a", 1.0) for k in range(60)]).repartition(4)
    rows.write.format(log.FORMAT).mode("append").save(str(tmp_path / "l"))
    torn = rows.withColumn("value", F.when(F.col("event_id") == 33, F.raise_error(F.lit("torn")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="torn"):
        torn.write.format(log.FORMAT).mode("append").save(str(tmp_path / "l"))
    assert spark.read.format(log.FORMAT).load(str(tmp_path / "l")).count() == 60
    assert len(list((tmp_path / "l" / "commits").iterdir())) == 1
    writer = log.Writer({"path": str(tmp_path / "l")})
    segments = {f.name for f in (tmp_path / "l" / "segments").iterdir()}
    writer.write(iter(rows.toArrow().to_batches()))  # a task that ended, and was not heard of
    assert len([*(tmp_path / "l" / "segments").iterdir()]) == len(segments) + 1
    writer.abort([None])
    assert {f.name for f in (tmp_path / "l" / "segments").iterdir()} == segments


def test_streams_through_the_log_repeat_nothing(spark, tmp_path):
    log.registered(spark)
    rows = made(spark, [(k, START + timedelta(minutes=k), "a", k / 4) for k in range(90)])

    def through():
        source = landing.stream(spark, str(tmp_path / "source"), files_at_once=1)
        into = source.writeStream.format(log.FORMAT).option("stream", "one").option("checkpointLocation", str(tmp_path / "in")).trigger(availableNow=True)
        into.start(str(tmp_path / "l")).awaitTermination()
        out = spark.readStream.format(log.FORMAT).load(str(tmp_path / "l"))
        landing.appended(out, str(tmp_path / "out"), str(tmp_path / "from")).awaitTermination()

    for k in range(3):
        rows.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "source"))
        through()
        through()  # a restart with nothing new
    assert t.reconciled(spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")), rows).count() == 0
    # a batch that is committed again, as after a lost driver, adds nothing
    writer = log.StreamWriter({"path": str(tmp_path / "l"), "stream": "one"})
    before = log._Log(writer.options).commits()
    writer.commit([writer.write(iter(rows.limit(5).toArrow().to_batches()))], 0)
    assert log._Log(writer.options).commits() == before
    assert spark.read.format(log.FORMAT).load(str(tmp_path / "l")).count() == 90
    with pytest.raises(ValueError):
        log.StreamWriter({"path": "x"})
