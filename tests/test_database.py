"""Batches in a database, by DB-API from any executor and by JDBC within one JVM."""
import os
import pathlib
import subprocess
import sys
from contextlib import closing

import pytest
from pyspark.sql import functions as F

from tidemark.sources import database
from tidemark.sources import measurements as m

SCHEMA = "event_id bigint, ts timestamp_ntz, value double, props string, batch_id string"
_ON_A_CLUSTER = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").config(
    "spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", sys.argv[1]).config("spark.sql.warehouse.dir", sys.argv[1] + "/warehouse").getOrCreate()
print("rows", entry.queries()["database_round_trip"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def batch(spark, low, high):
    rows = m.generated(spark, high).where(F.col("event_id") >= low).select("event_id", "ts", "value", "props")
    return rows.withColumn("value", F.when(F.col("event_id") % 7 > 0, F.col("value")))


def test_the_round_trip_on_executors_that_share_no_memory(tmp_path):
    root = str(pathlib.Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", _ON_A_CLUSTER, str(tmp_path)], cwd=tmp_path, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert "rows 750" in done.stdout, done.stderr[-3000:]  # 500 odd ids, and the even ones below 500


def test_a_batch_written_again_stands_alone(spark, tmp_path):
    connect = database.shared_file(str(tmp_path / "rows.db"))
    database.write(batch(spark, 0, 1000), connect, "t", "one")
    database.write(batch(spark, 1000, 1500).repartition(5), connect, "t", "two")
    database.write(batch(spark, 0, 10), connect, "t", "one")
    database.write(batch(spark, 0, 0), connect, "t", "none")
    want = batch(spark, 0, 10).withColumn("batch_id", F.lit("one")).unionByName(batch(spark, 1000, 1500).withColumn("batch_id", F.lit("two")))
    for bounds, parts in (((0, 1499), 4), ((1200, 1201), 3), ((None, None), 4), ((0, 1499), 1)):  # bounds leave nothing out
        got = database.read(spark, connect, "t", SCHEMA, "event_id", bounds, parts)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_write_that_fails_leaves_the_batch(spark, tmp_path):
    connect = database.shared_file(str(tmp_path / "rows.db"))
    database.write(batch(spark, 0, 100), connect, "t", "one")
    with pytest.raises(Exception, match="no NaN"):
        database.write(batch(spark, 0, 50).withColumn("value", F.lit(float("nan"))), connect, "t", "one")
    with pytest.raises(ValueError):
        database.write(batch(spark, 0, 5).withColumn("value", F.array("value")), connect, "t", "one")
    with closing(connect()) as link:
        assert link.execute("SELECT count(*) FROM t").fetchone() == (100,)


def test_jdbc_within_one_jvm(spark):
    url, driver = "jdbc:derby:memory:tests;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    even, odd = (batch(spark, 0, 1000).where(F.col("event_id") % 2 == k).drop("props") for k in (0, 1))
    for rows, name in ((even, "even"), (odd, "odd"), (even.where("event_id < 500"), "even")):
        m.write_jdbc(rows, url, "events", name, **driver)
    back = m.read_jdbc(spark, url, "events", "event_id", (0, 999), 4, **driver).withColumn("batch_id", F.col("batch_id").cast("string"))
    want = odd.withColumn("batch_id", F.lit("odd")).unionByName(even.where("event_id < 500").withColumn("batch_id", F.lit("even")))
    assert back.count() == 750 and back.exceptAll(want).count() == 0
