"""Edge cases that the generated tables do not hold."""
import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions.buckets import bucket, calendar_bucket, exact_sum, parsed
from tidemark.functions.buckets import hour_number as bucket_hours
from tidemark.operators import timeseries as ops
from tidemark.plans.query import BucketQuery
from tidemark.sources import measurements as m
from tidemark.streaming import landing


def at(text):
    return dt.datetime.fromisoformat(text)


def frame(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], m.SCHEMA)


@pytest.fixture
def few(spark):
    return frame(spark, [
        (1, at("2024-03-10T06:59:59"), 1, "a", 1.0), (2, at("2024-03-10T07:00:00"), 1, "a", 2.5), (3, at("1969-12-31T23:30:00"), 1, "b", 4.0),
        (4, at("2024-03-10T07:30:00"), 2, "a", None), (5, None, 2, "a", 9.0),
    ])


def test_edges_belong_to_the_new_bucket_and_null_times_have_none(few):
    got = {r["bucket_start"]: (r["n"], r["total"]) for r in BucketQuery("1 hour").run(few).collect()}
    assert got == {
        at("2024-03-10T06:00:00"): (1, decimal.Decimal("1.00")), at("2024-03-10T07:00:00"): (1, decimal.Decimal("2.50")),
        at("1969-12-31T23:00:00"): (1, decimal.Decimal("4.00")),
    }


def test_calendar_keeps_a_null_group(few):
    assert {r["bucket_start"] for r in BucketQuery(unit="day").run(few).collect()} == {at("2024-03-10"), at("1969-12-31"), None}


def test_local_days_over_a_change_of_clocks(spark):
    rows = frame(spark, [(1, at("2024-03-10T04:59:59"), 1, "a", 1.0), (2, at("2024-03-10T05:00:00"), 1, "a", 1.0), (3, at("2024-03-11T03:59:59"), 1, "a", 1.0)])
    got = rows.select("event_id", calendar_bucket("ts", "day", "America/New_York").alias("d")).collect()
    assert [r["d"] for r in sorted(got)] == [at("2024-03-09"), at("2024-03-10"), at("2024-03-10")]


def test_sum_does_not_depend_on_partitions(spark):
    rows = spark.range(2000).select((F.col("id") % 97 / 100).cast("double").alias("value"))
    assert len({rows.repartition(n).agg(exact_sum("value")).first()[0] for n in (1, 3, 7)}) == 1


def test_empty_range_and_empty_table(few):
    assert BucketQuery("1 hour").between("2030-01-01", "2030-01-02").run(few).count() == 0
    assert ops.sessions(few.where("false"), "30 minutes", ["user_id"]).count() == 0


def test_faults(spark):
    rows = frame(spark, [
        (1, at("2024-01-01"), 1, "a", float("nan")), (2, at("2024-01-01"), 1, "a", float("inf")), (None, at("2024-01-01"), 1, "a", 1.0),
        (4, None, 1, "a", 1.0), (5, at("2024-01-01"), 1, "a", 1e17), (6, at("2024-01-01"), 1, "a", None), (7, at("2024-01-01"), 1, "a", -1.0),
    ])
    good, bad = m.checked(rows)
    assert sorted(r["event_id"] for r in good.collect()) == [6, 7]
    assert sorted(r["_fault"] for r in bad.collect()) == ["no id", "no time", "not a number", "not a number", "out of range"]


def test_bad_lines_are_kept(spark):
    lines = spark.createDataFrame([('{"event_id": 1, "ts": "2024-01-01T00:00:00", "value": 2.5}',), ('{"event_id": "x", "ts": "2024-01-01T00:00:00"}',), ("torn {",)], "value string")
    good, bad = m.split_lines(lines)
    assert [r["event_id"] for r in good.collect()] == [1] and bad.count() == 2


def test_dedupe_is_the_same_in_any_order(spark):
    rows = [(1, at("2024-01-01"), 1, "a", 1.0), (1, at("2024-01-02"), 1, "a", 2.0), (1, at("2024-01-02"), 1, "a", 3.0), (2, at("2024-01-01"), 1, "a", 5.0)]
    want = [(1, 3.0), (2, 5.0)]
    for order in (rows, rows[::-1]):
        assert sorted((r["event_id"], r["value"]) for r in m.deduplicated(frame(spark, order)).collect()) == want


def test_replay_and_pruning(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = m.generated(spark, 5000)
    for _ in range(2):
        m.write_batch(rows.where("event_id < 3000"), path, "b1")
        m.write_batch(rows.where("event_id >= 3000"), path, "b2")
    table = m.read_table(spark, path)
    assert table.count() == 5000
    q = BucketQuery("1 hour").between("2024-01-01", "2024-01-02")
    assert q.run(table).agg(F.sum("n")).first()[0] == 2880
    plan = q.run(table)._jdf.queryExecution().executedPlan().toString()
    assert "dt" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_reconciled_names_the_side(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert sorted(map(tuple, ops.reconciled(a, b).collect())) == [(1, "one"), (2, "one"), (3, "other")]


def test_stream_lands_all_rows_once(spark, tmp_path):
    src, table, bad, cp = (str(tmp_path / x) for x in ("src", "table", "bad", "cp"))
    m.generated(spark, 1000).repartition(3).write.parquet(src)
    for _ in range(2):
        landing.land(landing.stream(spark, src, files_at_once=1), table, bad, cp).awaitTermination()
    assert m.read_table(spark, table).count() == 1000
    other = str(tmp_path / "other")
    frame(spark, [(5000 + k, at("2024-01-01"), 1, "a", 0.5 if k else 0.125) for k in range(4)]).write.parquet(other)
    landing.land(landing.stream(spark, other), table, bad, str(tmp_path / "cp2")).awaitTermination()
    assert m.read_table(spark, table).count() == 1003 and spark.read.parquet(bad).count() == 1
    q = landing.running_counts(landing.stream(spark, src), "1 day").writeStream.outputMode("complete").format("memory").queryName("t").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("t").agg(F.sum("n")).first()[0] == 1000


def test_overflow_raises(spark):
    big = spark.range(20).select(F.lit(decimal.Decimal("9" * 38)).alias("x"))
    with pytest.raises(Exception, match="(?i)overflow|cannot be represented|out of range"):
        big.agg(F.sum("x").alias("t")).collect()


def test_bucket_of_a_boundary(spark):
    assert spark.range(1).select(F.lit("2024-01-01 01:00:00").cast("timestamp_ntz").alias("ts")).groupBy(bucket("ts", "1 hour").alias("b")).count().first()["b"] == at("2024-01-01T01:00:00")


def test_a_replayed_batch_leaves_nothing_of_its_days(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = m.generated(spark, 9000)
    m.write_batch(rows, path, "007")
    m.write_batch(rows.where("event_id < 10"), path, "with: odd/id")
    assert m.read_table(spark, path).where("batch_id = '007'").count() == 9000
    m.write_batch(rows.where("event_id < 2880"), path, "007")
    table = m.read_table(spark, path)
    assert {r[0]: r[1] for r in table.groupBy("batch_id").count().collect()} == {"007": 2880, "with: odd/id": 10}
    m.write_batch(rows.where("false"), path, "007")
    assert m.read_table(spark, path).count() == 10
    with pytest.raises(ValueError):
        m.write_batch(rows, path, "")


def test_a_failed_write_leaves_the_batch_as_it_was(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = m.generated(spark, 500)
    m.write_batch(rows, path, "b")
    torn = rows.withColumn("value", F.when(F.col("event_id") == 400, F.raise_error(F.lit("torn"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="torn"):
        m.write_batch(torn, path, "b")
    assert m.read_table(spark, path).count() == 500


def test_a_hot_day_is_several_files(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], "64k")
        spark.conf.set(keys[1], "8")
        m.write_batch(m.generated(spark, 60_000, seconds=1).repartition(8), path, "b")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    days = [f.split("dt=")[1][:10] for f in m.read_table(spark, path).inputFiles()]
    assert len(set(days)) == 1 and len(days) > 1


def test_no_rounding_behind_the_back(spark):
    rows = frame(spark, [(k, at("2024-01-01"), 1, "a", 0.004) for k in range(3)])
    assert m.checked(rows)[0].count() == 0 and [r["_fault"] for r in m.checked(rows)[1].collect()] == ["too many decimals"] * 3
    assert m.checked(rows, 3)[0].count() == 3
    with pytest.raises(Exception, match="more than 2 decimals"):
        BucketQuery("1 day").run(rows).collect()
    assert BucketQuery("1 day").decimals(3).run(rows).first()["total"] == decimal.Decimal("0.012")


def test_rows_without_id_all_stay(spark):
    rows = [(None, at("2024-01-01"), 1, "a", 1.0)] * 2 + [(None, at("2024-01-02"), 1, "a", 2.0), (1, at("2024-01-01"), 1, "a", 1.0), (1, at("2024-01-01"), 1, "a", 1.0)]
    assert m.deduplicated(frame(spark, rows)).count() == 4


def test_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([("{}",), (None,)], "value string")
    for part in m.split_lines(lines):
        assert part._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert m.split_lines(lines)[1].count() == 2


def test_spread_of_large_values(spark):
    rows = spark.createDataFrame([("a", 1e9 + k / 100) for k in range(1, 6)] + [(None, 1.0), (None, 3.0), ("b", None), ("c", 7.0)], "k string, value double")
    got = {r["k"]: (r["n"], r["variance"]) for r in ops.spread(rows, "k").collect()}
    assert got == {"a": (5, 0.00025), None: (2, 2.0), "b": (0, None), "c": (1, None)}


def test_gaps_of_a_null_key(spark):
    rows = frame(spark, [(k, at("2024-01-01T00:10:00"), 1, None if k < 5 else "a", 1.0) for k in range(7)])
    buckets = BucketQuery("1 hour").by("event_type").run(rows).select("event_type", "bucket_start", "n")
    out = ops.gap_filled(buckets, "2024-01-01 00:00:00", "2024-01-01 02:00:00", "1 hour", rows.select("event_type").distinct()).collect()
    assert sorted((str(r["event_type"]), r["n"]) for r in out) == [("None", 0), ("None", 0), ("None", 5), ("a", 0), ("a", 0), ("a", 2)]
    assert ops.gap_filled(buckets.drop("event_type"), "2024-01-02", "2024-01-01", "1 hour").count() == 0
    assert ops.gap_filled(buckets, "2024-01-01", "2024-01-08", "1 minute", rows.select("event_type").distinct()).count() == 2 * (7 * 1440 + 1)


def test_as_of_against_brute_force(spark):
    import random

    rnd = random.Random(1)

    def some(n):
        return [(rnd.choice([None, "x", "y", "z"]), None if rnd.random() < 0.05 else at("2024-01-01") + dt.timedelta(hours=rnd.randint(0, 200)), rnd.randint(0, 50)) for _ in range(n)]

    left, right = some(300), some(200)
    a = spark.createDataFrame([(*r, k) for k, r in enumerate(left)], "key string, ts timestamp_ntz, v int, id int")
    b = spark.createDataFrame(right, "key string, ts timestamp_ntz, v int")
    got = {r["id"]: (r["r_ts"], r["r_v"]) for r in ops.as_of(a, b, "key", ["v"]).collect()}
    assert len(got) == 300
    for k, (key, ts, _) in enumerate(left):
        before = [(t, v) for x, t, v in right if key is not None and ts is not None and x == key and t is not None and t <= ts]
        assert got[k] == (max(before) if before else (None, None))
    with pytest.raises(ValueError):
        ops.as_of(a.withColumn("r_v", F.lit(1)), b, "key", ["v"])


def test_quantiles_against_numpy(spark):
    import random

    import numpy as np

    rnd = random.Random(2)
    data = {"a": [rnd.gauss(0, 1e4) for _ in range(999)], "b": [5.0], "c": [rnd.choice([1.0, 2.0, 1e300, -1e300]) for _ in range(50)], None: [round(rnd.random(), 2) for _ in range(400)]}
    rows = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("d", None)], "key string, value double")
    shares = (0.0, 0.25, 0.5, 0.99, 1.0)
    got = {r["key"]: list(r)[1:] for r in ops.quantiles(rows, "key", shares).collect()}
    assert got["d"] == [None] * 5
    odd = spark.createDataFrame([("a", float(v)) for v in ("inf", "-inf", "nan", 1, 2)] + [("b", -0.0), ("b", 0.0)], "key string, value double")
    assert str(sorted(map(tuple, ops.quantiles(odd, "key", (0.0, 0.5, 0.75, 1.0)).collect()))) == "[('a', -inf, 2.0, inf, nan), ('b', 0.0, 0.0, 0.0, 0.0)]"
    for k, vs in data.items():
        assert np.allclose(got[k], [np.quantile(vs, p) for p in shares], rtol=1e-12, atol=1e-9), k


def test_nothing_depends_on_the_session_zone(spark):
    rows = frame(spark, [(1, at("2024-03-10T02:30:00"), 1, "error", 1.0), (2, at("2024-03-10T02:10:00"), 1, "view", 1.0), (3, at("2024-11-03T01:30:00"), 1, "view", 1.0)])
    text = spark.createDataFrame([("2024-03-10 02:30:00.25",), ("no time",)], "t string")
    seen = set()
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kathmandu"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            units = [calendar_bucket("ts", u).cast("string").alias(u) for u in ("minute", "hour", "day", "week", "month", "quarter", "year")]
            found = [tuple(r) for r in rows.select(*units, bucket_hours("ts")).collect()]
            read = [tuple(r) for r in text.select(parsed("t").cast("string"), parsed(F.lit("10/03/2024 02:30"), "dd/MM/yyyy HH:mm").cast("string")).collect()]
            seen.add(repr((found, read)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(seen) == 1 and "2024-03-10 02:00:00" in seen.pop()


def test_moving_total_keys_and_peers(spark):
    rows = [("a", at("2024-01-01T00:00:00"), "1.00"), ("a", at("2024-01-01T05:00:00"), "2.00"), ("a", at("2024-01-03"), "4.00"), (None, at("2024-01-02"), "8.00"), ("a", None, "9.00"), ("a", at("2024-01-20"), "5.00")]
    table = spark.createDataFrame([(k, t, decimal.Decimal(x)) for k, t, x in rows], "k string, bucket_start timestamp_ntz, total decimal(38,2)")
    got = [(r["k"], r["bucket_start"], r["moving_total"]) for r in ops.moving_total(table, 2, ["k"]).collect()]
    want = [("a", rows[0][1], 3), ("a", rows[1][1], 3), ("a", rows[2][1], 7), (None, rows[3][1], 8), ("a", None, None), ("a", rows[5][1], 5)]
    assert sorted(map(str, got)) == sorted(str((k, t, None if x is None else decimal.Decimal(f"{x}.00"))) for k, t, x in want)


def test_commands(spark, tmp_path):
    from tidemark.__main__ import main

    table = str(tmp_path / "t")
    assert main(["load", "--rows", "5000", "--table", table, "--batch", "one"])["rows"] == 5000
    m.generated(spark, 100).withColumn("value", F.lit(0.125)).write.parquet(str(tmp_path / "f"))
    assert main(["ingest", "--file", str(tmp_path / "f"), "--table", table, "--batch", "two"])["refused"] == 100
    assert main(["query", "--table", table, "--width", "1 day"])["rows"] == 5000
    assert main(["reconcile", "--table", table])["differences"] == 0


def test_the_custom_source_is_the_same_in_any_partitions(spark):
    from tidemark.sources import generator

    one, many = generator.load(spark, 25_000, partitions=1), generator.load(spark, 25_000, partitions=7)
    assert one.exceptAll(many).count() == 0 and many.count() == 25_000 and m.checked(many)[1].count() == 0
