"""Operators on made rows: exactness, clashing names, hot keys as many tasks, and plans."""
import random
import re
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import variants
from tidemark.functions.buckets import bucket
from tidemark.operators import distinct, intervals
from tidemark.operators import timeseries as t
from tidemark.plans.query import BucketQuery
from tidemark.sources import clustered, measurements
from tidemark.streaming import landing

START = datetime(2024, 1, 1)


def timed(spark, rows, schema="ts timestamp_ntz, user_id long, value double"):
    return spark.createDataFrame(rows, schema)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_moving_total_keeps_the_decimals_of_its_input(spark):
    daily = timed(spark, [(START, 1.005), (START + timedelta(days=1), 2.001)], "bucket_start timestamp_ntz, v double").select("bucket_start", F.col("v").cast("decimal(38,3)").alias("total"))
    assert [r["moving_total"] for r in t.moving_total(daily, 3).orderBy("bucket_start").collect()] == [Decimal("1.005"), Decimal("3.006")]
    whole = daily.select("bucket_start", F.lit(7).alias("total"))
    assert [r["moving_total"] for r in t.moving_total(whole, 3).orderBy("bucket_start").collect()] == [7, 14]


def test_clashing_names(spark):
    rows = timed(spark, [(START, 1, 0.125), (START, 2, None), (None, 3, 1.0)])
    one = rows.withColumn("side", F.lit("x"))
    with pytest.raises(ValueError, match="side"):
        t.reconciled(one, one)
    assert t.reconciled(one, one.where("user_id > 1"), "where").columns[-1] == "where"
    for key in ("w", "block", "at", "s", "k0", "last", "end"):
        out = t.sessions(rows.withColumnRenamed("user_id", key), "1 hour", [key], scale=3)
        assert out.columns == [key, "session_start", "last_ts", "n", "total"] and out.count() == 2
    for make in (lambda r, k: t.sessions(r, "1 hour", k), lambda r, k: t.sliding(r, "2 hours", "1 hour", k), lambda r, k: BucketQuery().by(*k).run(r), lambda r, k: landing.running_counts(r, "1 hour", k)):
        with pytest.raises(ValueError):
            make(rows.withColumn("session_start", F.lit(1)).withColumn("bucket_start", F.lit(1)), ["session_start", "bucket_start"])
    assert landing.running_counts(rows.withColumnRenamed("user_id", "w"), "1 hour", ["w"], scale=3).columns == ["bucket_start", "w", "n", "total"]
    with pytest.raises(ValueError):
        t.moving(rows.withColumn("moving_n", F.lit(1)), "1 hour")
    assert t.rolled_up(rows, F.col("user_id"), scale=3).count() == 4
    assert t.sliding(rows, "2 hours", "1 hour", scale=3).count() == 2


def test_reconciled_counts_copies_and_reads_each_side_once(spark):
    one = spark.createDataFrame([(1, None), (1, None), (2, "b")] + [(9, "many")] * 5000, "a int, b string")
    other = spark.createDataFrame([(1, None), (2, "b"), (3, "c")], "a int, b string")
    got = t.reconciled(one, other)
    assert {(r["a"], r["side"]): r["count"] for r in got.groupBy("a", "side").count().collect()} == {(1, "one"): 1, (3, "other"): 1, (9, "one"): 5000}
    assert plan(got).count("Scan ExistingRDD") == 2


def test_quantile_names(spark):
    rows = spark.range(1001).select(F.lit("a").alias("key"), F.col("id").cast("double").alias("value"))
    got = t.quantiles(rows, "key", (0.5, 0.995, 0.999, 1)).collect()[0].asDict()
    assert got == {"key": "a", "p50": 500.0, "p99_5": 995.0, "p99_9": 999.0, "p100": 1000.0}
    for shares in ((0.5, 0.5), (1.5,)):
        with pytest.raises(ValueError):
            t.quantiles(rows, "key", shares)


def test_null_as_a_value_to_look_for(spark):
    rows = timed(spark, [(START, 1, 1.0), (START, None, 2.0), (START, 2, 4.0)])
    assert BucketQuery("1 day").where("user_id", None).run(rows).collect()[0]["total"] == 2
    assert BucketQuery("1 day").where("user_id", 1, None).run(rows).collect()[0]["total"] == 3
    with pytest.raises(ValueError):
        BucketQuery().where("user_id")


def brute_sessions(rows, gap):
    out, by = [], defaultdict(list)
    for at, key, value in rows:
        if at is not None:
            by[key].append((at, value))
    for key, mine in by.items():
        mine.sort(key=lambda r: r[0])
        for k, (at, value) in enumerate(mine):
            if not k or at - mine[k - 1][0] >= gap:
                out.append([key, at, at, 0, None])
            last = out[-1]
            last[2], last[3] = at, last[3] + 1
            if value is not None:
                last[4] = (last[4] or 0) + Decimal(str(value))
    return sorted(map(repr, map(tuple, out)))


@pytest.mark.parametrize("block", ["1 minute", "1 hour", "7 days"])
def test_sessions_over_borders_of_blocks(spark, block):
    rnd = random.Random(2)
    rows = [(START + timedelta(seconds=rnd.choice([1, 30, 60]) * rnd.randint(-900, 900)), rnd.choice([1, 2, None, None]), rnd.choice([None, 0.25, 1.5])) for _ in range(400)]
    rows += [(START + timedelta(minutes=10 * k), 77, 1.0) for k in range(40)] + [(START + timedelta(minutes=5 * k), 78, None) for k in range(200)] + [(None, 1, 1.0)]
    got = t.sessions(timed(spark, rows), "10 minutes", ["user_id"], block=block)
    made = sorted(repr((r["user_id"], r["session_start"], r["last_ts"], r["n"], None if r["total"] is None else r["total"].normalize())) for r in got.collect())
    want = sorted(x for x in brute_sessions(rows, timedelta(minutes=10)))
    strip = lambda s: s.replace(".00'", "'").replace(".0'", "'")
    assert len(made) == len(want) and [strip(x)[:90] for x in made] == [strip(x)[:90] for x in want]
    assert got.agg(F.sum("n"), F.sum("total")).first() == (640, t.bucketed(timed(spark, rows), bucket("ts", "900 days")).agg(F.sum("total")).first()[0])
    assert t.sessions(timed(spark, []), "10 minutes", ["user_id"]).count() == 0


def test_hot_keys_are_many_tasks(spark, tmp_path):
    spark.range(50_000).select((F.lit(START) + F.make_dt_interval(secs=F.col("id") * 7)).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("bigint").alias("user_id"), F.lit(0.5).alias("value")).write.parquet(str(tmp_path / "hot"))
    rows = spark.read.parquet(str(tmp_path / "hot"))
    made = t.sessions(rows, "5 seconds", ["user_id"]), t.moving(rows, "30 minutes", ["user_id"])
    for out in made:
        # rows are dealt by key and block; what is dealt by the key alone are sums of blocks
        by = [re.search(r"hashpartitioning\((.*?), \d+\)", line)[1] for line in plan(out).splitlines() if "Exchange hashpartitioning" in line]
        assert sum("block" in x for x in by) >= 1 and sum("block" not in x for x in by) == 1
    assert made[1].agg(F.max("moving_n"), F.max("moving_total")).first() == (258, Decimal("129.00"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (t.sessions(rows, "5 seconds", ["user_id"]), t.moving(rows, "30 minutes", ["user_id"])):
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert max(sizes) < 50_000 * 0.6
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("block", ["1 minute", "1 hour", "30 days"])
def test_moving_frames_on_ties_nulls_and_blocks(spark, block):
    rnd = random.Random(3)
    rows = [(k, None if k % 50 == 0 else START + timedelta(seconds=60 * rnd.randint(-300, 300)), rnd.choice([1, 2, None]), rnd.choice([None, 0.125, -1.5, 3.0])) for k in range(400)]
    df = timed(spark, rows, "event_id long, ts timestamp_ntz, k0 long, value double")
    got = {r["event_id"]: (r["moving_n"], r["moving_total"]) for r in t.moving(df, "30 minutes", ["k0"], 3, block).collect()}
    for k, ts, key, _ in rows:
        mine = [Decimal(str(v)) for _, at, other, v in rows if v is not None and ts is not None and at is not None and other == key and ts - timedelta(minutes=30) <= at <= ts]
        assert got[k] == ((None, None) if ts is None else (len(mine), sum(mine) if mine else None))
    assert len(got) == 400 and t.moving(df.where("false"), "1 hour").count() == 0


@pytest.mark.parametrize("kind", ["timestamp_ntz", "long"])
def test_overlapping_intervals_of_unlike_lengths(spark, kind):
    rnd = random.Random(4)

    def side(n, first):
        out = []
        for k in range(n):
            a = rnd.randint(-10**9, 10**9)
            length = rnd.choice([0, 1, 1000, 1_000_000, 8_000_000, 10**9, 3 * 10**9, -5])
            out.append((first + k, rnd.choice(["x", "y", None]), a, a + length))
        return [*out, (first + n, "x", None, 5), (first + n + 1, "x", 5, None), (first + n + 2, "x", -(10**15), 10**15)]

    one, two = (spark.createDataFrame(rows, "id long, k string, a long, b long") for rows in (side(150, 0), side(150, 1000)))
    if kind != "long":
        one, two = (df.withColumns({c: (F.lit(START) + F.make_dt_interval(secs=(F.col(c) / 1_000_000).cast("decimal(18,6)"))).cast("timestamp_ntz") for c in "ab"}) for df in (one, two))
    con = duckdb.connect()
    con.register("one", one.toArrow())
    con.register("two", two.toArrow())
    for on in (["k"], []):
        got = intervals.overlapping(one, two, "a", "b", on).select("id", "r_id").collect()
        want = con.sql(f"select one.id, two.id from one join two on one.a < two.b and two.a < one.b and one.a < one.b and two.a < two.b {'and one.k = two.k' if on else ''}").fetchall()
        assert sorted(map(tuple, got)) == sorted(want) and len(got) == len(set(got)) > 100
    made = intervals.overlapping(one, two, "a", "b", ["k"])
    assert "NestedLoop" not in plan(made) and "Cartesian" not in plan(made)
    with pytest.raises(ValueError):
        intervals.overlapping(one.withColumn("r_id", F.lit(1)), two, "a", "b")
    assert intervals.overlapping(one.where("false"), two, "a", "b").count() == 0


def test_an_interval_is_in_few_cells(spark):
    """A long interval does not multiply with the short ones' cells, nor short ones with its length."""
    short = spark.range(2000).select(F.col("id"), (F.col("id") * 1_000_000_000).alias("a"), (F.col("id") * 1_000_000_000 + 5).alias("b"))
    long = spark.createDataFrame([(0, 0, 2 * 10**12)], "id long, a long, b long")
    out = intervals.overlapping(long, short, "a", "b")
    assert out.count() == 2000
    # cells of the narrowest grid would be two million for the long one
    assert "NestedLoop" not in plan(out)


def test_distinct_counts_of_bitmaps(spark):
    rows = [(START + timedelta(hours=k), [k % 7, -k, 40_000 + k % 3, None][k % 4], 1.0) for k in range(200)]
    df = timed(spark, rows)
    days = distinct.bitmaps(df, bucket("ts", "1 day"), "user_id")
    weeks = distinct.counted(distinct.merged(days, bucket("bucket_start", "7 days", "4 days"))).collect()
    for r in weeks:
        assert r["n"] == len({u for ts, u, _ in rows if r["bucket_start"] <= ts < r["bucket_start"] + timedelta(days=7)} - {None})
    assert distinct.counted_between(days, "2024-01-02", "2024-01-04").collect()[0]["n"] == len({u for ts, u, _ in rows if datetime(2024, 1, 2) <= ts < datetime(2024, 1, 4)} - {None})
    assert distinct.counted_between(days, "2025-01-02", "2025-01-04").collect()[0]["n"] == 0
    with pytest.raises(ValueError):
        distinct.bitmaps(df, bucket("ts", "1 day"), "value")


def test_variants_parse_once_and_take_odd_documents(spark):
    texts = ['{"a": {"b": [1, "2", null, 3.5]}, "c": "x"}', '{"a": 1', "", None, "[]", "null", '"s"', '{"a": {"b": "no list"}}']
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "id int, j string")
    out = variants.paths(df, "j", b0=("$.a.b[0]", "int"), b1=("$.a.b[1]", "int"), b3=("$.a.b[3]", "int"), c=("$.c", "int"), d=("$.d", "string"))
    assert plan(out).count("parseJson(") == 1
    got = {r["id"]: tuple(r)[2:] for r in out.collect()}
    assert got.pop(0) == (1, 2, 3, None, None) and set(got.values()) == {(None,) * 5} and len(got) == 7
    assert sorted((r["id"], r["pos"], r["value"]) for r in variants.exploded(df, "j", "$.a.b", "double").collect()) == [(0, 0, 1.0), (0, 1, 2.0), (0, 2, None), (0, 3, 3.5)]
    assert {r["kind"]: r["n"] for r in variants.kinds(df, "j", "$.a").collect()} == {"OBJECT<b: ARRAY<VARIANT>>": 1, "OBJECT<b: STRING>": 1, None: 6}
    with pytest.raises(ValueError):
        variants.paths(df, "j", id=("$.a", "int"))


def test_buckets_join_without_a_shuffle(spark, tmp_path):
    left = spark.range(1000).select(F.col("id").alias("a"), F.lit("x").alias("x"))
    right = spark.range(3000).select((F.col("id") % 1200).alias("b"), F.col("id").alias("y"))
    one, two = clustered.bucketed_table(left, str(tmp_path / "one"), "a", 4), clustered.bucketed_table(right, str(tmp_path / "two"), "b", 4)
    met = one.hint("merge").join(two, F.col("a") == F.col("b"))
    assert met.count() == left.join(right, F.col("a") == F.col("b")).count()
    assert "Exchange" not in plan(met.groupBy("a").agg(F.count("*"))) and "SortMergeJoin" in plan(met)


def test_large_pages_are_no_single_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clustered, "FILE_ROWS", 1500)
    rows = spark.range(20_000).select((F.col("id") * 7919 % 40).alias("a"), F.col("id").alias("b"))
    table, order = clustered.sorted_table(rows, str(tmp_path / "sorted"), ["a", "b"], 2), ["a", "b"]
    assert len(table.inputFiles()) == 14  # two would hold more rows each
    want, got, last = [tuple(r) for r in rows.orderBy(*order).collect()], [], None
    for size in (1, 1499, 3000, 7, 10_000, 20_000):
        end = clustered.place_after(table, order, size, last)
        found = clustered.between(table, order, last, end)
        assert "TakeOrdered" not in plan(found) and "Exchange" not in plan(found)
        got += (some := sorted(tuple(r) for r in found.collect()))
        assert some[-1] == end and len(some) == min(size, 20_000 - len(got) + len(some))
        last = end
    assert got == want and clustered.place_after(table, order, 5, last) is None
    rows.repartition(3).write.parquet(str(tmp_path / "odd"))
    with pytest.raises(ValueError, match="overlap"):
        clustered.place_after(spark.read.parquet(str(tmp_path / "odd")), order, 9000)
    with pytest.raises(ValueError, match="null"):
        clustered.place_after(table.withColumn("a", F.nullif("a", F.lit(3))), order, 9000)


def test_pages_by_place(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 5000).alias("a"), F.col("id").alias("b"), F.sha2(F.col("id").cast("string"), 256).alias("c"))
    table = clustered.sorted_table(rows, str(tmp_path / "sorted"), ["a", "b"], 8)
    want, got, last = [tuple(r) for r in rows.select("a", "b").orderBy("a", "b").collect()], [], None
    while (found := clustered.page(table, ["a", "b"], 3000, last).select("a", "b").collect()):
        got += map(tuple, found)
        last = tuple(found[-1])
    assert got == want and clustered.place_of(rows.limit(0), ["a"]) is None
    deep = clustered.page(table, ["a", "b"], 10, (4900, 5))
    assert "GreaterThanOrEqual(a,4900)" in plan(deep)
    deep.collect()
    assert 0 < clustered.scanned(deep)["rows"] <= 20_000 // 4
    with pytest.raises(ValueError):
        clustered.behind(["a", "b"], (1,))


def test_dedupe_asks_for_first_rows_alone(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0), (None, 1.0), (None, 1.0)], "event_id long, value double").withColumn("ts", F.lit(START).cast("timestamp_ntz"))
    out = measurements.deduplicated(rows)
    assert "WindowGroupLimit" in plan(out)
    assert sorted((r["event_id"] or 0, r["value"]) for r in out.collect()) == [(0, 1.0), (0, 1.0), (1, 2.0)]


def test_batch_names_and_writers_that_end_between_renames(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1.0)], "event_id long, value double").withColumn("ts", F.lit(START).cast("timestamp_ntz"))
    names = ["é", "日本", "a/b", "a=b", "100%", "%41", "a b", "[x]{y}^", "\t", "'\"", "a:b", "#?*", "\\", "x-a", "a", "_old-1", "."]
    for name in names:
        measurements.write_batch(rows, str(tmp_path / "t"), name)
    table = measurements.read_table(spark, str(tmp_path / "t"))
    assert sorted(r["batch_id"] for r in table.select("batch_id").collect()) == sorted(names)
    assert table.where(F.col("batch_id") == "é").count() == 1
    for wrong in ("", "a\0b", "__HIVE_DEFAULT_PARTITION__"):
        with pytest.raises(ValueError):
            measurements.write_batch(rows, str(tmp_path / "t"), wrong)
    run = "0" * 32
    (tmp_path / "t" / "batch_id=a").rename(tmp_path / "t" / f"_old-{run}-a")  # it had moved the old rows aside
    (tmp_path / "t" / f"_fresh-{run}-a").mkdir()
    (tmp_path / "t" / f"_old-{run}-x-a").mkdir()
    with pytest.raises(Exception, match="no such"):
        measurements.write_batch(rows.withColumn("value", F.raise_error(F.lit("no such")).cast("double")), str(tmp_path / "t"), "a")
    assert measurements.read_table(spark, str(tmp_path / "t")).where("batch_id = 'a'").count() == 1
    assert not (tmp_path / "t" / f"_old-{run}-a").exists() and not (tmp_path / "t" / f"_fresh-{run}-a").exists() and (tmp_path / "t" / f"_old-{run}-x-a").exists()


def test_a_range_of_hours_leaves_out_row_groups(spark, tmp_path):
    rows = spark.range(60_000).select(F.col("id").alias("event_id"), (F.lit(START) + F.make_dt_interval(secs=F.col("id"))).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("bigint").alias("user_id"),
                                      F.sha2(F.col("id").cast("string"), 256).alias("event_type"), F.lit(0.5).alias("value"), F.sha2(F.col("id").cast("string"), 512).alias("props"))
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "262144")
    try:
        measurements.write_batch(rows.where("event_id != 5"), str(tmp_path / "t"), "a")
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    ask = BucketQuery("1 hour").between("2024-01-01 03:00:00", "2024-01-01 05:00:00")
    found = {indexed: ask.run(measurements.read_table(spark, str(tmp_path / "t"), indexed=indexed)) for indexed in (True, False)}
    assert found[True].orderBy("bucket_start").collect() == found[False].orderBy("bucket_start").collect() != []
    for run in found.values():
        run.collect()
    assert clustered.scanned(found[True])["rows"] < 20_000 < clustered.scanned(found[False])["rows"] == 59_999
    # files without the number are read in whole, not lost
    rows.where("event_id = 5").withColumn("dt", F.to_date("ts")).write.partitionBy("dt").parquet(str(tmp_path / "t" / "batch_id=b"))
    early = BucketQuery("1 hour").between("2024-01-01", "2024-01-01 00:01:00").run(measurements.read_table(spark, str(tmp_path / "t"), indexed=True))
    assert early.collect()[0]["n"] == 60
