"""Aggregates over time buckets and what goes with them. Every operator takes and returns DataFrames.

Unless an operator says otherwise: keys may be null, and null is a key like any other; rows with a null time
are in no bucket; rows with a null value count nothing and add nothing; repeated rows count as often as they
come; an empty table gives an empty result; columns that an operator does not name are ignored. Columns that
operators add for themselves get names that the rows do not have; a key that is called like a result is refused by name.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.buckets import SCALE, exact, exact_mean, exact_sum, micros
from ..session import scratch, unused


def distinct_names(keys: Sequence[str], *results: str) -> None:
    """Refuse keys that are called like a result: two columns of one name cannot be told apart."""
    if clash := sorted(set(keys) & set(results)):
        raise ValueError(f"keys cannot be called like results: {clash}")


def exact_aggregates(value: str = "value", scale: int = SCALE) -> list[Column]:
    """n, total, mean, lo and hi of a column, the same for any partitioning."""
    return [
        F.count(value).alias("n"), exact_sum(value, scale).alias("total"), exact_mean(value, scale).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"),
    ]


def bucketed(rows: DataFrame, start: Column, keys: Sequence[str] = (), aggregates: Sequence[Column] | None = None) -> DataFrame:
    """One shuffle: partial sums by key and bucket, then their totals."""
    distinct_names(keys, "bucket_start")
    return rows.groupBy(*keys, start.alias("bucket_start")).agg(*(aggregates or exact_aggregates()))


def coarser(fine: DataFrame, start: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Coarser buckets from finer ones: counts and totals add up, the mean is made anew, never averaged."""
    name = unused(fine, "start")
    out = fine.groupBy(*keys, start.alias(name)).agg(
        F.sum("n").alias("n"), F.sum("total").cast(fine.schema["total"].dataType).alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    mean = (F.col("total").cast("double") / F.nullif(F.col("n"), F.lit(0))).alias("mean")
    return out.select(*keys, F.col(name).alias("bucket_start"), "n", "total", mean, "lo", "hi")


def reconciled(one: DataFrame, other: DataFrame, side: str = "side") -> DataFrame:
    """Rows that only one side has, as often as it has them more, with the side; empty where both agree.

    Each side is read once: rows count +1 or -1, and what does not add up to 0 differs. ``side`` names the column
    that is added, which the rows must not have.
    """
    distinct_names(one.columns, side)
    more, run, at = unused(one, "more"), 4096, unused(one, "at")
    signed = one.withColumn(more, F.lit(1).cast("bigint")).unionByName(other.withColumn(more, F.lit(-1).cast("bigint")))
    apart = signed.groupBy(*one.columns).agg(F.sum(more).alias(more)).where(F.col(more) != 0)
    size = F.abs(F.col(more))
    runs = apart.withColumn(at, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((size - 1) / run))))
    copies = runs.withColumn(at, F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(size - F.col(at) * run, F.lit(run)))))
    return copies.select(*one.columns, F.when(F.col(more) > 0, "one").otherwise("other").alias(side))


_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}


def seconds_of(width: str) -> int:
    """Seconds of a width such as ``15 minutes``; months have no fixed number and are refused."""
    m = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day|week)s?\s*", width)
    if not m or not int(m[1]):
        raise ValueError(f"no fixed width: {width}")
    return int(m[1]) * _SECONDS[m[2]]


def _same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Equality that takes null for a value."""
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in zip(left, right)))


def gap_filled(buckets: DataFrame, first: str, last: str, width: str, keys: DataFrame | None = None) -> DataFrame:
    """Every bucket from ``first`` to ``last``, for each row of ``keys`` where given; n is 0 where nothing was.

    The calendar is made by the executors, in runs of 4,096 buckets, and ``keys`` is multiplied by the calendar
    alone, as its rows ask for. A null key is filled like any other.
    """
    step = seconds_of(width)
    begin, end = (dt.datetime.fromisoformat(t) for t in (first, last))
    count = int((end - begin).total_seconds()) // step + 1 if end >= begin else 0
    names = [] if keys is None else keys.columns
    run = 4096
    if keys is None:
        steps = buckets.sparkSession.range(count).select(F.col("id").alias("at"))
    else:
        at = unused(keys, "at")
        runs = keys.where(F.lit(count > 0)).withColumn(at, F.explode(F.sequence(F.lit(0), F.lit(max(count - 1, 0) // run))))
        inside = F.sequence(F.col(at) * run, F.least(F.col(at) * run + run - 1, F.lit(max(count - 1, 0))))
        steps = runs.select(*names, F.explode(inside).alias("at"))
    start = F.lit(first).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("at").cast("bigint") * step).cast("decimal(18,6)"))
    calendar = steps.select(*names, start.alias("bucket_start"))
    on = [*names, "bucket_start"]
    rest = [c for c in buckets.columns if c not in on]
    met = calendar.alias("c").join(buckets.alias("b"), _same([F.col(f"c.{n}") for n in on], [F.col(f"b.{n}") for n in on]), "left")
    return met.select(*(F.col(f"c.{n}") for n in on), *(F.coalesce("b.n", F.lit(0)).alias("n") if c == "n" else F.col(f"b.{c}") for c in rest))


def sliding(rows: DataFrame, width: str, step: str, keys: Sequence[str] = (), scale: int = SCALE) -> DataFrame:
    """Aggregates of windows of ``width`` that begin at every ``step``."""
    return bucketed(rows, F.window("ts", width, step).start, keys, exact_aggregates(scale=scale))


def sessions(rows: DataFrame, gap: str, keys: Sequence[str], scale: int = SCALE, block: str = "1 hour") -> DataFrame:
    """Rows of a key with less than ``gap`` between neighbours: one row a session. Null keys are one key.

    A key is cut into blocks of time, so a hot key is many tasks. Sessions are made within each block; only the first and
    the last one of a block may go on beyond its border, and these alone are stitched, by a scan over a key's borders:
    two rows at most for each of its blocks.
    """
    distinct_names(keys, "session_start", "last_ts", "n", "total")
    names = [f"k{i}" for i in range(len(keys))]
    wide, far = seconds_of(block) * 1_000_000, seconds_of(gap) * 1_000_000
    at = micros("ts")
    timed = rows.where(F.col("ts").isNotNull()).select(
        *(F.col(k).alias(n) for k, n in zip(keys, names)), F.floor(at / wide).alias("block"), at.alias("at"), "ts", exact("value", scale).alias("v")
    )

    def numbered(rows, w, first, last):
        """Each row with the number of its session within a window."""
        apart = F.coalesce(F.col(first) - F.lag(last).over(w) >= far, F.lit(True))
        return rows.withColumn("fresh", apart.cast("bigint")).withColumn("s", F.sum("fresh").over(w))

    def summed(rows, n, total, *by):
        return rows.groupBy(*names, *by).agg(
            F.min("at").alias("at"), F.max("last").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"), n.alias("n"), total.cast(f"decimal(38,{scale})").alias("total")
        )

    inside = numbered(timed, W.partitionBy(*names, "block").orderBy("at"), "at", "at")
    inside = inside.withColumn("of", F.sum("fresh").over(W.partitionBy(*names, "block"))).select("*", F.col("at").alias("last"), F.col("ts").alias("start"), F.col("ts").alias("end"))
    # the number of sessions in a block is one for all its rows, so it may go into the key
    parts = summed(inside, F.count("*"), F.sum("v"), "block", "s", "of")
    border = (F.col("s") == 1) | (F.col("s") == F.col("of"))
    stitched = numbered(parts.where(border).drop("s"), W.partitionBy(*names).orderBy("at"), "at", "last")
    whole = summed(stitched, F.sum("n"), F.sum("total"), "s").unionByName(parts.where(~border).drop("block", "of"))
    return whole.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), F.col("start").alias("session_start"), F.col("end").alias("last_ts"), "n", "total")


def first_last(rows: DataFrame, start: Column, keys: Sequence[str] = ()) -> DataFrame:
    """First and last value of each bucket by time, then id, then value; a null value may be first or last."""
    order = F.struct("ts", "event_id", "value")
    return rows.groupBy(*keys, start.alias("bucket_start")).agg(F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"))


def moving_total(buckets: DataFrame, days_before: int, keys: Sequence[str] = ()) -> DataFrame:
    """Total over each bucket's day and the days before it, by time and not by rows.

    Each day adds to the days that it counts for, and their sums meet the buckets again: a partial sum and a join
    by key and day, so no key is sorted in one task. A bucket without a time has no moving total. The total keeps
    the decimals of the buckets' totals.
    """
    given = buckets.schema["total"].dataType
    kind = f"decimal(38,{given.scale})" if isinstance(given, DecimalType) else given
    day, to, moving = (unused(buckets, n) for n in ("day", "to", "moving_total"))
    dated = buckets.withColumn(day, F.unix_date(F.col("bucket_start").cast("date")))
    daily = dated.groupBy(*keys, day).agg(F.sum("total").alias("total"))
    reach = daily.withColumn(to, F.explode(F.sequence(F.col(day), F.col(day) + days_before)))
    sums = reach.groupBy(*keys, to).agg(F.sum("total").cast(kind).alias(moving))
    on = _same([F.col(f"b.{k}") for k in (*keys, day)], [F.col(f"s.{k}") for k in (*keys, to)])
    return dated.alias("b").join(sums.alias("s"), on, "left").select(*(F.col(f"b.{c}") for c in buckets.columns), F.col(f"s.{moving}"))


def moving(rows: DataFrame, back: str, keys: Sequence[str] = (), scale: int = SCALE, block: str = "1 hour") -> DataFrame:
    """Each row with ``moving_n`` and ``moving_total`` of its key's rows from ``back`` before its time up to it, rows at
    either end included: a RANGE frame over raw rows.

    A row adds its value at its time and takes it back once ``back`` has passed, so a frame is a running sum of what came
    and went, which is linear however many rows a frame holds. Sums run within blocks of time and start from what
    the blocks before leave, a row a block: a hot key is many tasks, and sums are exact in whatever order. A row
    without a time has no frame.
    """
    distinct_names(rows.columns, "moving_n", "moving_total")
    wide, far = seconds_of(block) * 1_000_000, seconds_of(back) * 1_000_000
    names = [f"k{i}" for i in range(len(keys))]
    at, value = micros("ts"), exact("value", scale)
    row = F.struct(*rows.columns)
    based = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), at.alias("at"), value.alias("v"), row.alias("row"))
    came = based.select(*names, "at", F.lit(0).alias("gone"), "v", F.col("v").isNotNull().cast("bigint").alias("one"), "row")
    went = came.where("at is not null and one = 1").select(
        *names, (F.col("at") + far).alias("at"), F.lit(1).alias("gone"), (-F.col("v")).alias("v"), F.lit(-1).cast("bigint").alias("one"), F.lit(None).cast(based.schema["row"].dataType).alias("row")
    )
    # rows without a time have no frame: a block of their own for each, below all others
    spread = -F.lit(1 << 60) - F.monotonically_increasing_id()
    steps = came.unionByName(went).withColumn("block", F.coalesce(F.floor(F.col("at") / wide), spread))
    left = steps.where("at is not null").groupBy(*names, "block").agg(F.sum("one").alias("bn"), F.sum("v").alias("bv"))
    before = W.partitionBy(*names).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = left.select(*(F.col(n).alias(f"c{n}") for n in names), F.col("block").alias("cblock"), F.sum("bn").over(before).alias("cn"), F.sum("bv").over(before).alias("cv"))
    here = W.partitionBy(*names, "block").orderBy("at", "gone").rangeBetween(W.unboundedPreceding, W.currentRow)
    run = steps.select("*", F.sum("one").over(here).alias("rn"), F.sum("v").over(here).alias("rv")).where("gone = 0")
    met = run.join(carried, _same([F.col(n) for n in (*names, "block")], [F.col(f"c{n}") for n in (*names, "block")]), "left")
    kind, none = f"decimal(38,{scale})", F.lit(0)
    n = F.coalesce("cn", none) + F.coalesce("rn", none)
    total = (F.coalesce("cv", none).cast(kind) + F.coalesce("rv", none).cast(kind)).cast(kind)
    timed = F.col("at").isNotNull()
    return met.select("row.*", F.when(timed, n).alias("moving_n"), F.when(timed & (n > 0), total).alias("moving_total"))


def top_k(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` keys with most rows; ties go to the smaller key, null before all."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def rolled_up(rows: DataFrame, *keys: Column, scale: int = SCALE) -> DataFrame:
    """Counts and totals of the keys and of each shorter list of them; ``level`` tells a null key from none."""
    return rows.rollup(*keys).agg(F.count("*").alias("n"), exact_sum("value", scale).alias("total"), F.grouping_id().cast("bigint").alias("level"))


def as_of(left: DataFrame, right: DataFrame, key: str, values: Sequence[str], ts: str = "ts", prefix: str = "r_", block: str = "1 hour") -> DataFrame:
    """Each left row with the latest right row of its key at or before its time, as ``prefix`` and its columns.

    A key is cut by blocks of time: each block of a key that left rows have gets the last right row of the blocks before,
    and is a task's share by itself, so a hot key is no single task, nor is its day. Of right rows at one time the one with the largest
    values counts. A null key or time matches nothing. A left column that is called like a result is an error.
    """
    results = [f"{prefix}{c}" for c in (ts, *values)]
    if clash := set(results) & set(left.columns):
        raise ValueError(f"left side has {sorted(clash)} already")
    last = F.struct(F.col(ts).alias("t"), *(F.col(v).alias(f"v{i}") for i, v in enumerate(values)))

    wide = seconds_of(block) * 1_000_000

    def number(c):
        return F.floor(micros(c) / wide)

    known = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("k"), number(ts).alias("d"), F.col(ts).alias("t"), last.alias("r"))
    asking = left.select(F.col(key).alias("k"), number(ts).alias("d"), F.col(ts).alias("t"), F.struct(*left.columns).alias("row"))
    # what each block of a key hands on, carried to the blocks that are asked for: a row for each key and block
    days = known.groupBy("k", "d").agg(F.max("r").alias("r")).withColumn("asked", F.lit(False))
    asked = asking.where("k is not null and d is not null").select("k", "d").distinct().select("k", "d", F.lit(None).cast(days.schema["r"].dataType).alias("r"), F.lit(True).alias("asked"))
    daily = days.unionByName(asked).groupBy("k", "d").agg(F.max("r").alias("r"), F.max("asked").alias("asked"))
    before = W.partitionBy("k").orderBy("d").rowsBetween(W.unboundedPreceding, -1)
    carried = daily.withColumn("r", F.last("r", ignorenulls=True).over(before)).where("asked and r is not null")
    no_row = F.lit(None).cast(asking.schema["row"].dataType).alias("row")
    both = (
        carried.select("k", "d", F.col("r.t").alias("t"), F.lit(0).alias("side"), "r", no_row)
        .unionByName(known.select("k", "d", "t", F.lit(1).alias("side"), "r", no_row))
        .unionByName(asking.select("k", "d", "t", F.lit(2).alias("side"), F.lit(None).cast(known.schema["r"].dataType).alias("r"), "row"))
    )
    # null keys are spread, they match nothing
    spread = F.when(F.col("k").isNull(), F.xxhash64("t"))
    w = W.partitionBy("k", "d", spread).orderBy("t", "side", "r").rowsBetween(W.unboundedPreceding, 0)
    held = both.withColumn("r", F.last("r", ignorenulls=True).over(w)).where("side = 2")
    return held.select("row.*", *(F.col(f"r.{c}").alias(n) for c, n in zip(("t", *(f"v{i}" for i in range(len(values)))), results)))


def quantiles(rows: DataFrame, key: str, shares: Sequence[float], value: str = "value") -> DataFrame:
    """Exact quantiles, between neighbours where the share falls between them, to nine digits.

    Values are counted, then counted by cells (256 for each doubling); running sums over a key's cells tell which
    of them hold the ranks asked for, and the values of these alone are put in order. Null values do not count; a
    key without a value has nulls; NaN is the largest value. A share of 0.995 is called ``p99_5``. The rows are read
    once: their counts are written, and all else is made from them.
    """
    names = [f"p{float(p) * 100:.10g}".replace(".", "_").replace("-", "_") for p in shares]
    if len({*names, key}) != len(names) + 1 or any(not 0 <= p <= 1 for p in shares):
        raise ValueError(f"shares have to be different and from 0 to 1, and the key called otherwise: {names}")
    spark = rows.sparkSession
    tallied = rows.groupBy(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    path = f"{scratch(spark)}/counts"
    tallied.write.parquet(path)
    written = spark.read.schema(tallied.schema).parquet(path)
    counts = written.where("v is not null")
    size = F.floor(F.log2(1 + F.abs("v") * 100) * 256)
    cell = F.when(F.isnan("v"), F.lit(1 << 40)).when(F.col("v") < 0, -1 - size).otherwise(F.least(size, F.lit(1 << 39))).cast("bigint")
    counts = counts.withColumn("cell", F.greatest(cell, F.lit(-(1 << 39)).cast("bigint")))
    up = W.partitionBy("k").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = counts.groupBy("k", "cell").agg(F.sum("n").alias("n"))
    cells = cells.select("k", "cell", "n", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("first"), F.sum("n").over(W.partitionBy("k")).alias("all"))
    ranks = F.array(*(F.struct(F.lit(i).alias("i"), ((F.col("all") - 1).cast("double") * float(p)).alias("rank")) for i, p in enumerate(shares)))
    wanted = cells.select("k", "cell", "n", "first", F.explode(ranks).alias("w")).select("k", "cell", "n", "first", "w.*")
    ends = F.array(F.struct(F.lit(0).alias("e"), F.floor("rank").alias("at")), F.struct(F.lit(1).alias("e"), F.ceil("rank").alias("at")))
    wanted = wanted.select("k", "cell", "n", "first", "i", "rank", F.explode(ends).alias("w")).select("k", "cell", "n", "first", "i", "rank", "w.*")
    wanted = wanted.where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("n"))).drop("n")
    here = wanted.select(F.col("k").alias("hk"), F.col("cell").alias("hc")).distinct()
    inner = counts.join(here, _same([F.col("k"), F.col("cell")], [F.col("hk"), F.col("hc")]), "left_semi")
    sums = F.coalesce(F.sum("n").over(W.partitionBy("k", "cell").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = inner.select(F.col("k").alias("pk"), F.col("cell").alias("pc"), "v", F.col("n").alias("pn"), sums.alias("before"))
    on = _same([F.col("k"), F.col("cell")], [F.col("pk"), F.col("pc")]) & (F.col("at") - F.col("first") >= F.col("before")) & (F.col("at") - F.col("first") < F.col("before") + F.col("pn"))
    picked = wanted.join(placed, on).groupBy("k", "i").agg(
        F.max(F.when(F.col("e") == 0, F.col("v"))).alias("low"), F.max(F.when(F.col("e") == 1, F.col("v"))).alias("high"), F.max(F.col("rank") - F.floor("rank")).alias("part")
    )
    found = picked.groupBy("k").agg(*(
        F.round(F.max(F.when(F.col("i") == i, F.col("low") + F.when(F.col("part") > 0, (F.col("high") - F.col("low")) * F.col("part")).otherwise(0.0))), 9).alias(name)
        for i, name in enumerate(names)
    ))
    every = written.select(F.col("k").alias("key")).distinct()
    return every.join(found, F.col("key").eqNullSafe(F.col("k")), "left").select(F.col("key").alias(key), *names)


def spread(rows: DataFrame, key: str, scale: int = SCALE) -> DataFrame:
    """n, sample variance and deviation, to six digits, from exact sums: each value's distance from its key's
    mean (rounded to the scale) is a decimal, so large values lose nothing to small differences."""
    kind = f"decimal({16 + scale},{scale})"
    rows = rows.select(F.col(key).alias("key"), exact("value", scale).alias("v"))
    n = F.count("v").alias("n")
    means = rows.groupBy(F.col("key").alias("k")).agg(F.round(F.sum("v") / F.nullif(F.count("v"), F.lit(0)), scale).cast(kind).alias("centre"))
    apart = (F.col("v") - F.col("centre")).cast(kind)
    placed = rows.join(means, F.col("key").eqNullSafe(F.col("k")))
    sums = placed.groupBy("key").agg(n, F.sum(apart).alias("s"), F.sum(apart * apart).alias("q"))
    s, q, n = F.col("s").cast("double"), F.col("q").cast("double"), F.col("n")
    variance = F.when(n > 1, (q - s * s / n) / (n - 1))
    return sums.select(F.col("key").alias(key), "n", F.round(variance, 6).alias("variance"), F.round(F.sqrt(variance), 6).alias("deviation"))
