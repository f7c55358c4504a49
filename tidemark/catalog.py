"""Every registered query beside its DuckDB text. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import relational
from .functions import variants
from .functions.buckets import bucket, calendar_bucket, exact_sum, json_number, parsed
from .operators import distinct, intervals
from .operators import timeseries as ts_ops
from .plans.query import BucketQuery
from .session import scratch
from .sources import clustered, database, log, measurements, merged
from .streaming import corrections, landing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_DEC = "CAST(value AS DECIMAL(18,2))"
_TOTAL = f"CAST(sum({_DEC}) AS DECIMAL(38,2))"
_AGGS = (
    f"count(value) AS n, {_TOTAL} AS total, CAST(sum({_DEC}) AS DOUBLE) / nullif(count(value), 0) AS mean, "
    "min(value) AS lo, max(value) AS hi"
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements.read(spark, f"{sf_dir}/events.parquet")


def query(sql: str):
    """Register a function of the events table under its name, with its DuckDB text."""

    def register(build: Callable[[DataFrame], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(events(spark, sf_dir))
        SQL[build.__name__] = sql
        return build

    return register


@query(f"""SELECT event_type, time_bucket(interval '1 hour', ts) AS bucket_start, {_AGGS} FROM events
WHERE ts >= '2024-01-05' AND ts < '2024-01-12' GROUP BY 1, 2""")
def hourly_by_type(rows: DataFrame) -> DataFrame:
    return BucketQuery("1 hour").between("2024-01-05", "2024-01-12").by("event_type").run(rows)


@query(f"SELECT time_bucket(interval '15 minutes', ts) AS bucket_start, {_AGGS} FROM events GROUP BY 1")
def quarter_hours(rows: DataFrame) -> DataFrame:
    return BucketQuery("15 minutes").run(rows)


@query(f"SELECT user_id, time_bucket(interval '1 day', ts) AS bucket_start, {_AGGS} FROM events GROUP BY 1, 2")
def daily_by_user(rows: DataFrame) -> DataFrame:
    return BucketQuery("1 day").by("user_id").run(rows)


@query(f"SELECT time_bucket(interval '7 days', ts) AS bucket_start, {_AGGS} FROM events GROUP BY 1")
def weeks_from_monday(rows: DataFrame) -> DataFrame:
    return BucketQuery("7 days", origin="4 days").run(rows)


@query(f"SELECT time_bucket(interval '7 minutes', ts, timestamp '1970-01-01') AS bucket_start, {_AGGS} FROM events GROUP BY 1")
def seven_minutes(rows: DataFrame) -> DataFrame:
    return BucketQuery("7 minutes").run(rows)


@query(f"""SELECT event_type, time_bucket(interval '1 day', ts) AS bucket_start, {_AGGS} FROM events
WHERE event_type IN ('click', 'view') AND user_id = 7 GROUP BY 1, 2""")
def daily_of_series(rows: DataFrame) -> DataFrame:
    return BucketQuery("1 day").where("event_type", "click", "view").where("user_id", 7).by("event_type").run(rows)


for _unit in ("hour", "day", "week", "month", "quarter", "year"):
    QUERIES[f"calendar_{_unit}"] = lambda spark, sf_dir, unit=_unit: BucketQuery(unit=unit).run(events(spark, sf_dir))
    SQL[f"calendar_{_unit}"] = f"SELECT CAST(date_trunc('{_unit}', ts) AS TIMESTAMP) AS bucket_start, {_AGGS} FROM events GROUP BY 1"


@query(f"""SELECT CAST(date_trunc('day', ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AS TIMESTAMP) AS bucket_start, {_AGGS}
FROM events GROUP BY 1""")
def days_in_new_york(rows: DataFrame) -> DataFrame:
    return BucketQuery(unit="day", zone="America/New_York").run(rows)


@query(f"SELECT time_bucket(interval '1 day', ts) AS bucket_start, {_AGGS} FROM events GROUP BY 1")
def days_from_hours(rows: DataFrame) -> DataFrame:
    return ts_ops.coarser(BucketQuery("1 hour").run(rows), bucket("bucket_start", "1 day"))


@query(f"""WITH hours AS (SELECT time_bucket(interval '1 hour', ts) AS h, count(value) AS n, {_TOTAL} AS total FROM events WHERE event_id % 4000 <> 17 GROUP BY 1),
one AS (SELECT time_bucket(interval '1 day', h) AS bucket_start, CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS DECIMAL(38,2)) AS total FROM hours GROUP BY 1),
other AS (SELECT time_bucket(interval '1 day', ts) AS bucket_start, count(value) AS n, {_TOTAL} AS total FROM events GROUP BY 1)
SELECT *, 'one' AS side FROM (SELECT * FROM one EXCEPT ALL SELECT * FROM other) UNION ALL
SELECT *, 'other' AS side FROM (SELECT * FROM other EXCEPT ALL SELECT * FROM one)""")
def reconciliation(rows: DataFrame) -> DataFrame:
    """Days rolled up from hours that lack some rows, against days from all rows: the days that differ show on both sides."""
    lost = rows.where("event_id % 4000 <> 17")
    fine = ts_ops.coarser(BucketQuery("1 hour").run(lost), bucket("bucket_start", "1 day")).select("bucket_start", "n", "total")
    return ts_ops.reconciled(fine, BucketQuery("1 day").run(rows).select("bucket_start", "n", "total"))


@query(f"SELECT event_type, time_bucket(interval '6 hours', ts) AS bucket_start, {_AGGS} FROM events GROUP BY 1, 2 ORDER BY bucket_start, event_type")
def quarter_days_in_order(rows: DataFrame) -> DataFrame:
    return BucketQuery("6 hours").by("event_type").in_order().run(rows)


@query(f"""SELECT c.bucket_start, coalesce(b.n, 0) AS n, b.total FROM
(SELECT unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-30 23:45:00', interval '15 minutes')) AS bucket_start) c
LEFT JOIN (SELECT time_bucket(interval '15 minutes', ts) AS bucket_start, count(value) AS n, {_TOTAL} AS total FROM events GROUP BY 1) b
ON c.bucket_start = b.bucket_start""")
def gaps_filled(rows: DataFrame) -> DataFrame:
    buckets = BucketQuery("15 minutes").run(rows).select("bucket_start", "n", "total")
    return ts_ops.gap_filled(buckets, "2024-01-01 00:00:00", "2024-01-30 23:45:00", "15 minutes")


@query(f"""SELECT c.event_type, c.bucket_start, coalesce(b.n, 0) AS n FROM
(SELECT event_type, unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-30 23:00:00', interval '1 hour')) AS bucket_start
 FROM (SELECT DISTINCT event_type FROM events)) c
LEFT JOIN (SELECT event_type, time_bucket(interval '1 hour', ts) AS bucket_start, count(value) AS n FROM events GROUP BY 1, 2) b
ON c.event_type = b.event_type AND c.bucket_start = b.bucket_start""")
def gaps_filled_by_type(rows: DataFrame) -> DataFrame:
    buckets = BucketQuery("1 hour").by("event_type").run(rows).select("event_type", "bucket_start", "n")
    return ts_ops.gap_filled(buckets, "2024-01-01 00:00:00", "2024-01-30 23:00:00", "1 hour", rows.select("event_type").distinct())


@query(f"""SELECT bucket_start, {_AGGS} FROM
(SELECT unnest([time_bucket(interval '1 hour', ts), time_bucket(interval '1 hour', ts) - interval '1 hour']) AS bucket_start, value FROM events)
GROUP BY 1""")
def sliding_two_hours(rows: DataFrame) -> DataFrame:
    return ts_ops.sliding(rows, "2 hours", "1 hour")


@query(f"""WITH gaps AS (
  SELECT *, CASE WHEN ts < lag(ts) OVER w + interval '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM gaps)
SELECT user_id, min(ts) AS session_start, max(ts) AS last_ts, count(*) AS n, {_TOTAL} AS total FROM numbered GROUP BY user_id, s""")
def sessions_of_users(rows: DataFrame) -> DataFrame:
    return ts_ops.sessions(rows, "30 minutes", ["user_id"])


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.9), 9) AS p90 FROM events GROUP BY 1""")
def exact_quantiles(rows: DataFrame) -> DataFrame:
    return ts_ops.quantiles(rows, "event_type", (0.5, 0.9))


@query("""SELECT time_bucket(interval '1 day', ts) AS bucket_start, arg_min(value, row(ts, event_id)) AS first_value,
arg_max(value, row(ts, event_id)) AS last_value FROM events GROUP BY 1""")
def first_and_last(rows: DataFrame) -> DataFrame:
    return ts_ops.first_last(rows, bucket("ts", "1 day"))


@query("SELECT time_bucket(interval '1 day', ts) AS bucket_start, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def distinct_users(rows: DataFrame) -> DataFrame:
    return ts_ops.bucketed(rows, bucket("ts", "1 day"), aggregates=[F.count_distinct("user_id").alias("users")])


@query(f"""SELECT time_bucket(interval '1 day', ts) AS bucket_start, count(*) FILTER (WHERE event_type = 'error') AS errors,
CAST(sum({_DEC}) FILTER (WHERE event_type = 'purchase') AS DECIMAL(38,2)) AS bought FROM events GROUP BY 1""")
def filtered_counts(rows: DataFrame) -> DataFrame:
    bought = exact_sum(F.when(F.col("event_type") == "purchase", F.col("value")))
    return ts_ops.bucketed(rows, bucket("ts", "1 day"), aggregates=[F.count_if(F.col("event_type") == "error").alias("errors"), bought.alias("bought")])


@query("""SELECT event_type, count(value) AS n, round(var_samp(value), 6) AS variance, round(stddev_samp(value), 6) AS deviation FROM events GROUP BY 1""")
def variance_by_type(rows: DataFrame) -> DataFrame:
    return ts_ops.spread(rows, "event_type")


@query(f"""SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n, {_TOTAL} AS total,
CAST(grouping_id(event_type, CAST(date_trunc('day', ts) AS TIMESTAMP)) AS BIGINT) AS level
FROM events GROUP BY ROLLUP(event_type, CAST(date_trunc('day', ts) AS TIMESTAMP))""")
def rollup_by_type_and_day(rows: DataFrame) -> DataFrame:
    return ts_ops.rolled_up(rows.withColumn("day", calendar_bucket("ts", "day")), F.col("event_type"), F.col("day"))


@query(f"""WITH daily AS (SELECT time_bucket(interval '1 day', ts) AS bucket_start, {_TOTAL} AS total FROM events GROUP BY 1)
SELECT bucket_start, total, CAST(sum(total) OVER (ORDER BY bucket_start RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS moving_total FROM daily""")
def seven_day_total(rows: DataFrame) -> DataFrame:
    return ts_ops.moving_total(BucketQuery("1 day").run(rows).select("bucket_start", "total"), 6)


@query("""WITH daily AS (SELECT time_bucket(interval '1 day', ts) AS bucket_start, CAST(sum(CAST(event_id % 1000 AS DECIMAL(18,3)) / 1000) AS DECIMAL(38,3)) AS total FROM events GROUP BY 1)
SELECT bucket_start, total, CAST(sum(total) OVER (ORDER BY bucket_start RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW) AS DECIMAL(38,3)) AS moving_total FROM daily""")
def moving_three_decimals(rows: DataFrame) -> DataFrame:
    """Moving totals of totals with three decimals keep them."""
    fine = rows.withColumn("value", (F.col("event_id") % 1000 / 1000).cast("double"))
    return ts_ops.moving_total(BucketQuery("1 day").decimals(3).run(fine).select("bucket_start", "total"), 2)


_FRAME = "PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL {} PRECEDING AND CURRENT ROW"


@query(f"""SELECT 'half hour' AS span, event_id, event_type, count(value) OVER w AS moving_n, CAST(sum({_DEC}) OVER w AS DECIMAL(38,2)) AS moving_total FROM events WINDOW w AS ({_FRAME.format('30 MINUTES')})
UNION ALL SELECT 'two days', event_id, NULL, count(value) OVER w, CAST(sum({_DEC}) OVER w AS DECIMAL(38,2)) FROM events WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW)""")
def moving_frames(rows: DataFrame) -> DataFrame:
    """What came in the half hour up to each row by its type, and in two days over all rows, which are one key."""
    slim = rows.select("event_id", "event_type", "ts", "value")
    parts = ts_ops.moving(slim, "30 minutes", ["event_type"]), ts_ops.moving(slim, "2 days").withColumn("event_type", F.lit(None).cast("string"))
    named = [p.select(F.lit(span).alias("span"), "event_id", "event_type", "moving_n", "moving_total") for span, p in zip(("half hour", "two days"), parts)]
    return named[0].unionByName(named[1])


@query(f"""WITH gaps AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + interval '5 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (ORDER BY ts, event_id) AS s FROM gaps)
SELECT min(ts) AS session_start, max(ts) AS last_ts, count(*) AS n, {_TOTAL} AS total FROM numbered GROUP BY s""")
def sessions_of_all(rows: DataFrame) -> DataFrame:
    """Sessions of all rows as one key, which is many tasks."""
    return ts_ops.sessions(rows, "5 minutes", [])


@query("""SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS bucket_start, 'month' AS unit, event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 3
UNION ALL SELECT time_bucket(interval '7 days', ts), 'week', NULL, count(DISTINCT user_id) FROM events GROUP BY 1
UNION ALL SELECT NULL, 'span', event_type, count(DISTINCT user_id) FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-08' GROUP BY 3""")
def distinct_users_rolled_up(rows: DataFrame) -> DataFrame:
    """Distinct users of weeks, months and a span of days from the bitmaps of days, which are written and read; rows are read once."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    made = distinct.bitmaps(rows, bucket("ts", "1 day"), "user_id", ["event_type"])
    made.write.parquet(f"{path}/bitmaps")
    days = spark.read.schema(made.schema).parquet(f"{path}/bitmaps")
    month = distinct.counted(distinct.merged(days, calendar_bucket("bucket_start", "month"), ["event_type"]), ["event_type"], "users")
    week = distinct.counted(distinct.merged(days, bucket("bucket_start", "7 days", "4 days")), name="users")
    span = distinct.counted_between(days, "2024-01-05", "2024-01-08", ["event_type"], "users")
    none = F.lit(None)
    return month.select("bucket_start", F.lit("month").alias("unit"), "event_type", "users").unionByName(
        week.select("bucket_start", F.lit("week").alias("unit"), none.cast("string").alias("event_type"), "users")
    ).unionByName(span.select(none.cast("timestamp_ntz").alias("bucket_start"), F.lit("span").alias("unit"), "event_type", "users"))


#: Nested documents of the events: lists, objects, a value whose type differs, and texts that are no JSON.
_NESTED = """CASE WHEN event_id % 11 = 0 THEN '{"torn": ' || event_id ELSE '{"props": ' || props || ', "user": {"id": ' || user_id || ', "tags": ["' || event_type || '", ' ||
  CASE WHEN event_id % 2 = 0 THEN '"even"' ELSE 'null' END || ']}, "mixed": ' || CASE event_id % 3 WHEN 0 THEN '"' || event_id || '"' WHEN 1 THEN CAST(event_id AS TEXT) ELSE '{"a": 1}' END || '}' END"""


@query(f"""SELECT event_id, json_valid(d) AS valid, TRY_CAST(json_extract_string(d, '$.props.k') AS BIGINT) AS k, TRY_CAST(json_extract_string(d, '$.user.id') AS BIGINT) AS user_id,
json_extract_string(d, '$.user.tags[1]') AS tag, TRY_CAST(json_extract_string(d, '$.mixed') AS BIGINT) AS mixed, json_extract_string(d, '$.none.such') AS none
FROM (SELECT event_id, CASE WHEN json_valid(d) THEN d END AS d FROM (SELECT event_id, {_NESTED.replace('TEXT', 'VARCHAR')} AS d FROM events)) WHERE d IS NOT NULL
UNION ALL SELECT event_id, false, NULL, NULL, NULL, NULL, NULL FROM events WHERE event_id % 11 = 0""")
def json_variants(rows: DataFrame) -> DataFrame:
    """Paths of nested documents, with missing ones, values of another type and texts that are no JSON; a row is parsed once."""
    nested = rows.select("event_id", F.expr(_NESTED.replace("TEXT", "STRING")).alias("d"))
    found = variants.paths(
        nested, "d", whole=("$", "variant"), k=("$.props.k", "bigint"), user_id=("$.user.id", "bigint"), tag=("$.user.tags[1]", "string"), mixed=("$.mixed", "bigint"), none=("$.none.such", "string")
    )
    return found.select("event_id", F.col("whole").isNotNull().alias("valid"), "k", "user_id", "tag", "mixed", "none")


@query(f"""SELECT event_id, CAST(i - 1 AS INTEGER) AS pos, json_extract_string(d, '$.user.tags[' || (i - 1) || ']') AS tag
FROM (SELECT event_id, {_NESTED.replace('TEXT', 'VARCHAR')} AS d FROM events), range(1, 3) r(i) WHERE json_valid(d)""")
def json_elements(rows: DataFrame) -> DataFrame:
    """A row for each element of a nested list, null elements among them."""
    nested = rows.select("event_id", F.expr(_NESTED.replace("TEXT", "STRING")).alias("d"))
    return variants.exploded(nested, "d", "$.user.tags", "string", value="tag").drop("d")


@query("SELECT CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // (SELECT count(*) // 7 + 1 FROM events) AS BIGINT) AS page, event_id, ts, value FROM events")
def pages_in_turn(rows: DataFrame) -> DataFrame:
    """All rows in seven pages, each found from the last row of the one before; the table is sorted, so a page reads its own row groups."""
    spark, order = rows.sparkSession, ["ts", "event_id"]
    table = clustered.sorted_table(rows, f"{scratch(spark)}/sorted", order, 8)
    size, last, pages = table.count() // 7 + 1, None, []
    while (end := clustered.place_after(table, order, size, last)) is not None:
        found = clustered.between(table, order, last, end)
        pages.append(found.select(F.lit(len(pages)).cast("bigint").alias("page"), "event_id", "ts", "value"))
        last = end
    return reduce(DataFrame.unionByName, pages)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def top_users(rows: DataFrame) -> DataFrame:
    return ts_ops.top_k(rows, "user_id", 10)


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def replayed_rows_once(rows: DataFrame) -> DataFrame:
    return measurements.deduplicated(rows.unionByName(rows))


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE event_id % 10 NOT IN (3, 5, 7, 9)")
def good_rows(rows: DataFrame) -> DataFrame:
    """Of rows of which four in ten are made bad, the others."""
    good, _ = measurements.checked(_spoilt(rows))
    return good


@query("""SELECT CASE event_id % 10 WHEN 3 THEN 'no id' WHEN 5 THEN 'not a number' WHEN 7 THEN 'no time' ELSE 'too many decimals' END AS fault, count(*) AS n
FROM events WHERE event_id % 10 IN (3, 5, 7, 9) GROUP BY 1""")
def faults(rows: DataFrame) -> DataFrame:
    _, bad = measurements.checked(_spoilt(rows))
    return bad.groupBy(F.col("_fault").alias("fault")).agg(F.count("*").alias("n"))


def _spoilt(rows: DataFrame) -> DataFrame:
    kind = F.col("event_id") % 10
    odd = F.when(kind == 5, F.lit(float("nan"))).when(kind == 9, F.lit(0.125)).otherwise(F.col("value"))
    return rows.select(F.when(kind != 3, F.col("event_id")).alias("event_id"), F.when(kind != 7, F.col("ts")).alias("ts"), "user_id", "event_type", odd.alias("value"), "props")


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(event_id % 1000 AS DECIMAL(18,3)) / 1000) AS DECIMAL(38,3)) AS total,
count(*) FILTER (WHERE event_id % 10 <> 0) AS refused FROM events GROUP BY 1""")
def three_decimals(rows: DataFrame) -> DataFrame:
    """Values with three decimals: kept exactly where they are asked for, refused where sums have two."""
    fine = rows.withColumn("value", (F.col("event_id") % 1000 / 1000).cast("double"))
    _, bad = measurements.checked(fine)
    refused = bad.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("refused"))
    kept = fine.groupBy("event_type").agg(F.count("value").alias("n"), exact_sum("value", 3).alias("total"))
    return kept.join(refused, F.col("event_type") == F.col("kind"), "left").select("event_type", "n", "total", F.coalesce("refused", F.lit(0)).alias("refused"))


@query("""SELECT 'whole' AS batch_id, event_id, ts, value FROM events WHERE event_id % 2 = 0 AND ts < '2024-01-08'
UNION ALL SELECT '007', event_id, ts, value FROM events WHERE event_id % 2 = 1""")
def replayed_batch(rows: DataFrame) -> DataFrame:
    """A batch of a month, written again with its first week alone, beside another one: nothing of its later days stays."""
    path = scratch(rows.sparkSession)
    mine = rows.where("event_id % 2 = 0")
    measurements.write_batch(mine, path, "whole")
    measurements.write_batch(rows.where("event_id % 2 = 1"), path, "007")
    measurements.write_batch(mine.where("ts < timestamp_ntz '2024-01-08'"), path, "whole")
    return measurements.read_table(rows.sparkSession, path).select("batch_id", "event_id", "ts", "value")


_ODD_NAMES = ("é", "日本 2", "a/b=c", "100%", " x'{y}", "%C3%A9")


@query("""SELECT ['é', '日本 2', 'a/b=c', '100%', ' x''{y}', '%C3%A9'][1 + event_id % 6] AS batch_id, event_id, ts, value FROM events""")
def batch_names(rows: DataFrame) -> DataFrame:
    """Batches with names of any characters: each is read back as it was written, and found by a filter on its name."""
    path, spark = scratch(rows.sparkSession), rows.sparkSession
    for k, name in enumerate(_ODD_NAMES):
        measurements.write_batch(rows.where(F.col("event_id") % len(_ODD_NAMES) == k), path, name)
    table = measurements.read_table(spark, path).select("batch_id", "event_id", "ts", "value")
    found = [table.where(F.col("batch_id") == name) for name in _ODD_NAMES]
    return reduce(DataFrame.unionByName, found)


#: Batches of a month: most of it, its last weeks with every third row corrected (later, with another value), and early rows
#: once more as they were before (earlier, so they do not stand).
_CORRECTED = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 90 MINUTE ELSE ts END AS ts, user_id, event_type, CASE WHEN event_id % 3 = 0 THEN value * 2 ELSE value END AS value, props FROM events WHERE ts >= '2024-01-12'"
_TRUTH = f"""(SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts DESC, event_type DESC, props DESC, user_id DESC, value DESC) AS k FROM (
  SELECT * FROM events WHERE ts < '2024-01-21' UNION ALL {_CORRECTED}
  UNION ALL SELECT event_id, ts - INTERVAL 1 DAY, user_id, event_type, value * 4, props FROM events WHERE event_id % 5 = 0)) WHERE k = 1)"""


def _overlapping(rows: DataFrame) -> list[DataFrame]:
    corrected = rows.where("ts >= timestamp_ntz '2024-01-12'")
    third = F.col("event_id") % 3 == 0
    later = corrected.withColumn("ts", F.when(third, F.col("ts") + F.expr("interval 90 minutes")).otherwise(F.col("ts"))).withColumn("value", F.when(third, F.col("value") * 2).otherwise(F.col("value")))
    stale = rows.where("event_id % 5 = 0").withColumn("ts", F.col("ts") - F.expr("interval 1 day")).withColumn("value", F.col("value") * 4)
    return [rows.where("ts < timestamp_ntz '2024-01-21'"), later, stale]


def _landed(spark: SparkSession, batches: list[DataFrame], **rollups: merged.Rollup) -> str:
    path = scratch(spark)
    merged.create(spark, path, rollups, buckets=8)
    for k, batch in enumerate(batches):
        merged.land(batch, path, str(k))
    return path


@query(f"SELECT o.arrival, t.* FROM {_TRUTH} t, (VALUES ('forward'), ('backward')) o(arrival)")
def overlapping_batches(rows: DataFrame) -> DataFrame:
    """Three batches that bring each other's rows, landed in either order: the same row of each id stands."""
    spark, batches = rows.sparkSession, _overlapping(rows)
    ways = {"forward": batches, "backward": batches[::-1]}
    tables = [merged.rows(spark, _landed(spark, way)).select(F.lit(name).alias("arrival"), "event_id", "ts", "user_id", "event_type", "value", "props") for name, way in ways.items()]
    return tables[0].unionByName(tables[1])


@query(f"""SELECT 'hour' AS unit, event_type, time_bucket(interval '1 hour', ts) AS bucket_start, {_AGGS} FROM {_TRUTH} GROUP BY 2, 3
UNION ALL SELECT 'week', event_type, time_bucket(interval '7 days', ts), {_AGGS} FROM {_TRUTH} GROUP BY 2, 3
UNION ALL SELECT 'day', NULL, time_bucket(interval '1 day', ts), {_AGGS} FROM {_TRUTH} GROUP BY 3""")
def kept_rollups(rows: DataFrame) -> DataFrame:
    """Rollups kept up to date through late and repeated batches, and weeks made from them: as if built anew from the rows that stand."""
    spark, batches = rows.sparkSession, _overlapping(rows)
    path = _landed(spark, [batches[2], batches[0], batches[1], batches[0]], hours=merged.Rollup("1 hour", ("event_type",)))
    hours = merged.rollup(spark, path, "hours")
    week, day = merged.rolled_to(spark, path, "hours", bucket("bucket_start", "7 days", "4 days")), ts_ops.coarser(hours, bucket("bucket_start", "1 day"))
    parts = {"hour": hours, "week": week, "day": day.withColumn("event_type", F.lit(None).cast("string"))}
    named = [p.select(F.lit(unit).alias("unit"), "event_type", "bucket_start", "n", "total", "mean", "lo", "hi") for unit, p in parts.items()]
    return reduce(DataFrame.unionByName, named)


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def two_streams(rows: DataFrame) -> DataFrame:
    """Two streams into one table, and the first once more with nothing new: each row once."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    for k in (0, 1):
        rows.where(F.col("event_id") % 2 == k).write.parquet(f"{path}/source-{k}")
    for k in (0, 1, 0):
        source = landing.stream(spark, f"{path}/source-{k}")
        landing.land(source, f"{path}/table", f"{path}/rejects", f"{path}/checkpoint-{k}").awaitTermination()
    return measurements.read_table(spark, f"{path}/table").drop("batch_id", "dt")


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def stream_without_repeats(rows: DataFrame) -> DataFrame:
    """A stream that brings every row twice, in two files: the state of keys lets each through once."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    for k in range(2):
        rows.write.parquet(f"{path}/source/{k}")
    source = landing.stream(spark, f"{path}/source/*", files_at_once=1)
    landing.appended(landing.once(source, ["event_id"], "60 days"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(measurements.SCHEMA).parquet(f"{path}/out")


@query(f"""SELECT event_type, time_bucket(interval '1 day', ts) AS bucket_start, count(value) AS n, {_TOTAL} AS total FROM events
WHERE ts < (SELECT time_bucket(interval '1 day', max(ts) - interval '1 hour') FROM events) GROUP BY 1, 2""")
def closed_days_of_a_stream(rows: DataFrame) -> DataFrame:
    """Days that were over for an hour when a stream's last row came, each sent once."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    rows.write.parquet(f"{path}/source")
    source = landing.stream(spark, f"{path}/source")
    landing.appended(landing.closed_buckets(source, "1 day", "1 hour", ["event_type"]), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("bucket_start timestamp_ntz, event_type string, n bigint, total decimal(38,2)").parquet(f"{path}/out")


@query(f"SELECT event_type, time_bucket(interval '1 day', ts) AS bucket_start, count(value) AS n, {_TOTAL} AS total FROM events GROUP BY 1, 2")
def corrected_buckets_of_a_stream(rows: DataFrame) -> DataFrame:
    """Bucket totals of a stream of which every third row comes after all others: the change log, added up."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    late = F.col("event_id") % 3 == 0
    for k, part in enumerate((rows.where(~late), rows.where(late))):
        part.write.parquet(f"{path}/source/{k}")
        source = landing.stream(spark, f"{path}/source/*")
        changes = corrections.corrected_buckets(source, "1 day", "60 days", ["event_type"], slices=2)
        corrections.logged(changes, f"{path}/log", f"{path}/checkpoint").awaitTermination()
    return corrections.folded(corrections.read_log(spark, f"{path}/log", changes), ["event_type"]).select("event_type", "bucket_start", "n", "total")


@query(f"""WITH gaps AS (
  SELECT *, CASE WHEN ts < lag(ts) OVER w + interval '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM gaps)
SELECT user_id, min(ts) AS session_start, max(ts) AS last_ts, count(*) AS n, {_TOTAL} AS total FROM numbered GROUP BY user_id, s
HAVING max(ts) + interval '30 minutes' <= (SELECT max(ts) - interval '2 days' FROM events)""")
def closed_sessions_of_a_stream(rows: DataFrame) -> DataFrame:
    """Sessions that were over for two days when a stream's last row came; within a file rows come in any order."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    rows.write.parquet(f"{path}/source")
    source = landing.stream(spark, f"{path}/source")
    made = landing.closed_sessions(source, "30 minutes", "2 days", ["user_id"])
    landing.appended(made, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{path}/out")


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def through_the_log(rows: DataFrame) -> DataFrame:
    """Rows written to the log in two batches and streamed out of it, with a restart between them: each row once."""
    spark, path = log.registered(rows.sparkSession), scratch(rows.sparkSession)
    for k in (0, 1):
        rows.where(F.col("event_id") % 2 == k).write.format(log.FORMAT).mode("append").save(f"{path}/log")
        landing.appended(spark.readStream.format(log.FORMAT).load(f"{path}/log"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(measurements.SCHEMA).parquet(f"{path}/out")


@query("""SELECT time_bucket(interval '1 day', ts) AS bucket_start, count(*) AS rows, CAST((SELECT count(*) FROM events) - sum(count(*)) OVER (ORDER BY time_bucket(interval '1 day', ts)) AS BIGINT) AS left_over
FROM (SELECT timestamp '2024-01-01' + to_seconds(event_id * 30) AS ts FROM events WHERE event_id < (SELECT count(*) FROM events)) GROUP BY 1""")
def generated_load(rows: DataFrame) -> DataFrame:
    """As many generated measurements as there are events, by the custom source, met with the events by id and counted by day."""
    from .sources import generator

    size = rows.count()
    made = generator.load(rows.sparkSession, size).join(rows.select("event_id"), "event_id", "left_semi")
    days = ts_ops.bucketed(made, bucket("ts", "1 day"), aggregates=[F.count("*").alias("rows")])
    so_far = F.sum("rows").over(W.orderBy("bucket_start"))  # a row a day
    return days.select("bucket_start", "rows", (F.lit(size) - so_far).cast("bigint").alias("left_over"))


@query("SELECT 2 AS copies, event_id, ts, value FROM events")
def file_formats(rows: DataFrame) -> DataFrame:
    """Rows written as CSV, JSON and ORC and read back by the schema; the three agree row by row."""
    path, mine = scratch(rows.sparkSession), rows
    back = []
    for fmt in ("csv", "json", "orc"):
        micros = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}  # text formats write milliseconds otherwise
        mine.write.format(fmt).options(**micros).save(f"{path}/{fmt}")
        back.append(measurements.read(rows.sparkSession, f"{path}/{fmt}", fmt, **micros))
    first, *others = back
    same = others[0].unionByName(others[1]).groupBy(*first.columns).agg(F.count("*").alias("copies"))
    return first.join(same, first.columns).select(F.col("copies").cast("int").alias("copies"), "event_id", "ts", "value")


@query("SELECT event_id, ts, user_id, value, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS batch_id FROM events WHERE event_id % 2 = 1 OR event_id < 500")
def database_round_trip(rows: DataFrame) -> DataFrame:
    """Two batches in a database, one of them written again with fewer rows; read back in four ranges.

    The database is a file in the folder that driver and executors share; one that is embedded in a JVM is another in each.
    """
    spark, name = rows.sparkSession, "measured"
    connect = database.shared_file(f"{scratch(spark)}/rows.db")
    mine = rows.select("event_id", "ts", "user_id", "value")
    even = mine.where("event_id % 2 = 0")
    database.write(even, connect, name, "even")
    database.write(mine.where("event_id % 2 = 1"), connect, name, "odd")
    database.write(even.where("event_id < 500"), connect, name, "even")
    low, high = rows.agg(F.min("event_id"), F.max("event_id")).first()
    return database.read(spark, connect, name, "event_id bigint, ts timestamp_ntz, user_id bigint, value double, batch_id string", "event_id", (low, high), 4)


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE event_id % 2 = 0")
def json_lines_split(rows: DataFrame) -> DataFrame:
    """Every other row as a JSON line, the others torn: the good ones come back."""
    line = F.to_json(F.struct("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "user_id", "event_type", "value", "props"))
    torn = F.when(F.col("event_id") % 2 == 0, line).otherwise(F.expr("substring(event_type, 1, 3)"))
    good, _ = measurements.split_lines(rows.select(torn.alias("value")))
    return good


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_type").agg(F.sum(json_number("props", "$.k")).alias("k"))


@query("SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts FROM events")
def parsed_times(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", parsed(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts"))


@query("""SELECT l.event_id, l.ts, l.user_id, r.ts AS r_ts, r.value AS r_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN
(SELECT user_id, ts, max_by(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def last_view_of_purchase(rows: DataFrame) -> DataFrame:
    views = rows.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return ts_ops.as_of(rows.where("event_type = 'purchase'").select("event_id", "ts", "user_id"), views, "user_id", ["value"])


QUERIES |= relational.QUERIES
SQL |= relational.SQL
