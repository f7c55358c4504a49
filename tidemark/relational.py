"""Relational queries around the measurements: joins, sets, windows, predicates, scalar functions.

Registered beside the bucket queries; each has its DuckDB text. Sums are of decimals, so they are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.buckets import TOTAL, calendar_bucket, exact, exact_sum, hour_number
from .operators import intervals
from .session import scratch
from .sources import clustered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        SQL[build.__name__] = sql
        return build

    return register


_REVENUE = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DECIMAL(38,4))"


def _revenue():
    return F.sum(exact("l_extendedprice") * (F.lit(1) - exact("l_discount"))).cast("decimal(38,4)")


@query(f"""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS quantity, {_REVENUE} AS revenue
FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), exact_sum("l_quantity").alias("quantity"), _revenue().alias("revenue"))


@query(f"""SELECT n_name, {_REVENUE} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1""")
def inner_joins(t: Tables) -> DataFrame:
    nations = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    sold = t.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    return t.lineitem.join(sold, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name").agg(_revenue().alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_join(t: Tables) -> DataFrame:
    made = t.orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"))  # summed first, so that a hot customer is no hot key
    return t.customer.join(made, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("SELECT s_nationkey, c_nationkey, sellers, buyers FROM (SELECT s_nationkey, count(*) AS sellers FROM supplier GROUP BY 1) "
       "FULL JOIN (SELECT c_nationkey, count(*) AS buyers FROM customer GROUP BY 1) ON s_nationkey = c_nationkey")
def full_join(t: Tables) -> DataFrame:
    sellers = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("sellers"))
    buyers = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("buyers"))
    return sellers.join(buyers, F.col("s_nationkey") == F.col("c_nationkey"), "full")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_join(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'")
    return t.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT a.event_id, count(b.event_id) AS within FROM (SELECT * FROM events WHERE event_type = 'error') a JOIN events b
ON a.user_id = b.user_id AND b.ts >= a.ts - INTERVAL 1 HOUR AND b.ts < a.ts GROUP BY 1""")
def range_join(t: Tables) -> DataFrame:
    """Rows of the hour before each error: hours meet as equal buckets, and the exact range is checked there."""
    errors = t.events.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("ts").alias("at"))
    hour = hour_number("at")
    probes = errors.withColumn("h", F.explode(F.array(hour, hour - 1)))
    met = probes.join(t.events.select("user_id", "ts").withColumn("h", hour_number("ts")), ["user_id", "h"])
    before = met.where((F.col("ts") >= F.col("at") - F.expr("interval 1 hour")) & (F.col("ts") < F.col("at")))
    return before.groupBy(F.col("error_id").alias("event_id")).agg(F.count("*").alias("within"))


@query("""SELECT n_nationkey, c_custkey, c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey
ORDER BY c_acctbal DESC, c_custkey LIMIT 3)""")
def lateral_top(t: Tables) -> DataFrame:
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    best = t.customer.withColumn("_n", F.row_number().over(w)).where("_n <= 3")
    return t.nation.join(best, F.col("n_nationkey") == F.col("c_nationkey")).select("n_nationkey", "c_custkey", "c_acctbal")


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level
FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)""")
def cube_of_orders(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")
def grouping_sets(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", "l_linestatus")
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return rows.groupingSets([[a], [b], []], a, b).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 15")


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) FILTER (WHERE event_type = 'click') AS click,
count(*) FILTER (WHERE event_type = 'view') AS "view" FROM events GROUP BY 1""")
def pivoted(t: Tables) -> DataFrame:
    day = calendar_bucket("ts", "day").alias("day")
    return t.events.groupBy(day).pivot("event_type", ["click", "view"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""SELECT user_id, event_id, row_number() OVER w AS place, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS rank,
dense_rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS dense, ntile(4) OVER w AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)""")
def ranking_windows(t: Tables) -> DataFrame:
    order = W.partitionBy("user_id").orderBy(F.desc("value"))
    full = W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return t.events.select(
        "user_id", "event_id", F.row_number().over(full).cast("bigint").alias("place"), F.rank().over(order).cast("bigint").alias("rank"),
        F.dense_rank().over(order).cast("bigint").alias("dense"), F.ntile(4).over(full).cast("bigint").alias("quarter"),
    )


@query("""SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after, first_value(value) OVER w AS first,
nth_value(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,
CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS last_three
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def analytic_windows(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return t.events.select(
        "event_id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"), F.first("value").over(w).alias("first"),
        F.nth_value("value", 2).over(whole).alias("second"), F.sum(exact("value")).over(w.rowsBetween(-2, 0)).cast(TOTAL).alias("last_three"),
    )


@query("""SELECT s_nationkey AS k, 's' AS side FROM supplier UNION ALL SELECT c_nationkey, 'c' FROM customer""")
def union_all(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_nationkey").alias("k"), F.lit("s").alias("side")).unionByName(t.customer.select(F.col("c_nationkey").alias("k"), F.lit("c").alias("side")))


@query("""(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def set_operations(t: Tables) -> DataFrame:
    def of(status):
        return t.orders.where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"))

    return of("F").intersect(of("O")).subtract(of("P"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def third_page(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size BETWEEN 10 AND 30 THEN 'middle' ELSE 'large' END AS size
FROM part WHERE p_type LIKE '%A%' AND regexp_matches(p_name, '[aeiou]') AND p_brand IS NOT NULL AND p_size IN (1, 5, 9, 15, 25, 35, 45)""")
def predicates(t: Tables) -> DataFrame:
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size").between(10, 30), "middle").otherwise("large")
    kept = t.part.where(F.col("p_type").like("%A%") & F.col("p_name").rlike("[aeiou]") & F.col("p_brand").isNotNull() & F.col("p_size").isin(1, 5, 9, 15, 25, 35, 45))
    return kept.select("p_partkey", size.alias("size"))


@query("""SELECT c_custkey, upper(c_mktsegment) AS segment, substr(c_name, 1, 4) AS begin, length(c_name) AS size, replace(c_name, '0', '') AS bare,
abs(round(c_acctbal)) AS rounded, c_custkey % 7 AS rest, coalesce(nullif(c_nationkey, 3), -1) AS nation FROM customer""")
def scalar_functions(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey", F.upper("c_mktsegment").alias("segment"), F.substring("c_name", 1, 4).alias("begin"), F.length("c_name").cast("bigint").alias("size"),
        F.replace("c_name", F.lit("0"), F.lit("")).alias("bare"), F.abs(F.round("c_acctbal")).alias("rounded"), (F.col("c_custkey") % 7).alias("rest"),
        F.coalesce(F.nullif(F.col("c_nationkey"), F.lit(3)), F.lit(-1)).alias("nation"),
    )


@query("""SELECT o_custkey, len(keys) AS n, list_sum(list_slice(keys, 1, 3))::BIGINT AS first_three, list_contains(statuses, 'F') AS has_f
FROM (SELECT o_custkey, list_sort(list(o_orderkey)) AS keys, list(DISTINCT o_orderstatus) AS statuses FROM orders GROUP BY 1)""")
def array_functions(t: Tables) -> DataFrame:
    """Lists of a customer's orders; their number is bounded by what a customer orders."""
    lists = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"), F.collect_set("o_orderstatus").alias("statuses"))
    three = F.aggregate(F.slice("keys", 1, 3), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return lists.select("o_custkey", F.size("keys").cast("bigint").alias("n"), three.alias("first_three"), F.array_contains("statuses", "F").alias("has_f"))


@query("SELECT c_custkey, count(o_orderkey) AS urgent FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') RIGHT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def right_join(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("urgent"))
    return urgent.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", F.coalesce("urgent", F.lit(0)).alias("urgent"))


@query("""SELECT band, count(*) AS parts, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS worth
FROM part JOIN (VALUES ('small', 0, 10), ('middle', 8, 30), ('large', 25, 1000)) AS b(band, low, high) ON p_size >= low AND p_size < high GROUP BY 1""")
def theta_join(t: Tables) -> DataFrame:
    """Bands that overlap, met by inequality alone: a nested loop over three rows that go to every task."""
    bands = t._spark.createDataFrame([("small", 0, 10), ("middle", 8, 30), ("large", 25, 1000)], "band string, low int, high int")
    met = t.part.join(F.broadcast(bands), (F.col("p_size") >= F.col("low")) & (F.col("p_size") < F.col("high")))
    return met.groupBy("band").agg(F.count("*").alias("parts"), exact_sum("p_retailprice").alias("worth"))


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def union_distinct(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_nationkey").alias("k")).union(t.customer.where("c_acctbal < 0").select("c_nationkey")).distinct()


@query("""SELECT user_id, CAST(coalesce(m['click'], 0) AS BIGINT) AS clicks, CAST(len(map_keys(m)) AS BIGINT) AS kinds, array_to_string(list_sort(map_keys(m)), ',') AS names,
CAST(list_sum(map_values(m)) AS BIGINT) AS events
FROM (SELECT user_id, map_from_entries(list((event_type, n))) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1)""")
def map_functions(t: Tables) -> DataFrame:
    """A user's counts by kind as a map; kinds are few."""
    counts = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return maps.select(
        "user_id", F.coalesce(F.element_at("m", "click"), F.lit(0).cast("bigint")).alias("clicks"), F.size(F.map_keys("m")).cast("bigint").alias("kinds"),
        F.array_join(F.sort_array(F.map_keys("m")), ",").alias("names"), total.alias("events"),
    )


@query("""WITH spans AS (SELECT o_orderkey, o_custkey, o_orderdate AS opened, o_orderdate + to_seconds(CASE o_orderkey % 7 WHEN 0 THEN 86400 * 300 WHEN 1 THEN 86400 * 20 WHEN 2 THEN 3600 ELSE 86400 * (o_orderkey % 5) END) AS closed FROM orders)
SELECT a.o_orderkey, b.o_orderkey AS r_o_orderkey, a.o_custkey FROM spans a JOIN spans b ON a.o_custkey = b.o_custkey AND a.opened < b.closed AND b.opened < a.closed
WHERE a.opened < a.closed AND b.opened < b.closed AND a.o_orderkey < b.o_orderkey""")
def orders_open_together(t: Tables) -> DataFrame:
    """Pairs of a customer's orders that were open at one moment; orders stay open from no time at all to 300 days."""
    key = F.col("o_orderkey")
    days = F.when(key % 7 == 0, 86_400 * 300).when(key % 7 == 1, 86_400 * 20).when(key % 7 == 2, 3600).otherwise(86_400 * (key % 5))
    spans = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("opened"), (F.col("o_orderdate") + F.make_dt_interval(secs=days.cast("decimal(18,6)"))).alias("closed"))
    pairs = intervals.overlapping(spans, spans, "opened", "closed", ["o_custkey"])
    return pairs.where("o_orderkey < r_o_orderkey").select("o_orderkey", "r_o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, o_orderpriority, count(*) AS lines, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS pieces
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def joined_by_buckets(t: Tables) -> DataFrame:
    """Orders and their lines, both written in buckets of the key: joined and summed without a shuffle."""
    path = scratch(t._spark)
    orders = clustered.bucketed_table(t.orders.select("o_orderkey", "o_orderpriority"), f"{path}/orders", "o_orderkey", 16)
    lines = clustered.bucketed_table(t.lineitem.select("l_orderkey", "l_quantity"), f"{path}/lines", "l_orderkey", 16)
    met = orders.hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return met.groupBy("o_orderkey", "o_orderpriority").agg(F.count("*").alias("lines"), exact_sum("l_quantity").alias("pieces"))


@query("""SELECT n_nationkey, c_custkey, c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey
ORDER BY c_acctbal DESC, c_custkey LIMIT 3)""")
def lateral_subquery(t: Tables) -> DataFrame:
    """The same three customers as ``lateral_top``, by a correlated subquery: Spark plans it as a window over the inner rows and a join."""
    inner = t.customer.where(F.col("c_nationkey") == F.col("n_nationkey").outer()).select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(3)
    return t.nation.lateralJoin(inner).select("n_nationkey", "c_custkey", "c_acctbal")
