"""Batches of measurements: schema, checks, replay-safe writes."""

from __future__ import annotations

import uuid
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.buckets import SCALE, fits, micros
from ..session import unused

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
KEY = ["event_id"]
#: The time as a number, kept beside it in tables: filters on a timestamp without a zone are handed to the Parquet reader,
#: which leaves out no row group for them; for whole numbers it does.
INDEX = "ts_us"


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = SCHEMA, **options) -> DataFrame:
    """A batch in Parquet, ORC, JSON or CSV (or Avro, where its package is on the class path), by an explicit
    schema: nothing is inferred from the data."""
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def read_lines(spark: SparkSession, path: str, schema: str = SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of JSON lines. ``bad`` keeps the line as it came, with what is wrong with it."""
    return split_lines(spark.read.text(path), schema)


def split_lines(lines: DataFrame, schema: str = SCHEMA, column: str = "value", scale: int = SCALE) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of a column of JSON lines; a null line is no record."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    record = F.from_json(column, f"{schema}, _corrupt string", options)
    # an exploded list of one is a barrier: filters and fields above it do not parse the line again
    rows = lines.select(F.col(column).alias("_line"), F.explode_outer(F.array(record)).alias("r"))
    torn = F.col("_line").isNull() | F.col("r._corrupt").isNotNull()
    rows = rows.select("_line", "r.*", F.when(torn, "not a record").otherwise(fault(scale, "r.")).alias("_fault"))
    return rows.where("_fault is null").drop("_line", "_corrupt", "_fault"), rows.where("_fault is not null").select("_line", "_fault")


def fault(scale: int = SCALE, prefix: str = "") -> Column:
    """What is wrong with a measurement, null if nothing is: null keys and times, numbers that are none, and
    numbers with more decimals than exact sums keep."""
    value = F.col(f"{prefix}value")
    return (
        F.when(F.col(f"{prefix}event_id").isNull(), "no id").when(F.col(f"{prefix}ts").isNull(), "no time")
        .when(F.isnan(value) | value.isin(float("inf"), float("-inf")), "not a number")
        .when(F.abs(value) >= 1e15, "out of range").when(~fits(value, scale), "too many decimals")
    )


def checked(batch: DataFrame, scale: int = SCALE) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a batch; a null value is a measurement without a number and is good.

    ``bad`` has a column ``_fault`` more; a column of that name is replaced.
    """
    rows = batch.withColumn("_fault", fault(scale))
    return rows.where("_fault is null").select(*(c for c in batch.columns if c != "_fault")), rows.where("_fault is not null")


def deduplicated(rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One row for each key, the same one in any order of arrival: the latest time, then the largest rest.

    Rows with a null in their key are not known to be the same and all stay.
    """
    rest = sorted(c for c in rows.columns if c not in key and c != "ts")
    keyless = F.greatest(*(F.col(k).isNull() for k in key)) if len(key) > 1 else F.col(key[0]).isNull()
    n, own = unused(rows, "_n"), unused(rows, "_own")
    # each row without a key is a key of its own, so that first rows alone are asked for and the others go before the shuffle
    spread = F.when(keyless, F.monotonically_increasing_id())
    w = W.partitionBy(*key, own).orderBy(F.desc_nulls_last("ts"), *(F.desc_nulls_last(c) for c in rest))
    return rows.withColumn(own, spread).withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n, own)


#: The characters that Spark escapes in a folder of a partition.
_ESCAPED = "\"#%'*/:=?\\\x7f{[]^" + "".join(map(chr, range(1, 32)))


def folder_of(batch_id: str) -> str:
    """The folder of a batch, as Spark names one and reads it back: any id comes back as the text it was."""
    if not batch_id or "\0" in batch_id or batch_id == "__HIVE_DEFAULT_PARTITION__":
        raise ValueError(f"no id of a batch: {batch_id!r}")
    return "batch_id=" + "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in batch_id)


def _restored(fs, path, folder: str) -> None:
    """Undo or finish what a writer left that ended between its renames: a batch that was moved aside and whose
    new rows never came is put back."""
    if not fs.exists(path):
        return
    at = path.suffix(f"/{folder}")
    for found in fs.listStatus(path):
        kind, _, whose = found.getPath().getName().partition("-")
        if whose[33:] != _bare(folder):
            continue
        if kind == "_old" and not fs.exists(at):
            if not fs.rename(found.getPath(), at):
                raise OSError(f"{found.getPath()} could not be put back")
        elif kind in ("_old", "_fresh"):
            fs.delete(found.getPath(), True)


def _bare(folder: str) -> str:
    """The batch's part of a hidden name; one with an equals sign would not be hidden."""
    return folder.removeprefix("batch_id=")


def _replaced(out: DataFrame, path: str, batch_id: str, by: list[str]) -> None:
    """Write a batch's folder of a table beside it, then put it in place of what the folder held before."""
    folder, spark, run = folder_of(batch_id), out.sparkSession, uuid.uuid4().hex
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    _restored(fs, top, folder)
    staged, aside, at = (top.suffix(f"/{name}") for name in (f"_fresh-{run}-{_bare(folder)}", f"_old-{run}-{_bare(folder)}", folder))
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(staged.toString())
    before = fs.exists(at)
    if before and not fs.rename(at, aside):
        raise OSError(f"{at} could not be moved")
    if not fs.rename(staged, at):
        if before:
            fs.rename(aside, at)
        raise OSError(f"{staged} could not be moved")
    if before:
        fs.delete(aside, True)


def write_batch(rows: DataFrame, path: str, batch_id: str) -> None:
    """Write a batch as its own folder of a table, split by day; writing it again replaces all of it.

    The rows are written under a hidden name first, so a failed write leaves the batch as it was, and put in
    place by a rename; what a writer left that ended between the renames is put right by the next one. Writers of
    one batch must not overlap. Days are rebalanced by size: a large day is several
    tasks and files, small ones share a task. Each file is sorted by time, and has it as a number too (INDEX), by whose range
    row groups and pages are left out.
    """
    out = rows.drop("dt", "batch_id", INDEX).withColumn(INDEX, micros("ts")).withColumn("dt", F.to_date("ts"))
    _replaced(out.hint("rebalance", "dt").sortWithinPartitions("dt", "ts"), path, batch_id, ["dt"])


def write_rejects(rows: DataFrame, path: str, batch_id: str) -> None:
    """Keep the bad rows of a batch beside the table; writing them again replaces them."""
    _replaced(rows, path, batch_id, [])


def read_table(spark: SparkSession, path: str, schema: str = SCHEMA, indexed: bool = False) -> DataFrame:
    """All batches of a table; ``dt`` and ``batch_id`` are partition columns, and an id stays the text it is.

    With ``indexed`` the time comes as a number too, by which ``BucketQuery`` leaves out row groups.
    """
    return spark.read.schema(f"{schema}, {f'{INDEX} bigint, ' if indexed else ''}batch_id string, dt date").parquet(path)


def in_range(since: str | None, until: str | None, columns: list[str]) -> list[Column]:
    """Filters for [since, until) on the time, and on what a table has beside it: its day and its number.

    Files that were written without the number have nulls there, which stay.
    """
    out = []
    for edge, low in ((since, True), (until, False)):
        if edge is not None:
            at = F.lit(edge).cast("timestamp_ntz")
            out.append(F.col("ts") >= at if low else F.col("ts") < at)
            if "dt" in columns:
                out.append(F.col("dt") >= at.cast("date") if low else F.col("dt") <= at.cast("date"))
            if INDEX in columns:
                number = micros(at)
                out.append(F.col(INDEX).isNull() | (F.col(INDEX) >= number if low else F.col(INDEX) < number))
    return out


def _connection(spark: SparkSession, url: str, properties: dict[str, str]):
    jvm = spark._jvm
    if "driver" in properties:
        jvm.java.lang.Class.forName(properties["driver"])
    known = jvm.java.util.Properties()
    for name, value in properties.items():
        if name != "driver":
            known.setProperty(name, value)
    return jvm.java.sql.DriverManager.getConnection(url, known)


def _has_table(spark: SparkSession, url: str, dbtable: str, properties: dict[str, str]) -> bool:
    """Whether the database knows a table, by its catalog; a failure of the database is an error, not an answer."""
    *schema, name = dbtable.replace('"', "").split(".")
    link = _connection(spark, url, properties)
    try:
        found = link.getMetaData().getTables(None, None, "%", None)
        while found.next():
            same_schema = not schema or str(found.getString("TABLE_SCHEM")).lower() == schema[-1].lower()
            if same_schema and found.getString("TABLE_NAME").lower() == name.lower():
                return True
        return False
    finally:
        link.close()


def write_jdbc(rows: DataFrame, url: str, dbtable: str, batch_id: str, **properties: str) -> None:
    """Write a batch to a database table with a column ``batch_id``; writing it again replaces it.

    Executors fill a table of the batch's own, ``<dbtable>_fresh``; then one transaction on the driver takes the
    batch's old rows out and the new ones in, so readers see either. The table is made if there is none. The
    driver's jar has to be on the class path; writers to one table must not overlap.
    """
    out = rows.drop("batch_id").withColumn("batch_id", F.lit(batch_id))
    fresh = f"{dbtable}_fresh"
    out.write.format("jdbc").options(url=url, dbtable=fresh, **properties).mode("overwrite").save()
    if not _has_table(rows.sparkSession, url, dbtable, properties):
        out.limit(0).write.format("jdbc").options(url=url, dbtable=dbtable, **properties).mode("append").save()
    names = ", ".join(f'"{c}"' for c in out.columns)
    link = _connection(rows.sparkSession, url, properties)
    try:
        link.setAutoCommit(False)
        gone = link.prepareStatement(f'DELETE FROM {dbtable} WHERE CAST("batch_id" AS VARCHAR(4000)) = ?')
        gone.setString(1, batch_id)
        gone.executeUpdate()
        link.createStatement().executeUpdate(f"INSERT INTO {dbtable} ({names}) SELECT {names} FROM {fresh}")
        link.createStatement().executeUpdate(f"DROP TABLE {fresh}")
        link.commit()
    except Exception:
        link.rollback()
        raise
    finally:
        link.close()


def read_jdbc(spark: SparkSession, url: str, dbtable: str, column: str | None = None, bounds: tuple | None = None, parts: int = 16, **properties) -> DataFrame:
    """Scan a database table, in parallel ranges of ``column`` where bounds are given; times without a zone stay without one."""
    reader = spark.read.format("jdbc").options(**({"preferTimestampNTZ": "true"} | properties), url=url, dbtable=dbtable)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def generated(spark: SparkSession, rows: int, start: str = "2024-01-01", seconds: int = 30, seed: int = 7) -> DataFrame:
    """A load of measurements, evenly spaced, the same for the same seed."""
    kinds = F.array(*map(F.lit, ("click", "view", "purchase", "signup", "error")))
    at = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * seconds)
    mix = F.abs(F.xxhash64("id", F.lit(seed)))
    return spark.range(rows).select(
        F.col("id").alias("event_id"), at.alias("ts"), (mix % 150).alias("user_id"), F.element_at(kinds, (mix % 5 + 1).cast("int")).alias("event_type"),
        ((mix % 50_000) / 100).cast("double").alias("value"), F.to_json(F.struct((mix % 100).alias("k"))).alias("props"),
    )
