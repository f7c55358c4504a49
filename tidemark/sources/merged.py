"""One truth over overlapping batches, and rollups that are kept up to date with it.

A batch may bring rows that earlier ones brought, replayed or corrected. ``land`` lets one row of each id stand: the one
with the latest time, then the largest rest, the same in whatever order batches arrive. What it reads of the table is
bounded by what the batch overlaps:

- ids are hashed to buckets. A bucket has a Bloom filter (bitmaps made by SQL's own aggregates) and a folder of an
  index from id to day. Only buckets in which a filter says that an id may be known are read, and of the table only the
  days that they name;
- days from which rows are taken are written anew, all others keep their files and get further ones;
- rollups are kept by day, and only days that have changed are summed again, from their rows.

What a version of the table consists of stands in one small file, its manifest. A landing writes everything else first
and then the manifest, so readers see rows and rollups of one version, a landing that fails leaves the old one, and
the index may name a day that came to nothing, which costs a look and changes nothing. Writers must not overlap: the
second one to write a version is refused.

The driver holds names of days, folders and buckets, no rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.buckets import SCALE, bucket, micros
from ..operators.timeseries import bucketed, coarser, exact_aggregates, seconds_of
from .measurements import INDEX, SCHEMA, in_range

#: Buckets of ids, and bitmaps of a bucket's filter, each of BITS bits; good for a tenth as many ids.
BUCKETS, BITMAPS, BITS = 64, 1, 32_768
#: Bits that an id sets in its bitmap.
MARKS = 4
#: Ids that are sent to every task; more are met in a shuffle, in tasks of about ROWS rows each. Parts are counted by rows, as
#: ids pack so well that parts of so many bytes would hold any number of them.
SENT_IDS, ROWS = 250_000, 500_000
#: Folders of a day beyond which the next landing that touches it writes it anew.
MOST_FOLDERS = 8


@dataclass(frozen=True)
class Rollup:
    """Exact aggregates by bucket and keys that are kept for each day; a bucket has to lie within a day."""

    width: str = "1 hour"
    keys: tuple[str, ...] = ()
    scale: int = SCALE


@dataclass(frozen=True)
class Version:
    """What a table consists of: for each day its folders of rows, and for each rollup its folder of each day."""

    number: int = 0
    buckets: int = BUCKETS
    bitmaps: int = BITMAPS
    days: dict[str, list[str]] = field(default_factory=dict)
    rollups: dict[str, dict[str, str]] = field(default_factory=dict)
    specs: dict[str, list] = field(default_factory=dict)
    filters: str | None = None
    changed: tuple[str, ...] = ()
    batch: str | None = None


@dataclass(frozen=True)
class Landing:
    """What a landing has looked at and changed."""

    version: Version
    hit_buckets: list[int]
    read_days: list[str]
    rewritten: list[str]


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def latest(spark: SparkSession, path: str) -> Version | None:
    """The newest version whose manifest is whole; None where there is no table."""
    for name in sorted((n for n in _names(spark, f"{path}/manifests") if n.endswith(".json")), reverse=True):
        text = "".join(r.value for r in spark.read.text(f"{path}/manifests/{name}").collect())
        try:
            found = json.loads(text)
        except ValueError:  # its writer ended while it wrote
            continue
        return Version(**(found | {"changed": tuple(found["changed"])}))
    return None


def _commit(spark: SparkSession, path: str, version: Version) -> None:
    """Write a manifest; of two writers of a version the second one is refused."""
    fs, at = _fs(spark, f"{path}/manifests/v{version.number:010d}.json")
    try:
        out = fs.create(at, False)
    except Exception as fault:
        raise RuntimeError(f"another writer has made version {version.number} of {path}") from fault
    out.write(bytearray(json.dumps(asdict(version)).encode()))
    out.close()


def create(spark: SparkSession, path: str, rollups: dict[str, Rollup] | None = None, buckets: int = BUCKETS, bitmaps: int = BITMAPS) -> Version:
    """An empty table with the rollups that it will keep."""
    if wrong := [name for name, r in (rollups or {}).items() if 86_400 % seconds_of(r.width)]:
        raise ValueError(f"buckets of a kept rollup have to divide a day: {wrong}")
    specs = {name: [r.width, list(r.keys), r.scale] for name, r in (rollups or {}).items()}
    made = Version(buckets=buckets, bitmaps=bitmaps, specs=specs, rollups={name: {} for name in specs})
    _commit(spark, path, made)
    return made


def _read(spark: SparkSession, schema: str, folders: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def rows(spark: SparkSession, path: str, version: Version | None = None, since: str | None = None, until: str | None = None, schema: str = SCHEMA, only: list[str] | None = None) -> DataFrame:
    """Rows of a version, the latest if none is given; only days from ``since`` up to, not including, ``until`` are listed."""
    version = version or latest(spark, path)
    days = only if only is not None else [d for d in version.days if (since is None or d >= since[:10]) and (until is None or d <= until[:10])]
    out = _read(spark, f"{schema}, {INDEX} bigint", [f"{path}/{folder}" for d in sorted(days) for folder in version.days.get(d, [])])
    for keep in in_range(since, until, out.columns):
        out = out.where(keep)
    return out.drop(INDEX)


def _rollup_schema(spec: list, schema: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema)}
    return ", ".join([*(f"{k} {kinds[k]}" for k in spec[1]), "bucket_start timestamp_ntz", "n bigint", f"total decimal(38,{spec[2]})", "mean double", "lo double", "hi double"])


def rollup(spark: SparkSession, path: str, name: str, version: Version | None = None, schema: str = SCHEMA) -> DataFrame:
    """A kept rollup as it stands in a version; no raw row is read."""
    version = version or latest(spark, path)
    kept = version.rollups[name]
    return _read(spark, _rollup_schema(version.specs[name], schema), [f"{path}/{kept[d]}" for d in sorted(kept)])


def rolled_to(spark: SparkSession, path: str, name: str, start: Column, version: Version | None = None, schema: str = SCHEMA) -> DataFrame:
    """Coarser buckets from a kept rollup, by its keys."""
    version = version or latest(spark, path)
    return coarser(rollup(spark, path, name, version, schema), start, version.specs[name][1])


def _marked(ids: DataFrame, version: Version) -> DataFrame:
    """(event_id, .., bucket, bitmap, marks): an id's bucket, and its bits in one bitmap of the bucket's filter."""
    one, two = F.xxhash64("event_id"), F.xxhash64(F.lit(7), "event_id")
    # bits are taken from one more hash, 15 at a time, so that an id needs one bitmap only
    marks = F.array(*(F.shiftrightunsigned(two, 15 * k).bitwiseAND(BITS - 1).cast("int") for k in range(MARKS)))
    bitmap = F.pmod(F.shiftright(one, 32), F.lit(version.bitmaps)).cast("int")
    return ids.select("*", F.pmod(one, F.lit(version.buckets)).cast("int").alias("bucket"), bitmap.alias("bitmap"), marks.alias("marks"))


def _filter_of(marked: DataFrame) -> DataFrame:
    """(bucket, bitmap, bits): the filters of some ids."""
    each = marked.select("bucket", "bitmap", F.explode("marks").alias("mark"))
    return each.groupBy("bucket", "bitmap").agg(F.bitmap_construct_agg("mark").alias("bits"))


def _is_set(bits: Column, mark: Column) -> Column:
    byte = F.ascii(F.decode(F.substring(bits, F.shiftright(mark, 3) + 1, F.lit(1)), "ISO-8859-1"))
    return F.call_function("shiftright", byte, mark.bitwiseAND(7)).bitwiseAND(1) == 1


def may_be_known(marked: DataFrame, filters: DataFrame) -> DataFrame:
    """Of marked ids those that the filters do not rule out."""
    met = marked.join(filters, ["bucket", "bitmap"])
    return met.where(reduce(and_, (_is_set(F.col("bits"), F.col("marks")[k]) for k in range(MARKS)))).drop("bits")


def _order(columns: list[str]) -> list[Column]:
    return [F.desc_nulls_last("ts"), *(F.desc_nulls_last(c) for c in sorted(columns) if c not in ("event_id", "ts"))]


def _days_of(frame: DataFrame) -> list[str]:
    """Days as text; a table has few of them."""
    return sorted(r.dt for r in frame.select(F.col("dt").cast("string").alias("dt")).distinct().collect())


def _dealt(frame: DataFrame, size: int, on: list[str]) -> DataFrame:
    """A frame in as many parts by some columns as ``size`` rows ask for."""
    return frame.repartition(max(1, -(-size // ROWS)), *on)


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A semi or anti join of written frames; the right side goes to every task if it is small, else both are dealt out."""
    own = right.count()
    if own <= SENT_IDS:
        return left.join(F.broadcast(right), on, how)
    size = own + left.count()
    return _dealt(left, size, on).join(_dealt(right, size, on), on, how)


def land(batch: DataFrame, path: str, batch_id: str | None = None, schema: str = SCHEMA) -> Landing:
    """Bring a batch into the table: afterwards one row of each id stands, whatever came before and in what order.

    Landing a batch again changes nothing. Rows need an id and a time (``measurements.checked`` keeps others apart);
    one without is an error.
    """
    spark = batch.sparkSession
    now = latest(spark, path)
    if now is None:
        raise ValueError(f"there is no table at {path}; create it first")
    columns = StructType.fromDDL(schema).names
    run = uuid.uuid4().hex

    def kept(frame: DataFrame, name: str, *by: str) -> DataFrame:
        at = f"{path}/{name}/{run}"
        (frame.write.partitionBy(*by) if by else frame.write).parquet(at)
        return spark.read.schema(frame.schema).parquet(at)

    def needed(name):
        return F.coalesce(F.col(name), F.raise_error(F.lit(f"a row has no {name}")).cast(batch.schema[name].dataType)).alias(name)

    new = batch.select(*(needed(c) if c in ("event_id", "ts") else F.col(c) for c in columns))
    first = W.partitionBy("event_id").orderBy(*_order(columns))
    new = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    new = kept(new.withColumn("dt", F.to_date("ts")), "_landing")

    hit: list[int] = []
    read_days: list[str] = []
    taken = None
    if now.filters:
        filters = spark.read.schema("bucket int, bitmap int, bits binary").parquet(f"{path}/{now.filters}")
        maybe = kept(may_be_known(_marked(new, now), filters).select(*new.columns, "bucket"), "_maybe")
        hit = sorted(r.bucket for r in maybe.select("bucket").distinct().collect())
    if hit:
        read_days = [d for d in _days_of(_met(known_days(spark, path, hit, schema), maybe.select("event_id"), ["event_id"], "left_semi")) if d in now.days]
    accepted = new
    if read_days:
        before, size = rows(spark, path, now, schema=schema, only=read_days).withColumn("dt", F.to_date("ts")), maybe.count()
        if size <= SENT_IDS:
            before, size = before.join(F.broadcast(maybe.select("event_id")), "event_id", "left_semi"), 2 * size
        else:  # rows of ids that the batch does not bring meet nothing, which costs less than taking them out first
            size += before.count()
        both = before.withColumn("_old", F.lit(True)).unionByName(maybe.drop("bucket").withColumn("_old", F.lit(False)))
        # of equal rows the old one stands, so that a replay changes nothing
        best = W.partitionBy("event_id").orderBy(*_order(columns), F.desc("_old"))
        contest = _dealt(both, size, ["event_id"]).withColumn("_n", F.row_number().over(best))
        lost = kept(contest.where("_n > 1").select("event_id", "dt", "_old"), "_contest")
        accepted = _met(new, lost.where("not _old").select("event_id"), ["event_id"], "left_anti")
        taken = lost.where("_old").select("event_id", "dt")

    def written(frame: DataFrame, kind: str) -> dict[str, str]:
        """Rows by day, each day in files sorted by time and rebalanced by size; the folder of each day."""
        frame = frame.withColumn(INDEX, micros("ts"))
        frame.hint("rebalance", "dt").sortWithinPartitions("dt", "ts").write.partitionBy("dt").parquet(f"{path}/rows/{run}-{kind}")
        return {n.removeprefix("dt="): f"rows/{run}-{kind}/{n}" for n in _names(spark, f"{path}/rows/{run}-{kind}") if n.startswith("dt=")}

    new_days = written(accepted, "new")
    come = sorted(new_days)
    crowded = [d for d in come if len(now.days.get(d, [])) >= MOST_FOLDERS]
    rewritten = sorted({*(_days_of(taken) if taken is not None else []), *crowded})
    days = {d: list(f) for d, f in now.days.items()}

    if rewritten:
        stay = rows(spark, path, now, schema=schema, only=rewritten).withColumn("dt", F.to_date("ts"))
        if taken is not None:
            stay = _met(stay, taken, ["event_id", "dt"], "left_anti")
        fresh = written(stay, "kept")
        for d in rewritten:
            days[d] = [fresh[d]] if d in fresh else []
    for d, folder in new_days.items():
        days.setdefault(d, []).append(folder)
    days = {d: f for d, f in days.items() if f}
    changed = sorted({*come, *rewritten})

    filters = now.filters
    if come:
        kind = accepted.schema["event_id"].dataType.simpleString()
        arrived = _marked(spark.read.schema(f"event_id {kind}, dt date").parquet(f"{path}/rows/{run}-new"), now)
        arrived.select("bucket", "event_id", "dt").hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/index")
        own = _filter_of(arrived)
        if filters:
            own = spark.read.schema("bucket int, bitmap int, bits binary").parquet(f"{path}/{filters}").unionByName(own)
            own = own.groupBy("bucket", "bitmap").agg(F.bitmap_or_agg("bits").alias("bits"))
        kept(own, "filters")
        filters = f"filters/{run}"

    version = replace(now, number=_next(spark, path), days=days, filters=filters, changed=tuple(changed), batch=batch_id)
    version = replace(version, rollups={name: _recomputed(spark, path, version, name, changed, run, schema) for name in now.specs})
    _commit(spark, path, version)
    for scratch in ("_landing", "_maybe", "_contest"):
        fs, at = _fs(spark, f"{path}/{scratch}/{run}")
        fs.delete(at, True)
    return Landing(version, hit, read_days, rewritten)


def known_days(spark: SparkSession, path: str, buckets: list[int], schema: str = SCHEMA) -> DataFrame:
    """(event_id, dt) of the index in some buckets; folders of others are not listed."""
    kind = StructType.fromDDL(schema)["event_id"].dataType.simpleString()
    return spark.read.schema(f"event_id {kind}, dt date, bucket int").parquet(f"{path}/index").where(F.col("bucket").isin(*buckets)).select("event_id", "dt")


def _next(spark: SparkSession, path: str) -> int:
    """The number after all that a manifest was begun for."""
    return 1 + max(int(n[1:11]) for n in _names(spark, f"{path}/manifests") if n.endswith(".json"))


def _recomputed(spark: SparkSession, path: str, version: Version, name: str, changed: list[str], run: str, schema: str) -> dict[str, str]:
    """The folders of a rollup, with days that have changed summed again from their own rows."""
    width, keys, scale = version.specs[name]
    out = {d: f for d, f in version.rollups[name].items() if d not in changed}
    alive = [d for d in changed if d in version.days]
    if alive:
        made = bucketed(rows(spark, path, version, schema=schema, only=alive), bucket("ts", width), keys, exact_aggregates(scale=scale))
        made = made.withColumn("dt", F.to_date("bucket_start"))
        made.hint("rebalance", "dt").write.partitionBy("dt").parquet(f"{path}/rollups/{name}/{run}")
        out |= {d: f"rollups/{name}/{run}/dt={d}" for d in alive}
    return out


def cleared(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete what none of the last ``keep`` versions consists of; must not run beside a writer."""
    manifests = sorted(n for n in _names(spark, f"{path}/manifests") if n.endswith(".json"))
    used = set()
    for name in manifests[-keep:]:
        try:
            v = json.loads("".join(r.value for r in spark.read.text(f"{path}/manifests/{name}").collect()))
        except ValueError:
            continue
        used |= {"/".join(f.split("/")[:2]) for folders in v["days"].values() for f in folders} | {v["filters"]}
        used |= {"/".join(f.split("/")[:3]) for days in v["rollups"].values() for f in days.values()}
    found = [f"{top}/{n}" for top in ("rows", "filters", "_landing", "_maybe", "_contest", *(f"rollups/{r}" for r in _names(spark, f"{path}/rollups"))) for n in _names(spark, f"{path}/{top}")]
    gone = sorted({*found} - used) + [f"manifests/{n}" for n in manifests[:-keep]]
    for name in gone:
        fs, at = _fs(spark, f"{path}/{name}")
        fs.delete(at, True)
    return gone
