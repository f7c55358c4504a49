"""Merkle fixity audit of WARC replicas.

A table of pages is laid out as WARC/1.1 response records, in order of page_id, over volumes of a set
number of records. Each record has an offset and a length in its volume. The reference writes a manifest: the ids at
which its ranges of ``LEAF`` records begin. By the manifest, and by nothing else of the reference, each replica builds its
trees alone: a leaf hashes the ordered records of a range, a node the digests of ``FANOUT`` children in order, up to the root
of a volume. So a lost, added or lengthened record changes the range that it lies in and shifts no other.

An audit joins the roots. Where they differ, the children of differing nodes alone are compared, level by level down
to the ranges; each level of a tree is a folder of its own, so no other level is read for it. Records are compared
within differing ranges only, by id and repeat number. Where all roots agree nothing else is read.

Everything is DataFrame work: a node gathers at most FANOUT digests, a range hashes its records in runs of RUN, and
positions and ranges come from range partitions and what each of them hands on, so nothing is sorted in one task.

Defined results: null url or html are empty; repeated page_ids are ordered by record digest; null page_ids
come first; an empty table has no volumes and audits clean; a record that the other replica lacks is
located at its place in the reference, one that it has in addition at its place in the other replica. Repeats
of an id are paired in order of digest, so damage to one of them may show at others of the same id. Extra
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts, saved

FANOUT = 16
#: Records of a volume and of a range, which is a leaf: 256 leaves, 16 nodes above them, a root.
VOLUME_RECORDS, LEAF = 4096, 16
#: Records of a range that are hashed at once; a range has more if an id is repeated as often.
RUN = 4096
#: Records of a range partition.
PART_ROWS = 200_000
_CRLF = "\r\n"


def record_bytes(url: Column, html: Column) -> Column:
    """One WARC response record, without the headers that differ from copy to copy."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: response{_CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"{_CRLF}Content-Type: text/html{_CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(_CRLF * 2),
    ).cast("binary")
    return F.concat(head, body, F.lit(_CRLF * 2).cast("binary"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", volume_records: int = VOLUME_RECORDS) -> DataFrame:
    """(record_id, volume, slot, offset, length, digest): the layout of a replica, one row a record.

    ``slot`` is the record's place in its volume and ``offset`` its first byte there.
    """
    whole = record_bytes(F.col(url_col), F.col(html_col))
    rows = pages.select(F.col(id_col).alias("record_id"), F.octet_length(whole).cast("long").alias("length"), F.sha2(whole, 256).alias("digest"))
    rows = saved(rows)  # the texts are read once; what follows handles a hundred bytes a record
    ordered = rows.repartitionByRange(parts(rows.count(), PART_ROWS), "record_id", "digest").sortWithinPartitions("record_id", "digest")
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the row's place in its partition
    ordered = saved(ordered.select("*", F.spark_partition_id().alias("part"), inside.alias("_n")))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = ordered.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    placed = ordered.join(F.broadcast(first), "part")  # a row for each 200,000 records
    placed = placed.withColumn("_row", F.col("first") + F.col("_n"))
    placed = placed.withColumn("volume", F.floor(F.col("_row") / volume_records)).withColumn("slot", (F.col("_row") % volume_records).cast("int"))
    run = W.partitionBy("volume").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return placed.select(
        "record_id", "volume", "slot", F.coalesce(F.sum("length").over(run), F.lit(0)).alias("offset"), "length", "digest"
    )


def manifest(layout: DataFrame, leaf: int = LEAF, volume_records: int = VOLUME_RECORDS) -> DataFrame:
    """(range, first_id): where the ranges of a layout begin; all that another replica has to know of it."""
    first = layout.where(F.col("slot") % leaf == 0)
    return first.select((F.col("volume") * (volume_records // leaf) + F.floor(F.col("slot") / leaf)).cast("long").alias("range"), F.col("record_id").alias("first_id"))


def ranged(layout: DataFrame, bounds: DataFrame) -> DataFrame:
    """A layout with the range of each record: the last one that begins at its id or before, or else the first.

    Bounds and records are put in order together; a partition hands on the last bound that it has seen.
    """
    marks = bounds.select(F.col("first_id").alias("record_id"), "range", *(F.lit(None).cast(layout.schema[c].dataType).alias(c) for c in layout.columns if c != "record_id"))
    both = layout.withColumn("range", F.lit(None).cast("long")).unionByName(marks)
    order = ["record_id", F.col("range").isNull(), "digest", "slot"]  # a bound comes before the records of its id
    cut = both.repartitionByRange(parts(layout.count(), PART_ROWS), *order).sortWithinPartitions(*order)
    cut = saved(cut.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_n")))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    handed = cut.groupBy("_part").agg(F.max("range").alias("_last")).select("_part", F.max("_last").over(before).alias("_handed"))  # a row a partition
    here = W.partitionBy("_part").orderBy("_n").rowsBetween(W.unboundedPreceding, 0)  # bounds ascend, so the largest so far is the last
    filled = cut.withColumn("_seen", F.max("range").over(here)).where("digest is not null").join(F.broadcast(handed), "_part")
    return filled.select(*layout.columns, F.coalesce("_seen", "_handed", F.lit(0)).cast("long").alias("range"))


def tree(records_: DataFrame, fanout: int = FANOUT, leaves: int = VOLUME_RECORDS // LEAF) -> DataFrame:
    """(volume, level, node, digest) of records with their ranges: level 0 are ranges, the highest level of a volume is its root.

    A leaf hashes ids, lengths and digests, not offsets, which any longer record before them moves.
    """
    in_order = W.partitionBy("range").orderBy("record_id", "digest", "length")
    runs = records_.withColumn("_run", F.floor((F.row_number().over(in_order) - 1) / RUN))
    line = F.concat_ws(":", F.coalesce(F.col("record_id").cast("string"), F.lit("-")), F.col("length").cast("string"), "digest")
    ordered = F.sort_array(F.collect_list(F.struct("record_id", "digest", "length", line.alias("line"))))
    hashed = runs.groupBy("range", "_run").agg(F.sha2(F.array_join(F.transform(ordered, lambda r: r.line), ","), 256).alias("digest"))
    whole = hashed.groupBy("range").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_run", "digest"))), lambda r: r.digest), ","), 256).alias("digest"))
    level = whole.select(F.floor(F.col("range") / leaves).alias("volume"), F.lit(0).alias("level"), (F.col("range") % leaves).cast("int").alias("node"), "digest")
    levels, size, k = [level], leaves, 0
    while size > 1:
        size, k = -(-size // fanout), k + 1
        children = F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda c: F.concat_ws(":", c.node.cast("string"), c.digest))
        level = level.groupBy("volume", F.floor(F.col("node") / fanout).cast("int").alias("up")).agg(
            F.sha2(F.concat_ws(",", children), 256).alias("digest")
        ).select("volume", F.lit(k).alias("level"), F.col("up").alias("node"), "digest")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def depth(fanout: int = FANOUT, leaves: int = VOLUME_RECORDS // LEAF) -> int:
    k = 0
    while leaves > 1:
        leaves, k = -(-leaves // fanout), k + 1
    return k


def differing(one: DataFrame, other: DataFrame, fanout: int = FANOUT) -> DataFrame | None:
    """(volume, node) of the leaves that differ, found from the roots down; None where all roots agree.

    A level is joined only with the children of the nodes above that differ.
    """
    top = depth(fanout)

    def unequal(level, within=None):
        a, b = (t.where(F.col("level") == level).select("volume", "node", "digest") for t in (one, other))
        if within is not None:
            up = [F.col("volume"), F.floor(F.col("node") / fanout).cast("int").alias("_up"), F.col("node"), F.col("digest")]
            a, b = (t.select(*up).join(within.withColumnRenamed("node", "_up"), ["volume", "_up"], "left_semi").drop("_up") for t in (a, b))
        both = a.join(b.withColumnRenamed("digest", "_other"), ["volume", "node"], "full")
        return both.where(~F.col("digest").eqNullSafe(F.col("_other"))).select("volume", "node")

    bad = saved(unequal(top))
    if bad.isEmpty():
        return None
    for level in range(top - 1, -1, -1):
        bad = saved(unequal(level, bad))
    return bad


def audit(one: DataFrame, other: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Located differences of two layouts: (volume, slot, record_id, offset, length, digest, and the other's).

    ``one`` is the reference, by whose manifest both build their trees.
    """
    one, other = saved(one), saved(other)
    bounds = saved(manifest(one))
    mine, theirs = saved(ranged(one, bounds)), saved(ranged(other, bounds))
    bad = differing(saved(tree(mine, fanout), by="level"), saved(tree(theirs, fanout), by="level"), fanout)
    names = ["record_id", "offset", "length", "digest"]
    if bad is None:
        bad = one.sparkSession.createDataFrame([], "volume long, node int")
    ranges = bad.select((F.col("volume") * (VOLUME_RECORDS // LEAF) + F.col("node")).alias("range"))

    def within(records_):
        """Records of differing ranges, numbered among those of their id."""
        repeat = F.row_number().over(W.partitionBy("range", "record_id").orderBy("digest", "slot"))
        return records_.join(ranges, "range", "left_semi").withColumn("repeat", repeat)

    a = within(mine).select("range", "repeat", "volume", "slot", *names)
    b = within(theirs).select(*(F.col(n).alias(f"other_{n}") for n in ("range", "repeat", "volume", "slot", *names)))
    same = (F.col("range") == F.col("other_range")) & F.col("record_id").eqNullSafe(F.col("other_record_id")) & (F.col("repeat") == F.col("other_repeat"))
    found = a.join(b, same, "full").where(~F.col("digest").eqNullSafe(F.col("other_digest")))
    kind = F.when(F.col("other_digest").isNull(), "missing").when(F.col("digest").isNull(), "added").otherwise("changed")
    return found.select(
        F.coalesce("volume", "other_volume").alias("volume"), F.coalesce("slot", "other_slot").alias("slot"), *names, *(f"other_{n}" for n in names), kind.alias("kind")
    )
