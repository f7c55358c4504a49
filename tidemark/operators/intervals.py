"""Joins of intervals that overlap, by a grid of several widths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import micros

#: Each width of the grid is so many times the one before.
STEP = 8
#: Microseconds of the narrowest cells.
NARROWEST = 1_000_000


def _level(length: Column, levels: int) -> Column:
    """The narrowest grid whose cells are at least as wide as the interval, so that it lies in two of them at most."""
    out = F.lit(levels - 1)
    for k in range(levels - 2, -1, -1):
        out = F.when(length <= NARROWEST * STEP**k, k).otherwise(out)
    return out.cast("int")


def _levels() -> int:
    k, width = 1, NARROWEST
    while width < 1 << 60:
        k, width = k + 1, width * STEP
    return k


LEVELS = _levels()


def _widths(level: Column) -> Column:
    return F.element_at(F.array(*(F.lit(min(NARROWEST * STEP**k, 1 << 62)).cast("bigint") for k in range(LEVELS))), level + 1)


def overlapping(left: DataFrame, right: DataFrame, start: str, end: str, on: Sequence[str] = (), prefix: str = "r_") -> DataFrame:
    """Pairs of rows whose half-open intervals [start, end) share a moment and whose ``on`` columns are equal; the right
    row's columns get ``prefix``.

    An interval belongs to the narrowest grid whose cells are as wide as it is long: one or two cells. It is sent to these
    and to the cells, two at most, of each wider grid that the other side uses, where it meets the intervals that belong
    there. So rows multiply with the number of widths in use (a factor of 8 apart), never with lengths, and no cell gathers
    all because one interval is long. A pair meets on the grid of the longer of the two, and counts in the cell in which
    the later of them starts, so it comes once.

    An interval without length, with an end before its start or with a null holds no moment; null keys match nothing.
    ``start`` and ``end`` are columns of timestamp_ntz or of whole numbers on both sides.
    """
    results = [f"{prefix}{c}" for c in right.columns]
    if clash := sorted(set(results) & set(left.columns)):
        raise ValueError(f"left side has {clash} already")
    names = [f"_k{i}" for i in range(len(on))]

    def ready(rows, side):
        def number(c):
            return micros(c) if rows.schema[c].dataType.simpleString() == "timestamp_ntz" else F.col(c).cast("bigint")

        based = rows.select(*(F.col(k).alias(n) for k, n in zip(on, names)), number(start).alias("_s"), number(end).alias("_e"), F.struct(*rows.columns).alias(side))
        return based.where("_s < _e").withColumn("_own", _level(F.col("_e") - F.col("_s"), LEVELS))

    def used(rows):
        """The grids that a side uses: LEVELS numbers at most, an aggregate of its own."""
        return sorted(rows.agg(F.collect_set("_own")).first()[0])

    def cells(rows, levels, cell="_cell"):
        """Rows at each of some grids as wide as their own or wider, in each cell there."""
        at = rows.withColumn("_level", F.explode(F.filter(levels, lambda k: k >= F.col("_own")))).withColumn("_w", _widths(F.col("_level")))
        # the last moment is before the end, so an interval up to a border stays out of the cell behind it
        return at.withColumn(cell, F.explode(F.sequence(F.floor(F.col("_s") / F.col("_w")), F.floor((F.col("_e") - 1) / F.col("_w")))))

    one, two = ready(left, "l"), ready(right, "r")
    grids = [F.array(*(F.lit(k) for k in used(side))).cast("array<int>") for side in (two, one)]
    keep, other = [*names, "_level", "_cell"], ["_s", "_e"]

    def met(probe, probe_grids, fixed, strict):
        """Probes at the grids of the other side meet what belongs there."""
        asked = cells(probe, probe_grids)
        asked = asked.where("_level > _own") if strict else asked
        there = cells(fixed, F.array("_own")).select(*keep, *(F.col(c).alias(f"{c}2") for c in other), "r" if "r" in fixed.columns else "l")
        both = asked.join(there, keep)
        first = F.floor(F.greatest("_s", "_s2") / F.col("_w")) == F.col("_cell")
        return both.where((F.col("_s") < F.col("_e2")) & (F.col("_s2") < F.col("_e")) & first).select("l", "r")

    pairs = met(one, grids[0], two, False).unionByName(met(two, grids[1], one, True))
    return pairs.select("l.*", *(F.col(f"r.`{c}`").alias(n) for c, n in zip(right.columns, results)))
