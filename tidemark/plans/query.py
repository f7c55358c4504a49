"""A bucket query as a declaration, and the pruned plan it stands for."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import SCALE, bucket, calendar_bucket
from ..operators.timeseries import bucketed, exact_aggregates
from ..sources.measurements import in_range


@dataclass(frozen=True)
class BucketQuery:
    """Exact aggregates of [since, until) in buckets, for some series, by some keys.

    The range goes on the raw time column, on ``dt`` too where the table is partitioned by day, and on the time as a number
    where the table has it, by which Parquet leaves out row groups and pages; a filter on the bucket itself would reach none.
    """

    width: str = "1 hour"
    origin: str = "0 seconds"
    unit: str | None = None
    zone: str | None = None
    since: str | None = None
    until: str | None = None
    keys: tuple[str, ...] = ()
    only: tuple[tuple[str, tuple], ...] = ()
    scale: int = SCALE
    ordered: bool = False

    def between(self, since: str | None, until: str | None) -> BucketQuery:
        return replace(self, since=since, until=until)

    def by(self, *keys: str) -> BucketQuery:
        return replace(self, keys=keys)

    def where(self, column: str, *values) -> BucketQuery:
        """Rows whose column has one of the values; None stands for null."""
        if not values:
            raise ValueError("no value to look for")
        return replace(self, only=(*self.only, (column, values)))

    def decimals(self, scale: int) -> BucketQuery:
        """Sums keep so many decimals; a value with more is an error."""
        return replace(self, scale=scale)

    def in_order(self) -> BucketQuery:
        """The result is sorted by bucket, then keys: a range shuffle of the few aggregated rows."""
        return replace(self, ordered=True)

    def filters(self, columns: list[str]) -> list[Column]:
        return in_range(self.since, self.until, columns) + [self._one_of(F.col(c), v) for c, v in self.only]

    @staticmethod
    def _one_of(column: Column, values: tuple) -> Column:
        known = [v for v in values if v is not None]
        found = column.isin(*known) if len(known) > 1 else column == known[0] if known else F.lit(False)
        return found | column.isNull() if len(known) < len(values) else found

    def selected(self, rows: DataFrame) -> DataFrame:
        for f in self.filters(rows.columns):
            rows = rows.where(f)
        return rows

    def run(self, rows: DataFrame) -> DataFrame:
        start = calendar_bucket("ts", self.unit, self.zone) if self.unit else bucket("ts", self.width, self.origin)
        out = bucketed(self.selected(rows), start, self.keys, exact_aggregates(scale=self.scale))
        return out.orderBy("bucket_start", *self.keys) if self.ordered else out
