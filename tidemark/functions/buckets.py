"""Time buckets and exact numbers. Nothing here depends on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimals of an exact number where nothing else is asked for.
SCALE = 2
MONEY = "decimal(18,2)"
TOTAL = "decimal(38,2)"

_EPOCH = "timestamp_ntz '1970-01-01 00:00:00'"


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket(ts: str | Column, width: str, origin: str = "0 seconds") -> Column:
    """Start of the half-open bucket of ``width`` that holds ``ts``; buckets count from 1970 plus ``origin``.

    Days and shorter are told by F.window, which takes no months; use calendar_bucket for those.
    A null ``ts`` has no bucket and its row leaves the result.
    """
    return F.window(ts, width, startTime=origin).start


def calendar_bucket(ts: str | Column, unit: str, zone: str | None = None) -> Column:
    """Start of the minute, hour, day, week, month, quarter or year, as local time of ``zone`` where one is named.

    ``ts`` is a timestamp_ntz in UTC; a null stays a group of its own. Made of dates and intervals, never of
    an instant, so an hour that a session's zone skips stays what it is.
    """
    ts = _column(ts)
    if zone:
        ts = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)
    day = ts.cast("date")
    if unit in ("day", "hour", "minute"):
        start = day.cast("timestamp_ntz")
        if unit != "day":
            start = start + F.make_dt_interval(hours=F.hour(ts), mins=F.minute(ts) if unit == "minute" else F.lit(0))
        return start
    if unit not in ("week", "month", "quarter", "year"):
        raise ValueError(f"no calendar unit: {unit}")
    return F.trunc(day, unit).cast("timestamp_ntz")


def hour_number(ts: str | Column) -> Column:
    """Hours from 1970 to a timestamp_ntz, as a number that neighbouring hours follow by one."""
    ts = _column(ts)
    return F.unix_date(ts.cast("date")).cast("bigint") * 24 + F.hour(ts)


def micros(ts: str | Column) -> Column:
    """Microseconds from 1970 to a timestamp_ntz; the session's zone plays no part."""
    ts = _column(ts)
    return F.unix_date(ts.cast("date")).cast("bigint") * 86_400_000_000 + (
        (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    )


def fits(value: str | Column, scale: int = SCALE) -> Column:
    """Whether a number has at most ``scale`` decimals, so that it is exact as a decimal; null for null."""
    value = _column(value)
    return value.cast(f"decimal({16 + scale},{scale})").cast("double") == value.cast("double")


def exact(value: str | Column, scale: int = SCALE) -> Column:
    """A number that adds up the same in any order. One with more decimals, NaN or an infinity is an error,
    never rounded: reject it on ingest, or ask for more decimals."""
    value = _column(value)
    refused = F.raise_error(F.concat(F.lit(f"more than {scale} decimals: "), value.cast("string")))
    return F.when(value.isNull() | fits(value, scale), value.cast(f"decimal({16 + scale},{scale})")).otherwise(refused)


def exact_sum(value: str | Column, scale: int = SCALE) -> Column:
    return F.sum(exact(value, scale)).cast(f"decimal(38,{scale})")


def exact_mean(value: str | Column, scale: int = SCALE) -> Column:
    """The exact total divided once; null where there is no value."""
    return F.sum(exact(value, scale)).cast("double") / F.nullif(F.count(value), F.lit(0))


def parsed(text: str | Column, pattern: str | None = None) -> Column:
    """A timestamp_ntz of a text; null where it cannot be read."""
    text = _column(text)
    if not pattern:
        return text.try_cast("timestamp_ntz")
    at = F.try_to_timestamp(F.concat(text, F.lit(" +00:00")), F.lit(f"{pattern} XXX"))  # an instant, read as UTC
    return F.expr(_EPOCH) + F.make_dt_interval(secs=(F.unix_micros(at) / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)"))


def json_number(props: str | Column, path: str, kind: str = "bigint") -> Column:
    return F.get_json_object(props, path).cast(kind)
