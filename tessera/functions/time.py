"""Time buckets and intervals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: buckets of days and weeks count from Monday, 2000-01-03, which is so many seconds after the epoch.
ORIGIN_SECONDS = 10_959 * 86_400
UNIT_SECONDS = {"microsecond": 1e-6, "millisecond": 1e-3, "second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}


def interval_parts(text: str) -> tuple[int, float]:
    """(months, seconds) of an interval such as ``1 hour``, ``2 weeks 3 days``, ``1 month`` or ``01:30:00``."""
    months, seconds, rest = 0, 0.0, text.strip().lower()
    if m := re.search(r"(-?)(\d+):(\d{2})(?::(\d{2}(?:\.\d+)?))?\s*$", rest):
        seconds += (-1 if m[1] else 1) * (int(m[2]) * 3600 + int(m[3]) * 60 + float(m[4] or 0))
        rest = rest[: m.start()]
    for n, unit in re.findall(r"(-?\d+(?:\.\d+)?)\s*([a-z]+)", rest):
        unit = {"min": "minute", "mins": "minute", "sec": "second", "secs": "second", "hr": "hour", "hrs": "hour", "mon": "month", "mons": "month", "yr": "year", "yrs": "year"}.get(unit, unit.rstrip("s"))
        if unit in ("month", "year", "quarter", "decade"):
            months += int(float(n) * {"month": 1, "quarter": 3, "year": 12, "decade": 120}[unit])
        elif unit in UNIT_SECONDS:
            seconds += float(n) * UNIT_SECONDS[unit]
        else:
            raise ValueError(f"unknown interval unit in {text!r}")
    return months, seconds


def _column(ts: str | Column) -> Column:
    return F.col(ts) if isinstance(ts, str) else ts


def time_bucket(width: str, ts: str | Column) -> Column:
    """Start of the bucket of ``width`` that holds ``ts``, without a time zone. Months are counted from January 2000."""
    months, seconds = interval_parts(width)
    if months and seconds:
        raise ValueError("a bucket has months or a fixed length, not both")
    at = _column(ts).cast("timestamp_ntz")
    if months == 1:
        return F.date_trunc("MONTH", at)
    if months:
        n = (F.year(at) - 2000) * 12 + F.month(at) - 1
        start = n - F.pmod(n, F.lit(months))
        return F.make_date((F.floor(start / 12) + 2000).cast("int"), (F.pmod(start, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")
    micros = round(seconds * 1_000_000)
    since = F.timestamp_diff("MICROSECOND", _ORIGIN(), at)
    return F.timestamp_add("MICROSECOND", since - F.pmod(since, F.lit(micros)), _ORIGIN())


def _ORIGIN() -> Column:
    return F.expr("TIMESTAMP_NTZ'2000-01-03 00:00:00'")


def bucket_window(width: str, ts: str | Column) -> Column:
    """The same for a fixed width as a tumbling window, the group that keeps a stream's watermark; its ``start`` is the bucket."""
    months, seconds = interval_parts(width)
    if months:
        raise ValueError("a stream's bucket has a fixed length")
    micros = round(seconds * 1_000_000)
    return F.window(ts, f"{micros} microseconds", f"{micros} microseconds", f"{ORIGIN_SECONDS * 1_000_000 % micros} microseconds")


def as_interval(interval: str) -> Column:
    """An interval of months or of a fixed length as a value."""
    months, seconds = interval_parts(interval)
    return F.make_ym_interval(F.lit(0), F.lit(months)) if months else _seconds(seconds)


def plus(ts: Column, interval: str) -> Column:
    months, seconds = interval_parts(interval)
    return ts + F.make_ym_interval(F.lit(0), F.lit(months)) if months else ts + _seconds(seconds)


def _seconds(seconds: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))


def minus(ts: Column, interval: str) -> Column:
    """``ts`` minus an interval, in the type of ``ts``."""
    months, seconds = interval_parts(interval)
    return ts - F.make_ym_interval(F.lit(0), F.lit(months)) if months else ts - _seconds(seconds)
