"""Time functions (T1–T9).  All are built-in expressions (no UDFs).

Two different "day" notions exist and must not be mixed:

* calendar distance ``c = datediff(end, to_date(time))`` — used to select
  day windows: ``time >= end - i days``  <=>  ``c <= i`` for a midnight end;
* elapsed days ``b = timestampdiff(DAY, time, end)`` — floor of the elapsed
  time in whole days, used for recency, decay and active-day counts.

An event at 00:00:01 the day before ``end`` has c = 1 but b = 0.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_datetime(x) -> _dt.datetime:
    if isinstance(x, _dt.datetime):
        return x
    if isinstance(x, _dt.date):
        return _dt.datetime(x.year, x.month, x.day)
    s = str(x)
    return _dt.datetime.fromisoformat(s if len(s) > 10 else s + " 00:00:00")


def ts_lit(x) -> Column:
    """Time-zone-free timestamp literal (TIMESTAMP_NTZ)."""
    return F.lit(as_datetime(x).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def date_lit(x) -> Column:
    return F.lit(as_datetime(x).strftime("%Y-%m-%d")).cast("date")


def window_start(end, days: int = 0, hours: int = 0) -> _dt.datetime:
    """T5: ``end - n days / hours`` — constant-folded on the driver."""
    return as_datetime(end) - _dt.timedelta(days=days, hours=hours)


def calendar_day(col="time") -> Column:
    """The date part of a timestamp."""
    return F.to_date(F.col(col) if isinstance(col, str) else col)


def hour_of_day(col="time") -> Column:
    """Hour 0..23."""
    return F.hour(F.col(col) if isinstance(col, str) else col)


def calendar_distance(end, col="time") -> Column:
    """Calendar days between the event's date and ``end``'s date."""
    c = F.col(col) if isinstance(col, str) else col
    return F.datediff(date_lit(end), F.to_date(c))


def elapsed_days(end, col="time") -> Column:
    """Whole elapsed days (floor), as ``timedelta.days``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_diff("DAY", c, ts_lit(end))


def elapsed_hours(end, col="time") -> Column:
    """T4: whole elapsed hours (days*24 + seconds//3600)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_diff("HOUR", c, ts_lit(end))


def parse_reg_date(col="user_reg_tm") -> Column:
    """Registration date in either 'yyyy/M/d' or 'yyyy-MM-dd' text (or a date)."""
    c = F.col(col) if isinstance(col, str) else col
    s = c.cast("string")
    return F.to_date(F.coalesce(F.try_to_timestamp(s, F.lit("yyyy/M/d")),
                                F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))))


def days_registered(end, col="user_reg_tm") -> Column:
    """Days from registration to ``end``; registrations after end give -1."""
    d = F.datediff(date_lit(end), parse_reg_date(col))
    return F.when(d < 0, F.lit(-1)).otherwise(d).cast("long")


def exp_decay(col="b") -> Column:
    """exp(-elapsed days)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.exp(-c.cast("double"))


def interval_bucket(col) -> Column:
    """floor((x + 1) / 5) — floor, not truncation, for negative x."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor((c + 1) / F.lit(5.0)).cast("long")


def cast_int(col) -> Column:
    """T10."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("long")
