"""Business days, work hours and shift windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def schedule_date(ts: Column, cut_minutes: int = 450) -> Column:
    """The business day of an instant: before the cut (07:30) it belongs to the day before."""
    return F.to_date(ts - F.expr(f"INTERVAL '{cut_minutes}' MINUTE"))


def is_weekend(day: Column) -> Column:
    """Friday or Saturday."""
    return F.dayofweek(day).isin(6, 7)


def range_active(minute: Column, start: Column, end: Column) -> Column:
    """Whether a minute lies in [start, end), which may run over midnight; equal ends mean the whole day."""
    return F.when(end > start, (minute >= start) & (minute < end)).otherwise((minute >= start) | (minute < end))


def is_work_hours(ts: Column, start: int = 450, end: int = 990) -> Column:
    """07:30 to 16:30, the end not included."""
    return (minute_of_day(ts) >= start) & (minute_of_day(ts) < end)


def window_active(ts: Column, start: Column, end: Column, kind: Column, days: Column | None = None) -> Column:
    """Whether a shift window holds at an instant: its days, then kind 24h, then its times, else work hours by kind."""
    times = start.isNotNull() & end.isNotNull()
    on_work = is_work_hours(ts) & ~is_weekend(F.to_date(ts))
    by_kind = F.when(kind == "24h", True).when(times, range_active(minute_of_day(ts), start, end)).when(kind == "day", on_work).when(kind.isin("night", "on-call"), ~on_work)
    return by_kind if days is None else F.when(F.size(days) > 0, F.array_contains(days, F.dayofweek(ts) - 1) & by_kind).otherwise(by_kind)


def range_start(name: str, now: Column) -> Column:
    """Start of a named range of statistics before now: today, 24h, 7d (also any other name), 30d, all."""
    days = {"24h": 1, "30d": 30}.get(name, 7)
    if name == "today":
        return F.date_trunc("day", now)
    if name == "all":
        return F.lit("2020-01-01").cast("timestamp_ntz")
    return now - F.expr(f"INTERVAL '{days}' DAY")


def month_day(key: Column) -> Column:
    """Sort value of a DD/MM key: month * 100 + day; null if it is none."""
    day, month = F.regexp_extract(key, "^(\\d{1,2})/(\\d{1,2})$", 1), F.regexp_extract(key, "^(\\d{1,2})/(\\d{1,2})$", 2)
    return month.try_cast("int") * 100 + day.try_cast("int")


def half_up(x: Column) -> Column:
    """Rounding with halves upwards, also below zero."""
    return F.floor(x + 0.5)
