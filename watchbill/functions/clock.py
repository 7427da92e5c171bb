"""Clock times, business days and shift windows as column expressions over minutes of the day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
_PART = "\ue0f4"  # put between the parts of a clock time
_CLOCK = "^([0-9]{1,2})(?:[:.h]([0-9]{2})(?::([0-9]{2}))?|([0-9]{2}))? ?([ap])?\\.?(m)?\\.?$"


def clock_minute(text: Column) -> Column:
    """Minute of the day of a typed clock time, null if it is none.

    Reads 07:30, 7:30, 0730, 07.30, 07h30, 07:30:00, 7:30 PM, 7:30pm, 7pm and Arabic digits; 24:00 is 1440. Hours over
    24, minutes over 59, 13:00 PM and words are no clock times; a number alone (730 apart from four digits, 7) is none.
    """
    return let(text, _read)


def _read(text: Column) -> Column:
    usual = F.translate(text, "123456789", "000000000") == "00:00"
    hour, minute = F.substring(text, 1, 2).try_cast("int"), F.substring(text, 4, 2).try_cast("int")
    t = F.regexp_replace(F.lower(F.trim(F.translate(text, _ARABIC_DIGITS, "01234567890123456789"))), "\\s+", " ")
    parts = F.split(F.regexp_replace(t, _CLOCK, f"{_PART}$1{_PART}$2{_PART}$3{_PART}$4{_PART}$5{_PART}$6"), _PART)
    return F.when(usual & (hour <= 23) & (minute <= 59), hour * 60 + minute).otherwise(let(parts, _minute))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _minute(part: Column) -> Column:
    colon, second, packed, half, m = part[2], part[3], part[4], part[5], part[6]
    hour = part[1].try_cast("int")
    minute = F.when(colon != "", colon).when(packed != "", packed).otherwise("0").try_cast("int")
    known = (colon != "") | ((packed != "") & (F.length(part[1]) == 2)) | (half != "")
    known &= ((half == "") == (m == "")) & (minute <= 59) & (F.coalesce(second.try_cast("int"), F.lit(0)) <= 59)
    twelve = F.when(hour.between(1, 12), (hour % 12) * 60 + minute + F.when(half == "p", 720).otherwise(0))
    plain = F.when((hour <= 23) | ((hour == 24) & (minute == 0)), hour * 60 + minute)
    # text that is no clock time is one part
    return F.when((F.size(part) == 7) & known, F.when(half != "", twelve).otherwise(plain))


def day_minute(day: Column) -> Column:
    """Minutes from 1970-01-01 to the start of a date."""
    return F.unix_date(day).cast("bigint") * 1440


def shift_span(day: Column, start: Column, end: Column) -> Column:
    """Start and end minute of a shift as struct (a, b), null where a time is none; an end that is not later than the
    start lies on the next day (equal: 24 hours)."""
    both = F.struct(clock_minute(start).alias("a"), clock_minute(end).alias("b"))
    later = lambda g: F.when(g["b"] > g["a"], g["b"]).otherwise(g["b"] + 1440)
    return let(both, lambda g: F.struct((day_minute(day) + g["a"]).alias("a"), (day_minute(day) + later(g)).alias("b")))


def shift_bounds(day: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The same as two columns."""
    span = shift_span(day, start, end)
    return span["a"], span["b"]


def minute_text(minute: Column) -> Column:
    """A minute since 1970-01-01 as YYYY-MM-DD HH:MM, in no time zone."""
    day = F.date_from_unix_date(F.floor(minute / 1440).cast("int"))
    rest = F.pmod(minute, F.lit(1440))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), two(rest / 60), F.lit(":"), two(rest % 60))
