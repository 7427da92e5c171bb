"""Shift windows: read from what is typed, inferred where it is not, held against an instant.

All windows are minutes of the day; an end that is not later than the start lies on the next day, equal ends mean 24
hours. Everything is a column expression or one aggregate joined back, so no group is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchbill.functions.clock import clock_minute, let
from watchbill.functions.rules import first_rule
from watchbill.functions.timeops import range_active
from watchbill.operators.windows import keep_if_any

# Work hours, and the words by which texts of roles tell day and night shifts, notes and clinical roles.
DAY_START, DAY_END = 450, 990
DAY_WORDS = "\\b(day|duty|coverage|er/consult|inpatient|outpatient|clinic)\\b"
DAY_TIMES = "07:30|16:30"
NIGHT_WORDS = "on-call|oncall|after|night"
ON_CALL_WORDS = "on-call|oncall|on duty|on-duty|senior resident|after|night|24h|weekend"
CLINICAL_WORDS = "\\b(resident|fellow|consultant|consult|associate|assistant|registrar|staff)\\b"


def role_text(*parts: Column) -> Column:
    """Everything that is typed about a role as one lower-case text; missing parts keep their place."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def is_note(role: Column) -> Column:
    return F.contains(role, F.lit("note"))


def is_no_coverage(role: Column, name: Column) -> Column:
    return F.contains(role_text(role, name), F.lit("no coverage"))


def is_day(role: Column) -> Column:
    """Whether a role's text names a day shift by a word or a border of work hours."""
    return role.rlike(DAY_WORDS) | role.rlike(DAY_TIMES)


def is_on_call(role: Column) -> Column:
    return role.rlike(ON_CALL_WORDS)


def is_clinical(role: Column) -> Column:
    return role.rlike(CLINICAL_WORDS)


def _window(start: int, end: int, kind: str) -> Column:
    return F.struct(F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(kind).alias("kind"))


def infer_window(start: Column, end: Column, kind: Column, role: Column, default: Column | None = None) -> Column:
    """(start, end, kind) of a shift, null if nothing tells it.

    Typed clock times decide; their kind is the typed one, else 24h for equal times, day within 07:00 to 17:00, else
    night. Without two times a typed kind gives its usual window, then `default` (a window of the role's lane, may be
    null), then the words of the role's text: 24h, day words without `after`, night words.
    """
    day, night, whole = _window(DAY_START, DAY_END, "day"), _window(DAY_END, DAY_START, "night"), _window(DAY_START, DAY_START, "24h")
    given = F.nullif(F.trim(kind), F.lit(""))

    def read(t: Column) -> Column:
        a, b = t["a"], t["b"]
        told = F.when((a == b) | (given == "24h"), "24h").when((a >= 420) & (b <= 1020) & (b > a), "day").otherwise("night")
        typed = F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("start"), b.alias("end"), F.coalesce(given, told).alias("kind")))
        by_kind = F.when(given == "24h", whole).when(given == "day", day).when(given.isin("night", "on-call"), night)
        words = F.when(F.contains(role, F.lit("24h")), whole).when(role.rlike(DAY_WORDS) & ~F.contains(role, F.lit("after")), day).when(role.rlike(NIGHT_WORDS), night)
        return F.coalesce(typed, by_kind, *([default] if default is not None else []), words)

    return let(F.struct(clock_minute(start).alias("a"), clock_minute(end).alias("b")), read)


def holds(window: Column, minute: Column, weekend: Column) -> Column:
    """Whether a window (start, end, kind) holds at a minute of a day: 24h always, else within its times; null if null."""
    return F.when(window.isNull(), None).when(window["kind"] == "24h", True).otherwise(range_active(minute, window["start"], window["end"]))


def entry_active(window: Column, kind: Column, role: Column, minute: Column, weekend: Column) -> Column:
    """Whether a single row holds: by its typed window, else by kind, else by its words, work hours being 07:30 to 16:30 of
    a day that is no weekend; a row that nothing tells holds never."""
    work = (minute >= DAY_START) & (minute < DAY_END) & ~weekend
    by_words = F.when(is_day(role) & ~F.contains(role, F.lit("after")), work).when(is_on_call(role), ~work)
    by_kind = F.when(kind == "24h", True).when(kind == "day", work).when(kind.isin("night", "on-call"), ~work)
    return F.coalesce(F.when(window.isNotNull(), range_active(minute, window["start"], window["end"])), by_kind, by_words, F.lit(False))


def in_force(df: DataFrame, group: Sequence[str], minute: int, weekend: Column, window: str, role: str, name: str) -> DataFrame:
    """Rows in force at a minute of the day, group by group (nulls in group are groups of their own).

    Notes are left out. Where a group has no-coverage rows only those count; else the rows whose window holds; where
    none holds and every row has a window, none; else by words: in work hours rows of the day, then of 24 hours, then of
    a clinical role, at other times on-call rows, then consultants; each step only where the one before finds none.
    """
    group = list(group)
    r, at = F.col(role), F.lit(minute)
    rows = df.where(~F.coalesce(is_note(r), F.lit(False)))
    no = lambda c: F.coalesce(c, F.lit(False))
    work = (F.lit(DAY_START <= minute < DAY_END)) & ~weekend
    steps = [
        is_no_coverage(r, F.col(name)), holds(F.col(window), at, weekend),
        F.when(work, is_day(r) & ~F.contains(r, F.lit("after"))).otherwise(is_on_call(r)),
        F.when(work, F.contains(r, F.lit("24h"))).otherwise(F.contains(r, F.lit("consultant"))), F.when(work, is_clinical(r)),
    ]
    marked = rows.withColumns({f"_s{i}": no(s) for i, s in enumerate(steps)} | {"_known": F.col(window).isNotNull()})
    flags = marked.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg(
        *[F.max(f"_s{i}").alias(f"_any{i}") for i in range(len(steps))], F.min("_known").alias("_all_known"))
    same = None
    for i, g in enumerate(group):
        one = F.col(g).eqNullSafe(F.col(f"_g{i}"))
        same = one if same is None else same & one
    first = first_rule([(F.col(f"_any{i}"), i) for i in (0, 1)])
    first = F.coalesce(first, F.when(F.col("_all_known"), -1), first_rule([(F.col(f"_any{i}"), i) for i in (2, 3, 4)], -1))
    hit = F.when(first == 0, F.col("_s0"))
    for i in range(1, len(steps)):
        hit = hit.when(first == i, F.col(f"_s{i}"))
    return marked.join(flags, same).where(hit).select(*df.columns)


def calendar_active(df: DataFrame, key: str, minute: Column, weekend: Column, rules: DataFrame) -> DataFrame:
    """df with `active`: whether its key's window (rules: key, weekend, start, end) holds; keys without a rule for the day
    are not active. Equal start and end mean the whole day."""
    known = rules.select(F.col("key").alias(key), F.col("weekend").alias("_weekend"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    out = df.withColumns({"_minute": minute, "_weekend": weekend}).join(known, [key, "_weekend"], "left")
    return out.withColumn("active", F.coalesce(range_active(F.col("_minute"), F.col("_start"), F.col("_end")), F.lit(False))).select(*df.columns, "active")


def upcoming(minute: Column, windows: Sequence[tuple[str, int, int]], ahead: int = 60) -> Column:
    """The windows (name, start, end) of a day that hold at a minute, and those that start within `ahead` minutes, as an
    array of (name, state), current before upcoming."""
    cells = []
    for name, start, end in windows:
        on = range_active(minute, F.lit(start), F.lit(end))
        soon = ~on & (F.pmod(F.lit(start) - minute, F.lit(1440)) <= ahead)
        cells.append(F.when(on, F.struct(F.lit(0).alias("o"), F.lit(name).alias("name"), F.lit("current").alias("state"))).when(
            soon, F.struct(F.lit(1).alias("o"), F.lit(name).alias("name"), F.lit("upcoming").alias("state"))))
    return F.transform(F.array_sort(F.array_compact(F.array(*cells))), lambda w: F.struct(w["name"].alias("name"), w["state"].alias("state")))


def dated_or_undated(df: DataFrame, group: Sequence[str], date: str, wanted: Column) -> DataFrame:
    """Rows of the wanted date; in groups without any, the rows without a date."""
    blank = F.col(date).isNull() | (F.trim(date) == "")
    rows = df.where(blank | (F.col(date) == wanted))
    return keep_if_any(rows, group, F.col(date) == wanted)


def roster_of_day(roster: DataFrame, keys: Sequence[str], day: str, people: Column) -> DataFrame:
    """(keys..., day, pos, person): the people named for each weekday, one row each, the first place of a repeated name.

    Days are compared by their first three letters, whatever the case."""
    named = roster.select(*keys, F.initcap(F.left(F.lower(F.trim(day)), F.lit(3))).alias("day"), F.posexplode(F.array_distinct(people)).alias("_p", "person"))
    return named.select(*keys, "day", (F.col("_p") + 1).alias("pos"), "person")


def slot_start(minute: Column, evening: int = DAY_END, night: int = 1260) -> Column:
    """The start of the slot a minute lies in: 16:30 until 21:00, 21:00 until 07:30, else 07:30."""
    return F.when((minute >= evening) & (minute < night), evening).when((minute >= night) | (minute < DAY_START), night).otherwise(DAY_START)


def ago(now: Column, then: Column) -> Column:
    """How long ago, in words: just now, N min ago, N h ago, N d ago; null stays null, the future is just now."""
    s = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(then.cast("timestamp"))
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f" {unit} ago"))
    return F.when(s.isNull(), None).when(s < 60, "just now").when(s < 3600, part(60, "min")).when(s < 86_400, part(3600, "h")).otherwise(part(86_400, "d"))


def time_label(window: Column, hours: Column, kind: Column) -> Column:
    """What is shown as a shift's time: its window, else the hours typed, else its kind, else nothing."""
    two = lambda m: F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))
    span = F.concat(two(window["start"]), F.lit("-"), two(F.when(window["end"] == 1440, 1440).otherwise(window["end"])))
    return F.coalesce(F.when(window.isNotNull(), span), F.nullif(F.trim(hours), F.lit("")), F.nullif(F.trim(kind), F.lit("")), F.lit(""))
