"""Typed rows out of words, cells and lines of documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchbill.operators.windows import best_by


_MARK = "\ue0f1"  # put around what a text is split at; removed from the text first


def lines_of_words(words: DataFrame, page: Sequence[str], near: float = 2.0, wide: float = 1.8, far: float = 100.0) -> DataFrame:
    """(page..., line, text) of positioned words (ord, text, x, y, width).

    A word starts a line if its y is more than `near` from the word before; in a line words go by x, joined by one
    blank, by two over a gap of `wide` mean letter widths, and by a line end over a gap of more than `far`.
    """
    page = list(page)
    seq = Window.partitionBy(*page).orderBy("ord")
    jump = F.coalesce((F.abs(F.col("y") - F.lag("y").over(seq)) > near).cast("int"), F.lit(1))
    numbered = words.withColumn("_new", jump).withColumn("line", F.sum("_new").over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    lines = numbered.groupBy(*page, "line").agg(
        F.array_sort(F.collect_list(F.struct("x", "ord", "text", "width"))).alias("w"), (F.sum("width") / F.sum(F.greatest(F.length("text"), F.lit(1)))).alias("letter"))
    start = F.struct(F.lit(None).cast("double").alias("end"), F.lit("").alias("text"))

    def add(acc: Column, w: Column) -> Column:
        gap = w["x"] - acc["end"]
        glue = F.when(acc["end"].isNull(), "").when(gap > far, "\n").when(gap > wide * F.col("letter"), "  ").otherwise(" ")
        return F.struct((w["x"] + w["width"]).alias("end"), F.concat(acc["text"], glue, w["text"]).alias("text"))

    return lines.select(*page, "line", F.aggregate("w", start, add)["text"].alias("text"))


def column_bounds(headers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., col, low, high) of columns from header positions (col, x): the upper median of each column's x, with
    borders half way between neighbours, the outer ones open."""
    keys = list(keys)
    middle = headers.groupBy(*keys, "col").agg(F.sort_array(F.collect_list("x")).alias("_x"))
    middle = middle.withColumn("x", F.element_at("_x", (F.floor(F.size("_x") / 2) + 1).cast("int"))).drop("_x")
    w = Window.partitionBy(*keys).orderBy("x")
    return middle.select(*keys, "col", ((F.lag("x").over(w) + F.col("x")) / 2).alias("low"), ((F.lead("x").over(w) + F.col("x")) / 2).alias("high"))


def words_to_columns(words: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """words with the column whose [low, high) holds their x; bounds are a few per key, so the join on keys is narrow."""
    inside = (F.col("low").isNull() | (F.col("x") >= F.col("low"))) & (F.col("high").isNull() | (F.col("x") < F.col("high")))
    return words.join(bounds, list(keys)).where(inside).drop("low", "high")


def largest_table(cells: DataFrame, page: Sequence[str]) -> DataFrame:
    """Cells (table, row, ...) of the table with most rows of each page, the first on ties."""
    counts = cells.groupBy(*page, "table").agg(F.countDistinct("row").alias("_rows"))
    best = best_by(counts, page, F.desc("_rows"), F.asc("table")).select(*page, "table")
    return cells.join(best, [*page, "table"], "left_semi")


def detect_header(cells: DataFrame, keys: Sequence[str], patterns: dict[str, str], least: int) -> DataFrame:
    """(keys..., row, name, col): columns named by the first row in which at least `least` header patterns are found.

    A cell names one column, the first pattern that fits; a column takes its first cell.
    """
    keys = list(keys)
    fit = None
    for name, pattern in patterns.items():
        hit = F.lower(F.col("text")).rlike(pattern)
        fit = F.when(hit, name) if fit is None else fit.when(hit, name)
    named = cells.withColumn("name", fit).where("name is not null").groupBy(*keys, "row", "name").agg(F.min("col").alias("col"))
    rows = named.groupBy(*keys, "row").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).groupBy(*keys).agg(F.min("row").alias("row"))
    return named.join(rows, [*keys, "row"])


def first_non_empty(*columns: Column) -> Column:
    """First of several columns that is not blank, null if none is: two layouts of one column merged."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def lanes_to_rows(df: DataFrame, ids: Sequence[str], lanes: dict[str, dict]) -> DataFrame:
    """Wide lane columns as rows (ids, lane, name, constants...) without blank names; constants by lane."""
    long = df.unpivot(list(ids), list(lanes), "lane", "name").where("trim(name) <> ''")
    for c in sorted({k for v in lanes.values() for k in v}):
        long = long.withColumn(c, F.create_map(*[F.lit(x) for lane, v in lanes.items() for x in (lane, v.get(c))])[F.col("lane")])
    return long


def month_mode(df: DataFrame, text: str, keys: Sequence[str] = (), least_year: int = 2025) -> DataFrame:
    """(keys..., month, year, n): the month most named by the numeric dates in texts, the first named on ties.

    Two-digit years are of this century; dates before least_year do not count.
    """
    pattern = "(?<![0-9])[0-9]{1,2}[/.-]([0-9]{1,2})[/.-]((?:20)?[0-9]{2})(?![0-9])"
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("y"))
    rows = df.select(*keys, F.posexplode(parts).alias("_pos", "_p"))
    rows = rows.select(*keys, "_pos", F.col("_p")["m"].cast("int").alias("month"), F.right(F.concat(F.lit("20"), F.col("_p")["y"]), F.lit(4)).cast("int").alias("year"))
    counts = rows.where(F.col("month").between(1, 12) & (F.col("year") >= least_year)).groupBy(*keys, "month", "year").agg(F.count("*").alias("n"), F.min("_pos").alias("_first"))
    return best_by(counts, keys, F.desc("n"), F.asc("_first"), F.asc("year"), F.asc("month")).drop("_first") if keys else counts.orderBy(F.desc("n"), F.asc("_first"), F.asc("year"), F.asc("month")).limit(1).drop("_first")


def nth_weekdays(days: DataFrame, month: Column, keys: Sequence[str]) -> DataFrame:
    """Rows (ord, dow) of weekday names with the date of the n-th such weekday in the month for the n-th occurrence."""
    w = Window.partitionBy(*keys, "dow").orderBy("ord")
    first = F.trunc(month, "month")
    offset = F.pmod(F.col("dow") - F.dayofweek(first), F.lit(7)) + (F.row_number().over(w) - 1) * 7
    out = days.withColumn("date", F.date_add(first, offset.cast("int")))
    return out.where(F.month("date") == F.month(month))


def split_at_dates(df: DataFrame, text: str) -> DataFrame:
    """df's rows exploded at the dates of a line that has two or more: (pos, date_key, segment)."""
    pattern = "(?<![0-9])[0-9]{1,2}/[0-9]{1,2}(?![0-9/])"
    dates = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    segments = F.slice(F.split(text, pattern), 2, F.greatest(F.size(dates), F.lit(1)))
    rows = df.where(F.size(dates) >= 2).withColumn("_z", F.arrays_zip(dates.alias("d"), segments.alias("s")))
    return rows.select(*df.columns, F.posexplode("_z").alias("pos", "_p")).select(*df.columns, "pos", F.col("_p")["d"].alias("date_key"), F.trim(F.col("_p")["s"]).alias("segment"))


def around_phones(df: DataFrame, text: str, before: int = 160, after: int = 90) -> DataFrame:
    """One row per mobile number in a text with the text around it: (pos, phone, context)."""
    mark = F.regexp_replace(F.translate(text, _MARK, ""), "(?<![0-9])(05[0-9]{8})(?![0-9])", f"{_MARK}$1{_MARK}")
    parts = F.split(mark, _MARK)
    index = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i % 2 == 0)
    found = F.transform(index, lambda i: F.struct(
        F.element_at(parts, i).alias("phone"),
        F.concat(F.right(F.array_join(F.slice(parts, 1, i - 1), ""), F.lit(before)), F.element_at(parts, i), F.left(F.array_join(F.slice(parts, i + 1, F.size(parts)), ""), F.lit(after))).alias("context")))
    rows = df.where(F.contains(text, F.lit("05"))).where(F.size(parts) > 1)
    return rows.select(*df.columns, F.posexplode(found).alias("pos", "_p")).select(*df.columns, "pos", "_p.phone", "_p.context")


def merge_halves(df: DataFrame, keys: Sequence[str], half: str, name: str) -> DataFrame:
    """Morning and evening rows of a day merged: equal names or no evening give one 24h row, an evening alone a night
    row, different names a day and a night row. One aggregate instead of a self join."""
    am, pm = (F.max(F.when(F.upper(F.col(half)) == h, F.nullif(F.trim(name), F.lit("")))) for h in ("AM", "PM"))
    both = df.groupBy(*keys).agg(am.alias("am"), pm.alias("pm"))
    one = lambda c, s: F.array(F.struct(F.col(c).alias(name), F.lit(s).alias("shift")))
    rows = F.when(F.col("am").isNull() & F.col("pm").isNull(), F.slice(one("am", "24h"), 1, 0)).when(F.col("pm").isNull() | (F.col("am") == F.col("pm")), one("am", "24h"))
    rows = rows.when(F.col("am").isNull(), one("pm", "night")).otherwise(F.concat(one("am", "day"), one("pm", "night")))
    return both.select(*keys, F.explode(rows).alias("_r")).select(*keys, f"_r.{name}", "_r.shift")


def continuation(df: DataFrame, keys: Sequence[str], order: str, starts: Column, text: str) -> DataFrame:
    """Lines joined under the line that starts their block with ` / `: (keys..., block, text). Lines before the first
    start are left out."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = df.withColumn("block", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w)).where("block > 0")
    lines = numbered.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_l"))
    return lines.select(*keys, "block", F.array_join(F.transform("_l", lambda x: x[text]), " / ").alias("text"))


def between_markers(text: Column, start: str, ends: Sequence[str]) -> Column:
    """The part of a text after a start pattern up to the nearest end pattern, null if there is no start."""
    body = F.regexp_extract(text, f"(?is){start}(.*?)(?={'|'.join(ends)}|$)", 1)
    return F.when(text.rlike(f"(?is){start}"), body)


def partition_tokens(df: DataFrame, tokens: str, known: Sequence[str], groups: int = 6, widest: int = 4) -> DataFrame:
    """df with `parts`: the words split into exactly `groups` runs of 1 to `widest` words whose sum of widths plus 4 per
    run that is a known name is largest, the first such split; null where there are too few or too many words.

    Dynamic programming per row, in Arrow batches: no built-in function can express it.
    """
    names = frozenset(known)

    def split(words) -> list[str] | None:
        n = 0 if words is None else len(words)
        if not groups <= n <= groups * widest:
            return None
        best: dict[tuple[int, int], tuple[int, tuple]] = {(n, 0): (0, ())}
        for left in range(1, groups + 1):
            for i in range(n - 1, -1, -1):
                for w in range(1, widest + 1):
                    tail = best.get((i + w, left - 1))
                    if tail:
                        part = " ".join(words[i : i + w])
                        score = tail[0] + w + (4 if part in names else 0)
                        if (i, left) not in best or score > best[i, left][0]:
                            best[i, left] = (score, (part, *tail[1]))
        out = best.get((0, groups))
        return list(out[1]) if out else None

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(split)

    return df.withColumn("parts", run(F.col(tokens)))


def time_range(text: Column) -> Column:
    """(start_min, end_min) of the first `h[:mm] - h[:mm]` in a text, null if there is none or it is no time of day."""
    pattern = "(?<![0-9])([0-9]{1,2})(?:[:.]([0-9]{2}))?\\s*(?:-|\u2013|to)\\s*([0-9]{1,2})(?:[:.]([0-9]{2}))?(?![0-9])"
    part = lambda k: F.regexp_extract(text, pattern, k)
    minute = lambda h, m: part(h).try_cast("int") * 60 + F.coalesce(part(m).try_cast("int"), F.lit(0))
    fine = (minute(1, 2) <= 1440) & (minute(3, 4) <= 1440) & (F.coalesce(part(2).try_cast("int"), F.lit(0)) < 60) & (F.coalesce(part(4).try_cast("int"), F.lit(0)) < 60)
    return F.when(fine, F.struct(minute(1, 2).alias("start_min"), minute(3, 4).alias("end_min")))


def contacts_of_cells(cells: DataFrame, keys: Sequence[str], reach: int = 3, least: int = 3) -> DataFrame:
    """(keys..., row, name, phone) of cells (row, col, text): each phone with the nearest cell of `least` letters or more
    among the `reach` cells to its left."""
    w = Window.partitionBy(*keys, "row").orderBy("col").rowsBetween(-reach, -1)
    digits = F.regexp_replace("text", "[ ()+-]", "")
    is_phone = digits.rlike("^[0-9]{9,14}$")
    name = F.when(~is_phone & (F.length(F.trim("text")) >= least), F.trim("text"))
    out = cells.withColumns({"phone": F.when(is_phone, digits), "name": F.last(name, ignorenulls=True).over(w)})
    return out.where("phone is not null and name is not null").select(*keys, "row", "name", "phone")


def contacts_of_lines(lines: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """(keys..., name, phone) of lines: the text between phones on a line, or a line of a name before one of a phone."""
    number = "(?<![0-9])05[0-9]{8}(?![0-9])"
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(text).over(w)
    t = F.col(text)
    found = F.regexp_extract_all(t, F.lit(f"({number})"), F.lit(1))
    names = F.transform(F.slice(F.split(t, number), 1, F.greatest(F.size(found), F.lit(1))), lambda x: F.trim(F.regexp_replace(x, "^[^\\p{L}]+|[^\\p{L}.)]+$", "")))
    alone = (F.size(found) == 1) & (F.element_at(names, 1) == "") & ~F.coalesce(before.rlike(number), F.lit(True))
    pairs = F.when(alone, F.array(F.struct(F.trim(before).alias("name"), F.element_at(found, 1).alias("phone")))).otherwise(
        F.zip_with(names, found, lambda n, p: F.struct(n.alias("name"), p.alias("phone"))))
    rows = lines.select(*keys, F.size(found).alias("_n"), pairs.alias("_p")).where("_n > 0")
    return rows.select(*keys, F.explode("_p").alias("_c")).where("_c.name <> ''").select(*keys, "_c.name", "_c.phone")


def position_of(text: Column) -> Column:
    """`Resident N`, `Consultant` or `Fellow N` named in a text, null if none is."""
    hit = F.regexp_extract(text, "(?i)\\b(resident|consultant|fellow)\\b\\s*([0-9]*)", 0)
    return F.when(hit != "", F.initcap(F.trim(hit)))


def expand_legend(lines: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys..., abbr, name, phone) of legend lines such as `AB(12) Dr. Name 0500000000`, the first of each abbreviation."""
    pattern = "\\b([A-Z]{2,5})\\s*\\([^)]*\\)\\s*(Dr\\.? [\\p{L} .'-]+?)\\s*(05[0-9]{8})"
    part = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    rows = lines.select(*keys, F.posexplode(F.arrays_zip(part(1).alias("abbr"), part(2).alias("name"), part(3).alias("phone"))).alias("_pos", "_l"))
    return rows.groupBy(*keys, F.col("_l")["abbr"].alias("abbr")).agg(F.min_by(F.col("_l")["name"], "_pos").alias("name"), F.min_by(F.col("_l")["phone"], "_pos").alias("phone"))


def dictionary_words(text: Column, words: Sequence[str]) -> Column:
    """The known words found in a text, in order, longer ones first where they overlap."""
    import re

    if not words:
        return F.array().cast("array<string>")
    known = "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))
    return F.regexp_extract_all(text, F.lit(f"(?i)(?<![\\p{{L}}])({known})(?![\\p{{L}}])"), F.lit(1))


def valid_name(name: Column, never: Sequence[str] = ()) -> Column:
    """Whether a text can be a person's name: 3 to 80 letters long, none of the words that never are, at least one
    letter, no digits only, no clock time or date."""
    t = F.lower(F.trim(name))
    fine = F.length(t).between(3, 80) & t.rlike("\\p{L}") & ~t.rlike("^[0-9/.: -]+$|^[0-9]{1,2}[:/][0-9]{2}")
    return F.coalesce(fine & ~t.isin([w.lower() for w in never]) if never else fine, F.lit(False))


# Texts of header cells that a reading repeats as data.
LABELS = ("date", "day", "name", "consultant", "resident", "residents", "fellow", "on-call", "on call", "shift", "section")


def columns_or_fallback(cells: DataFrame, keys: Sequence[str], patterns: dict[str, str], least: int, fallback: dict[str, int], date_pattern: str, date_col: int) -> DataFrame:
    """(keys..., name, col) of each table: its header's columns, or, where no row has `least` header patterns, the fallback
    columns moved by as much as the table's first date cell is away from `date_col`.

    Names that a header lacks stay missing. Tables without header and date keep the fallback as it is.
    """
    keys = list(keys)
    named = detect_header(cells, keys, patterns, least).select(*keys, "name", "col")
    bare = cells.select(*keys).distinct().join(named.select(*keys).distinct(), keys, "left_anti")
    date = cells.where(F.col("text").rlike(date_pattern)).groupBy(*keys).agg((F.min_by("col", F.struct("row", "col")) - date_col).alias("_move"))
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("col")) for n, c in fallback.items()])
    fixed = bare.join(date, keys, "left").select(*keys, F.coalesce("_move", F.lit(0)).alias("_move"), F.explode(listed).alias("_f"))
    return named.unionByName(fixed.select(*keys, "_f.name", (F.col("_f.col") + F.col("_move")).alias("col")))


def cells_to_rows(cells: DataFrame, keys: Sequence[str], columns: DataFrame, names: Sequence[str], date_pattern: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """(keys..., row, date, names...): rows with a date cell, by the columns of their table.

    Repeated header labels count as empty, line ends as blanks; rows without any value are left out.
    """
    keys = list(keys)
    text = F.trim(F.regexp_replace("text", "\\s*\\n\\s*", " "))
    clean = cells.withColumn("text", F.when(F.lower(text).isin(list(labels)), "").otherwise(text))
    dates = clean.where(F.col("text").rlike(date_pattern)).groupBy(*keys, "row").agg(F.min_by("text", "col").alias("date"))
    placed = clean.join(columns, [*keys, "col"]).where("text <> ''")
    wide = placed.groupBy(*keys, "row").agg(*[F.min_by(F.when(F.col("name") == n, F.col("text")), F.when(F.col("name") == n, F.col("col"))).alias(n) for n in names])
    some = None
    for n in names:
        some = F.col(n).isNotNull() if some is None else some | F.col(n).isNotNull()
    return dates.join(wide, [*keys, "row"]).where(some).select(*keys, "row", "date", *names)


def first_map(*maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of several column maps (keys, name, col) of a table the first that has any: header, non-empty cells, fixed ones."""
    out = maps[0]
    for m in maps[1:]:
        out = out.unionByName(m.join(out.select(*keys).distinct(), list(keys), "left_anti"))
    return out


def filled_columns(cells: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys..., name, col): names in order for the first non-empty cells of a table's first row that has as many."""
    filled = cells.where(F.trim("text") != "")
    w = Window.partitionBy(*keys, "row").orderBy("col")
    ranked = filled.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= len(names))
    full = ranked.groupBy(*keys, "row").agg(F.max("_n").alias("_n")).where(F.col("_n") == len(names)).groupBy(*keys).agg(F.min("row").alias("row"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_n"))
    return ranked.join(full, [*keys, "row"]).select(*keys, name.alias("name"), "col")


def half_of_day(text: Column) -> Column:
    """AM or PM named in a date cell, null if neither."""
    return F.nullif(F.upper(F.regexp_extract(text, "(?i)\\b(am|pm)\\b", 1)), F.lit(""))


def day_name(text: Column) -> Column:
    """A weekday by its first three letters, null where a cell is none."""
    hit = F.regexp_extract(F.trim(text), "^(?i)(sun|mon|tue|wed|thu|fri|sat)(?:[a-z]*day)?$", 1)
    return F.nullif(F.initcap(F.lower(hit)), F.lit(""))


def compacted(text: Column) -> Column:
    """Text with glued words apart, dates at the start of a line, and mobile numbers set off by blanks."""
    t = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    t = F.regexp_replace(t, "[ \\t]+([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})", "\n$1")
    return F.trim(F.regexp_replace(t, " *(05[0-9]{8}) *", " $1 "))


def name_near_phone(line: Column) -> Column:
    """The name on a line with a phone: without numbers, dates and words of roles, from its title on, up to two blanks;
    null if nothing is left."""
    t = F.regexp_replace(line, "(?:\\+?966|0)?5[0-9]{8}|[0-9]{1,2}/[0-9]{1,2}(?:/[0-9]{2,4})?", "")
    t = F.regexp_replace(t, "(?i)\\b(?:1st|2nd|3rd|on-call|on call|consultant|resident|fellow|senior|junior|ext)\\b\\.?", "")
    titled = F.regexp_extract(t, "(?i)(\\bdr\\b.*)", 1)
    t = F.trim(F.when(titled != "", titled).otherwise(t))
    return F.nullif(F.trim(F.regexp_replace(F.element_at(F.split(t, "\\s{2,}"), 1), "[^\\p{L}.)]+$", "")), F.lit(""))


def from_right(tokens: Column, names: Sequence[str], skip: int = 1) -> Column:
    """Struct of the words of a line counted from its right end, `skip` last ones ignored: the last name first."""
    return F.struct(*[F.try_element_at(tokens, F.lit(-1 - skip - i)).alias(n) for i, n in enumerate(names)])


def blocks_of(lines: DataFrame, keys: Sequence[str], order: str, starts: Column, size: int) -> DataFrame:
    """Lines (keys..., block, place) that follow a header line, of blocks that have exactly `size` lines."""
    w = Window.partitionBy(*keys).orderBy(order)
    head = F.coalesce(starts, F.lit(False))
    numbered = lines.withColumns({"_h": head, "block": F.sum(head.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))}).where("block > 0 and not _h").drop("_h")
    placed = numbered.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "block").orderBy(order)))
    full = placed.groupBy(*keys, "block").agg(F.max("place").alias("_n")).where(F.col("_n") == size).drop("_n")
    return placed.join(full, [*keys, "block"], "left_semi")


def template_hits(text: Column, markers: Sequence[str]) -> Column:
    """How many of a template's markers a text has."""
    return sum((F.coalesce(text.rlike(m).cast("int"), F.lit(0)) for m in markers), F.lit(0))


def parse_by(df: DataFrame, parsers: dict[str, tuple[Column, object]], fallback: object) -> DataFrame:
    """Rows of the parser (condition, DataFrame -> DataFrame) of each document, by the first condition that holds, with its
    name as `parser_mode`; documents that fit none go to `fallback` as `generic`. Parsers return equal columns."""
    out, left = None, F.lit(True)
    for name, (condition, parse) in parsers.items():
        fits = F.coalesce(condition, F.lit(False))
        one = parse(df.where(left & fits)).withColumn("parser_mode", F.lit(name))
        out, left = one if out is None else out.unionByName(one), left & ~fits
    rest = fallback(df.where(left)).withColumn("parser_mode", F.lit("generic"))
    return rest if out is None else out.unionByName(rest)


def known_in(df: DataFrame, text: Column, names: Sequence[str], out: str, otherwise: Column) -> DataFrame:
    """df with the known names that stand in a text as whole words, in order, or `otherwise` where none does."""
    found = dictionary_words(text, names)
    return df.withColumn(out, F.when(F.size(found) > 0, F.array_distinct(F.transform(found, lambda w: F.lower(w)))).otherwise(otherwise))


def interpolated(centres: DataFrame, keys: Sequence[str], col: str, x: str) -> DataFrame:
    """centres (keys, col, x) with x of columns that lack it on the line between the known neighbours; beyond the outermost
    known one the step between the two nearest goes on. Columns of a table with fewer than two known x stay null."""
    w = Window.partitionBy(*keys).orderBy(col)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(x).isNotNull(), F.struct(F.col(col).alias("c"), F.col(x).alias("x")))
    all_ = F.array_sort(F.collect_list(known).over(Window.partitionBy(*keys)))
    rows = centres.withColumns({"_b": F.last(known, ignorenulls=True).over(back), "_a": F.first(known, ignorenulls=True).over(ahead), "_all": all_})
    rows = rows.withColumns({"_p": F.when(F.col("_b").isNull(), F.try_element_at("_all", F.lit(1))).when(F.col("_a").isNull(), F.try_element_at("_all", F.lit(-2))).otherwise(F.col("_b")),
                             "_q": F.when(F.col("_b").isNull(), F.try_element_at("_all", F.lit(2))).when(F.col("_a").isNull(), F.try_element_at("_all", F.lit(-1))).otherwise(F.col("_a"))})
    line = F.col("_p.x") + (F.col(col) - F.col("_p.c")) * (F.col("_q.x") - F.col("_p.x")) / (F.col("_q.c") - F.col("_p.c"))
    value = F.when(F.size("_all") >= 2, F.coalesce(F.col(x), line)).otherwise(F.col(x))
    return rows.withColumn(x, value).select(*centres.columns)
