"""Which rows hold: source priorities, fallbacks, merges of schedules, rows in force at an instant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchbill.functions.timeops import range_active
from watchbill.operators.windows import best_by


def by_priority(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """All rows of the first source that has any for a key, with the source's number as `priority`; sources share their
    columns. Rows with a null in keys are left out."""
    both = None
    for n, s in enumerate(sources):
        one = s.withColumn("priority", F.lit(n))
        both = one if both is None else both.unionByName(one)
    best = both.groupBy(*keys).agg(F.min("priority").alias("priority"))
    return both.join(best, [*keys, "priority"], "left_semi").select(*both.columns)


def merge_schedules(primary: DataFrame, fallback: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """primary and those rows of fallback whose keys it lacks, the first of each key."""
    rest = best_by(fallback.join(primary.select(*keys).distinct(), list(keys), "left_anti"), keys, *order)
    return primary.unionByName(rest)


def active_at(df: DataFrame, minute: int, start: str, end: str, group: Sequence[str], quiet: Column) -> DataFrame:
    """Rows in force at a minute of the day: in groups with a `quiet` row (no coverage) only those rows; else rows whose
    window holds; where no row of a group has a window, all of them; where windows are known and none holds, none. Rows
    with a null in group are left out."""
    at = F.lit(minute)
    known = F.col(start).isNotNull() & F.col(end).isNotNull()
    marked = df.withColumns({"_quiet": F.coalesce(quiet, F.lit(False)), "_known": known, "_on": F.coalesce(known & range_active(at, F.col(start), F.col(end)), F.lit(False))})
    flags = marked.groupBy(*group).agg(F.max("_quiet").alias("_any_quiet"), F.max("_known").alias("_any_known"))
    hold = F.when(F.col("_any_quiet"), F.col("_quiet")).when(F.col("_any_known"), F.col("_on")).otherwise(True)
    return marked.join(flags, list(group)).where(hold).select(*df.columns)


def current_upload(uploads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The upload of each key that counts: one with entries, then the latest, then the smallest id."""
    has = F.coalesce(F.col("entries_count"), F.lit(0)) > 0
    return best_by(uploads, keys, F.desc(has), F.desc_nulls_last("uploaded_at"), F.asc("upload_id"))


def signature(df: DataFrame, keys: Sequence[str], *parts: Column) -> DataFrame:
    """(keys..., rows, signature) of a group's content, whatever its order: hashes are summed, never collected.

    The sum of a 64-bit hash of each row, and the number of rows, are equal for equal bags of rows.
    """
    h = F.xxhash64(*[x for p in parts for x in (p.isNull(), F.coalesce(p.cast("string"), F.lit("")))])
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(F.expr("0") + h.cast("decimal(20,0)")).alias("signature"))


def changed_groups(old: DataFrame, new: DataFrame, keys: Sequence[str], *parts: Column) -> DataFrame:
    """Keys whose bag of rows differs between two versions, with kind added, removed or changed."""
    a, b = signature(old, keys, *parts).withColumnsRenamed({"rows": "ra", "signature": "sa"}), signature(new, keys, *parts).withColumnsRenamed({"rows": "rb", "signature": "sb"})
    both = a.join(b, list(keys), "full")
    kind = F.when(F.col("ra").isNull(), "added").when(F.col("rb").isNull(), "removed").when((F.col("ra") != F.col("rb")) | (F.col("sa") != F.col("sb")), "changed")
    return both.withColumn("kind", kind).where("kind is not null").select(*keys, "kind")
