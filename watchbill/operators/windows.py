"""First-wins, argmax, fallback, paging and carry-forward over groups: the order of rows is always a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap_per_key(df: DataFrame, keys: Sequence[str], most: int, *order: Column) -> DataFrame:
    """The first `most` rows of each key in order. Give a total order: ties are otherwise broken at will.

    The filter on the rank makes Spark rank within each partition before the shuffle (WindowGroupLimit), so at most
    `most` rows of a hot key leave a partition.
    """
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_n") <= most).drop("_n")


def best_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The row of each key that comes first in order: first wins, argmax and latest are this with different orders."""
    return cap_per_key(df, keys, 1, *order)


def keep_if_any(df: DataFrame, keys: Sequence[str], keep: Column) -> DataFrame:
    """Rows that satisfy keep, or, in groups where none does, all rows. A null condition is not satisfied.

    The groups' flags are aggregated and joined back, so no group is gathered in one task.
    """
    flag = F.coalesce(keep, F.lit(False))
    marked = df.withColumn("_keep", flag)
    groups = marked.groupBy(*keys).agg(F.max("_keep").alias("_any")).withColumnsRenamed({k: f"_g_{k}" for k in keys})
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_g_{k}"))
        same = one if same is None else same & one
    out = marked.join(groups, same) if same is not None else marked.crossJoin(F.broadcast(groups))
    return out.where(F.col("_keep") | ~F.col("_any")).select(*df.columns)


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Nulls of columns filled with the last value before them in the order of the group."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def recent_top(df: DataFrame, key: str, ts: str, tie: str, cap: int, k: int) -> DataFrame:
    """The k most frequent keys among the newest `cap` rows: the limit comes before the aggregate. Ties go to the key
    with the newest row, then to the smaller key."""
    newest = df.orderBy(F.desc(ts), F.desc(tie)).limit(cap)
    counts = newest.groupBy(key).agg(F.count("*").alias("n"), F.max(ts).alias("newest"))
    return counts.orderBy(F.desc("n"), F.desc("newest"), F.asc(key)).limit(k)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of a total order, numbered from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def share_of_largest(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    """Each row's value in percent of the largest one: the maximum is aggregated and joined, no global window."""
    top = df.agg(F.max(value).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn(out, F.col(value) * 100.0 / F.col("_top")).drop("_top")
