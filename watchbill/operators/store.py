"""Keyed tables kept as immutable Parquet: upsert, patch, delete, expiry, history.

Each function gives the new state as a plan; `written` or a plain write makes it a table. A table that is partitioned
or bucketed by its key is merged without a shuffle of the old state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchbill.operators.windows import best_by


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: str, tie: str) -> DataFrame:
    """One row per key: the newest by version, then by the larger tie; changes win over current on equal ones."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return best_by(both, keys, F.desc_nulls_last(version), F.desc("_new"), F.desc_nulls_last(tie)).drop("_new")


def patch(current: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """current with the non-null values of changes (one row per key): nulls never overwrite; other keys are not added."""
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = current.join(new, list(keys), "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in current.columns])


def delete(current: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return current.join(gone, list(keys), "left_anti")


def orphaned(owners: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Owners of which no part is left: what a cascading delete removes too."""
    return owners.join(parts.select(key).distinct(), key, "left_anti")


def fresh(cache: DataFrame, now: Column, expires: str, version: str, wanted: str) -> DataFrame:
    """Cached rows of the wanted version that have not expired at now."""
    return cache.where((F.col(expires) > now) & (F.col(version) == wanted))


def content_key(*parts: Column) -> Column:
    """Hex SHA-256 of the parts, nulls apart from empty texts."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def history(versions: DataFrame, keys: Sequence[str], at: str, order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """Versions with the instant until which each held (null: still) and whether it is current; a version that repeats
    the values before it opens no new row."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(w))
    rows = versions.withColumn("_same", F.coalesce(same & (F.row_number().over(w) > 1), F.lit(False))).where("not _same").drop("_same")
    until = F.lead(at).over(w)
    return rows.withColumn("valid_to", until).withColumn("is_current", until.isNull())


def newer_only(local: DataFrame, remote: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Remote rows newer than the local row of their key, or without one: what a pull has to write."""
    known = local.groupBy(*keys).agg(F.max(version).alias("_known"))
    return remote.join(known, list(keys), "left").where(F.col("_known").isNull() | (F.col(version) > F.col("_known"))).drop("_known")
