"""Operational statistics over logs and uploads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchbill.functions.timeops import half_up


def status_rates(df: DataFrame, keys: Sequence[str], status: str, good: Sequence[str]) -> DataFrame:
    """(keys..., total, good, rate): rows, good rows and their percentage, halves rounded up, 100 without rows."""
    out = df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col(status).isin(list(good)), F.lit(False))).alias("good"))
    return out.withColumn("rate", F.when(F.col("total") == 0, 100).otherwise(half_up(F.col("good") * 100.0 / F.col("total"))).cast("bigint"))


def trend(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, red: float = -0.30, yellow: float = -0.15) -> DataFrame:
    """(keys..., latest, previous, change, health) of the last two rows of each key in order (latest first).

    health: red below `red`, yellow below `yellow`, else green; yellow with no previous row or an empty latest one.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    two = df.withColumn("_n", F.row_number().over(w)).where("_n <= 2").groupBy(*keys).agg(
        F.max(F.when(F.col("_n") == 1, F.col(value))).alias("latest"), F.max(F.when(F.col("_n") == 2, F.col(value))).alias("previous"), F.count("*").alias("_rows"))
    change = F.when((F.col("latest") > 0) & (F.col("previous") > 0), (F.col("latest") - F.col("previous")) / F.col("previous"))
    few = (F.col("_rows") < 2) | (F.coalesce("latest", F.lit(0)) == 0)
    health = F.when(few, "yellow").when(change < red, "red").when(change < yellow, "yellow").otherwise("green")
    return two.select(*keys, "latest", "previous", change.alias("change"), health.alias("health"))


def changes_log(old: DataFrame, new: DataFrame, id: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(id..., action, field, old_value, new_value): one row per changed field, and one per added or removed row."""
    id = [id] if isinstance(id, str) else list(id)
    a = old.select(*id, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("_a"))
    b = new.select(*id, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("_b"))
    both = a.join(b, id, "full")
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_a.{c}").alias("old_value"), F.col(f"_b.{c}").alias("new_value")) for c in columns])
    edits = F.filter(fields, lambda f: ~f["old_value"].eqNullSafe(f["new_value"]))
    none = F.lit(None).cast("string")
    whole = F.array(F.struct(none.alias("field"), none.alias("old_value"), none.alias("new_value")))
    action = F.when(F.col("_a").isNull(), "add").when(F.col("_b").isNull(), "delete").otherwise("edit")
    rows = both.select(*id, action.alias("action"), F.explode(F.when(F.col("_a").isNull() | F.col("_b").isNull(), whole).otherwise(edits)).alias("_e"))
    return rows.select(*id, "action", "_e.field", "_e.old_value", "_e.new_value")


def device(agent: Column) -> Column:
    """Device class of a user agent, by the first pattern that fits."""
    a = F.lower(agent)
    return F.when(a.rlike("ipad|tablet"), "tablet").when(a.rlike("iphone|android|mobile"), "phone").when(a.rlike("windows|macintosh|linux|x11"), "desktop").otherwise("other")


def json_field(column: Column, field: str, kind: str) -> Column:
    """A field of a JSON object in a string column, null where the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(column), f"$.{field}", kind)


def batches(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int) -> DataFrame:
    """df with the number of the batch of `size` rows, from 0, in each group: for calls that take few rows at once."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
