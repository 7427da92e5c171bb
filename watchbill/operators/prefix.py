"""Running sums over tables of any size: sorted within small buckets, summed over buckets in two levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 50_000
FAN = 1_024  # buckets that are summed together before the upper level


def _before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def running_start(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, count: int) -> DataFrame:
    """rows with `out`, the sum of value over the rows of the same keys before each in an order by hash of order[0].

    Rows of equal hash follow each other by `order`, which should name all that tells rows apart. count is the number of
    rows, from which the number of buckets follows; no task sorts more than a bucket and no sum reaches the driver, so a
    key may hold any part of the rows. Rows that repeat one value of order[0] share a bucket. Null values count as 0.
    """
    keys = list(keys)
    buckets = max(1, -(-count // ROWS_PER_BUCKET))
    hashed = rows.withColumn("_h", F.xxhash64(order[0])).withColumn("_bucket", F.floor((F.col("_h") / 2.0**64 + 0.5) * buckets))
    sums = hashed.groupBy(*keys, "_bucket").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_n")).withColumn("_part", F.floor(F.col("_bucket") / FAN))
    upper = _before(sums.groupBy(*keys, "_part").agg(F.sum("_n").alias("_n")), keys, ["_part"], "_n", "_upper").drop("_n")
    lower = _before(sums, [*keys, "_part"], ["_bucket"], "_n", "_lower").drop("_n")
    starts = lower.join(upper, [*keys, "_part"]).select(*keys, "_bucket", (F.col("_upper") + F.col("_lower")).alias("_start"))
    inside = _before(hashed, [*keys, "_bucket"], ["_h", *order], value, "_inside").join(starts, [*keys, "_bucket"])
    return inside.withColumn(out, F.col("_start") + F.col("_inside")).drop("_h", "_bucket", "_start", "_inside")
