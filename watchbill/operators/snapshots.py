"""What changed between consecutive full snapshots of a table.

Each row is reduced to its key, its snapshot number and a 64-bit hash of its normalised content. Those compact rows are
hash-bucketed by key; a bucket's arrays are sorted in numpy and consecutive snapshots compared by searchsorted. Full
values are fetched for differing keys only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BUCKET = 2_000_000  # rows of 24 bytes that one task holds

_INSTANTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")


def instant(text: Column) -> Column:
    """Microseconds of a typed instant with offset, read alike in every notation and session zone; null if unreadable.

    `T` or blank between date and time, fractions of a second, `Z`, +03, +0300 and +03:00 are read; without an offset
    the text means UTC.
    """
    t = F.regexp_replace(F.regexp_replace(F.trim(text), "[Tt]", " "), "\\s*(?:[zZ]|UTC)$", "+00:00")
    t = F.regexp_replace(t, "\\s*([+-])([0-9]{2}):?([0-9]{2})?$", " $1$2:$3")
    t = F.regexp_replace(t, "( [+-][0-9]{2}:)$", "$100")
    t = F.when(t.rlike(" [+-][0-9]{2}:[0-9]{2}$"), t).otherwise(F.concat(t, F.lit(" +00:00")))
    return F.unix_micros(F.try_to_timestamp(F.regexp_replace(t, " ([+-])", "$1")))


def json_text(text: Column) -> Column:
    """JSON with keys sorted and layout and escapes made alike; order in arrays, nulls and absent keys stay apart.

    Text that is no JSON is kept as it is.
    """
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def state_hash(*columns: Column) -> Column:
    """64-bit hash of a row's content in which nulls have a place of their own."""
    parts = [x for c in columns for x in (c.isNull(), F.coalesce(c.cast("string"), F.lit("")))]
    return F.xxhash64(*parts)


def _differences(steps: Sequence[int]) -> Callable:
    """(_key, _snap, _state) of whole buckets to (_key, _snap, change); steps: the snapshot numbers in order."""

    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.concat_tables(tables)
        raw = t["_key"].combine_chunks()
        if pa.types.is_integer(raw.type):
            key = raw.to_numpy(zero_copy_only=False)
        else:
            key = np.frombuffer(raw.cast(pa.binary(16)).buffers()[1], "S16", len(raw), raw.offset * 16)
        snap, state = t["_snap"].to_numpy(), t["_state"].to_numpy()
        order = np.argsort(snap, kind="stable")
        key, snap, state = key[order], snap[order], state[order]
        cuts = np.searchsorted(snap, np.array(steps))
        ends = np.searchsorted(snap, np.array(steps), side="right")
        old_k, old_s = None, None
        for n, a, b in zip(steps, cuts, ends):
            by = np.argsort(key[a:b], kind="stable")
            k, s = key[a:b][by], state[a:b][by]
            if old_k is not None:
                at = np.searchsorted(old_k, k)
                there = np.zeros(len(k), bool)
                inside = at < len(old_k)
                there[inside] = old_k[at[inside]] == k[inside]
                changed = np.zeros(len(k), bool)
                changed[there] = old_s[at[there]] != s[there]
                back = np.searchsorted(k, old_k)
                kept = np.zeros(len(old_k), bool)
                inside = back < len(k)
                kept[inside] = k[back[inside]] == old_k[inside]
                for what, keys in (("added", k[~there]), ("removed", old_k[~kept]), ("changed", k[changed])):
                    if len(keys):
                        values = pa.array(keys, raw.type) if keys.dtype.kind == "i" else pa.array([x.ljust(16, b"\0") for x in keys.tolist()], pa.binary())
                        yield pa.RecordBatch.from_arrays(
                            [values, pa.array(np.full(len(keys), n), pa.int64()), pa.array([what] * len(keys))], ["_key", "_snap", "change"]
                        )
            old_k, old_s = k, s

    return run


def snapshot_changes(
    df: DataFrame, snap: str, keys: Sequence[str], state: Sequence[Column], latest_by: str | None = None, buckets: int | None = None
) -> DataFrame:
    """One row (snap, keys, change) for each record added, removed or changed from one snapshot to the next.

    Snapshots follow each other by number, whenever they were delivered; the numbers present are read first (they are
    few). The first gives no rows. A record's state is the tuple `state`, in which nulls count. Rows of one record
    within a snapshot: the one latest by `latest_by` counts, on ties the largest hash, so that results do not depend
    on order; exact repeats make no difference. Rows with a null snap or a null key take no part. Nothing is read of
    df but keys, snap, latest_by and the columns of state. With one bigint or int key that key is compared itself,
    else its 128-bit digest.
    """
    keys = list(keys)
    whole = len(keys) == 1 and df.schema[keys[0]].dataType.typeName() in ("long", "integer", "short")
    key = F.col(keys[0]).cast("bigint") if whole else F.unhex(F.md5(F.to_json(F.struct(*keys))))
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [snap, *keys]))
    order = F.col(latest_by) if latest_by else F.lit(0)
    compact = rows.select(key.alias("_key"), F.col(snap).cast("bigint").alias("_snap"), state_hash(*state).alias("_state"), order.alias("_order"))
    steps = sorted(r[0] for r in rows.select(F.col(snap).cast("bigint")).distinct().collect())
    one = compact.groupBy("_key", "_snap").agg(F.max(F.struct("_order", "_state")).alias("_last")).select("_key", "_snap", "_last._state")
    n = buckets or max(1, -(-df.count() // ROWS_PER_BUCKET), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = T.LongType() if whole else T.BinaryType()
    schema = T.StructType([T.StructField("_key", kind), T.StructField("_snap", T.LongType()), T.StructField("change", T.StringType())])
    found = one.repartition(n, "_key").mapInArrow(_differences(steps), schema)
    back = F.col("_snap").cast(df.schema[snap].dataType).alias(snap)
    if whole:
        return found.select(back, F.col("_key").cast(df.schema[keys[0]].dataType).alias(keys[0]), "change")
    names = rows.select(key.alias("_key"), *keys).dropDuplicates(["_key"])
    return found.join(names, "_key").select(back, *keys, "change")


def with_values(changes: DataFrame, df: DataFrame, snap: str, keys: Sequence[str], values: Sequence[str], latest_by: str) -> DataFrame:
    """changes with the values of the record before and after (old_*, new_*; null where it was not there).

    Only rows of differing keys are fetched: df is semi-joined with the changes before its wide columns are shuffled.
    """
    keys, at = list(keys), [snap, *keys]
    steps = sorted(r[0] for r in df.where(F.col(snap).isNotNull()).select(snap).distinct().collect())
    before = {b: a for a, b in zip(steps, steps[1:])}
    if not before:
        before = {0: 0}
    prior = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    wanted = changes.select(*keys).distinct()
    rows = df.join(wanted, keys, "left_semi").groupBy(*at).agg(F.max_by(F.struct(*values), F.struct(latest_by, *[F.col(v).cast("string") for v in values])).alias("_v"))
    side = lambda name: rows.select(*[F.col(k) for k in keys], F.col(snap).alias(f"_{name}"), *[F.col(f"_v.{v}").alias(f"{name}_{v}") for v in values])
    out = changes.withColumns({"_new": F.col(snap), "_old": prior[F.col(snap)]})
    out = out.join(side("old"), [*keys, "_old"], "left").join(side("new"), [*keys, "_new"], "left")
    return out.select(snap, *keys, "change", *[f"{s}_{v}" for v in values for s in ("old", "new")])


def consecutive(df: DataFrame, snap: str) -> tuple[DataFrame, DataFrame]:
    """(old, new): rows of every snapshot but the last under the number of the next, and of every one but the first.

    With snap among the keys, operators that compare two versions compare every consecutive pair at once. The numbers
    present are read first (they are few); rows with a null snap take no part.
    """
    steps = sorted(r[0] for r in df.where(F.col(snap).isNotNull()).select(snap).distinct().collect())
    if len(steps) < 2:
        return df.limit(0), df.limit(0)
    following = F.create_map(*[F.lit(x) for pair in zip(steps, steps[1:]) for x in pair])
    old = df.where(F.col(snap) != steps[-1]).withColumn(snap, following[F.col(snap)].cast(df.schema[snap].dataType))
    return old, df.where(F.col(snap) != steps[0])
