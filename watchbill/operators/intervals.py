"""Overlapping, nested and gapped time intervals per key, as continuous periods and the gaps between them.

The aggregate's state is a list of sorted, disjoint intervals of one key within one cell of time. Every input batch is
reduced to such lists before anything is shuffled; lists of the same key and cell are then merged in a reduction tree:
first spread over `fan` branches, so that a hot key's lists meet in several tasks, then by key, where neighbouring
cells are joined and periods and gaps are emitted in one pass. Intervals are cut at cell borders first (touching pieces
join again at the end), so a list holds at most cell / 2 intervals however many rows a key has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = 32 * 24 * 60  # width of a cell of time: 32 days of minutes


def merge_sorted(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint union of intervals per group; group must not decrease, touching intervals join.

    Within a group the starts are runs that are already sorted (the lists of the partial aggregates); the stable sort
    finds the runs and merges them linearly.
    """
    if not len(group):
        return group, start, end
    low = int(start.min())
    width = int(end.max()) - low + 2
    if (int(group[-1]) + 1) * width >= 1 << 63:  # too wide for one number of 64 bits: ranks instead of times
        at = np.unique(np.concatenate([start, end]))
        g, s, e = merge_sorted(group, np.searchsorted(at, start), np.searchsorted(at, end))
        return g, at[s], at[e]
    key = group * width + (start - low)
    order = np.argsort(key, kind="stable")
    key, reach = key[order], (group * width + (end - low))[order]
    reach = np.maximum.accumulate(reach)
    first = np.empty(len(key), bool)
    first[0] = True
    first[1:] = (key[1:] > reach[:-1]) | (group[1:] != group[:-1])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(key)) - 1
    g = group[order][at]
    return g, key[at] - g * width + low, reach[last] - g * width + low


def _lists(g: np.ndarray, n: int, values: np.ndarray) -> pa.ListArray:
    counts = np.bincount(g, minlength=n)
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(values, pa.int64()))


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    lists = table[name].combine_chunks()
    return lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy()


def _partials(keys: Sequence[str]):
    """Rows (keys, _cell, _start, _end) of a batch to one row with sorted disjoint lists per key and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            code = t.select([*keys, "_cell"]).to_pandas().groupby([*keys, "_cell"], dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            firsts = order[np.concatenate([[True], np.diff(code[order]) > 0])]
            start, end = (t[c].to_numpy()[order] for c in ("_start", "_end"))
            g, s, e = merge_sorted(code[order].astype(np.int64), start, end)
            out = t.select([*keys, "_cell"]).take(pa.array(firsts))
            out = out.append_column("_starts", _lists(g, len(firsts), s)).append_column("_ends", _lists(g, len(firsts), e))
            yield from out.to_batches()

    return run


def _changes(t: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """True where a row's values in columns differ from the row before; nulls equal nulls."""
    n = t.num_rows
    out = np.zeros(n, bool)
    for c in columns:
        code = pd.factorize(t[c].to_pandas(), use_na_sentinel=False)[0]
        out[1:] |= code[1:] != code[:-1]
    if n:
        out[0] = True
    return out


def _merges(keys: Sequence[str]):
    """Rows with lists, sorted by (keys, _cell), to one row per key and cell; one group is held over a batch's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            t = t if held is None else pa.concat_tables([held, t])
            change = _changes(t, [*keys, "_cell"])
            row_group = np.cumsum(change) - 1
            lengths, start = _flat(t, "_starts")
            _, end = _flat(t, "_ends")
            g, s, e = merge_sorted(np.repeat(row_group, lengths).astype(np.int64), start, end)
            n = int(row_group[-1]) + 1
            out = t.select([*keys, "_cell"]).take(pa.array(np.flatnonzero(change)))
            out = out.append_column("_starts", _lists(g, n, s)).append_column("_ends", _lists(g, n, e))
            held = out.slice(n - 1)
            yield from out.slice(0, n - 1).to_batches()
        if held is not None:
            yield from held.to_batches()

    return run


def _periods(keys: Sequence[str], cell: int):
    """Rows with lists, sorted by (keys, _cell), to periods and gaps.

    Held over a batch's end, of the last key: the intervals of its last cell, which may still grow, the period that
    reaches into it, and the end of the last period given out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key: pa.Table | None = None
        held_s = held_e = np.zeros(0, np.int64)
        before: int | None = None  # end of the held key's last period given out
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            names = t.select(keys)
            rows = names if held_key is None else pa.concat_tables([held_key, names])
            change = _changes(rows, keys)
            group = np.cumsum(change) - 1
            lengths, start = _flat(t, "_starts")
            _, end = _flat(t, "_ends")
            cell_start = start[-lengths[-1]] if lengths[-1] else 0
            inner = np.repeat(group[len(rows) - len(names):], lengths)
            if held_key is not None:
                inner = np.concatenate([np.zeros(len(held_s), np.int64), inner])
                start, end = np.concatenate([held_s, start]), np.concatenate([held_e, end])
            g, s, e = merge_sorted(inner.astype(np.int64), start, end)
            last = int(group[-1])
            cell_low = int(t["_cell"][-1].as_py()) * cell
            hold = (g == last) & (e >= min(cell_low, int(cell_start)))
            gone = ~hold
            # the end of the period before, within a key; of the held key's first one, the end that was given out
            prior = np.concatenate([[0], e[:-1]])
            has = np.concatenate([[False], g[1:] == g[:-1]])
            if before is not None and len(g) and g[0] == 0:
                prior[0], has[0] = before, True
            at = pa.array(np.flatnonzero(change))
            yield from _emit(rows.take(at), g[gone], s[gone], e[gone], prior[gone], has[gone])
            first_held = int(np.argmax(hold)) if hold.any() else None
            if first_held is not None and has[first_held]:
                before = int(prior[first_held])
            else:
                mine = e[g == last]
                before = None if first_held is not None or not len(mine) else int(mine[-1])
            held_s, held_e = s[hold], e[hold]
            held_key = rows.take(at).slice(last, 1)
        if held_key is not None and len(held_s):
            prior = np.concatenate([[before or 0], held_e[:-1]])
            has = np.concatenate([[before is not None], np.ones(len(held_s) - 1, bool)])
            yield from _emit(held_key, np.zeros(len(held_s), np.int64), held_s, held_e, prior, has)

    return run


def _emit(keys: pa.Table, g, s, e, prior, has) -> Iterator[pa.RecordBatch]:
    if not len(g):
        return
    gap = np.flatnonzero(has)
    who = np.concatenate([g, g[gap]])
    kind = pa.array(np.repeat(["period", "gap"], [len(g), len(gap)]))
    out = keys.take(pa.array(who)).append_column("kind", kind)
    out = out.append_column("from_at", pa.array(np.concatenate([s, prior[gap]]), pa.int64()))
    out = out.append_column("to_at", pa.array(np.concatenate([e, s[gap]]), pa.int64()))
    yield from out.to_batches()


def cover(df: DataFrame, keys: Sequence[str], start: Column, end: Column, fan: int = 16, cell: int = CELL) -> DataFrame:
    """Periods and gaps of intervals per key, as (keys, kind, from_at, to_at) in the unit of start and end (bigint).

    start and end are whole numbers of any unit (minutes for shifts); cell is the width of a cell in that unit: give
    32 days' worth where it is not minutes, as an interval takes part in every cell it touches. [start, end) must not be empty: rows whose start or end is
    null or where end <= start take no part. Touching intervals join. A null in keys is a key of its own. kind is
    `period` for each longest stretch covered, `gap` for each hole between two periods of a key that follow each
    other. Repeated rows change nothing; an empty table gives no rows. Columns of df besides keys are not read, so
    names like kind or from_at in it do not clash, unless they are keys.
    """
    keys = list(keys)
    rows = df.select(*keys, start.cast("bigint").alias("_start"), end.cast("bigint").alias("_end")).where("_start < _end")
    whole = lambda c: F.call_function("div", c - F.pmod(c, F.lit(cell)), F.lit(cell))
    rows = rows.select("*", F.explode(F.sequence(whole(F.col("_start")), whole(F.col("_end") - 1))).alias("_cell"))
    rows = rows.withColumns({
        "_start": F.greatest("_start", F.col("_cell") * cell), "_end": F.least("_end", (F.col("_cell") + 1) * cell),
    })
    key_fields = [df.select(k).schema[0] for k in keys]
    lists = T.StructType([*key_fields, T.StructField("_cell", T.LongType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("_starts", "_ends"))])
    partial = rows.mapInArrow(_partials(keys), lists).withColumn("_branch", F.pmod(F.spark_partition_id(), F.lit(fan)))
    branch = partial.repartition(*keys, "_cell", "_branch").sortWithinPartitions(*keys, "_cell", "_branch").drop("_branch")
    merged = branch.mapInArrow(_merges(keys), lists)
    final = merged.repartition(*keys).sortWithinPartitions(*keys, "_cell")
    out = T.StructType([*key_fields, T.StructField("kind", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("from_at", "to_at"))])
    return final.mapInArrow(_periods(keys, cell), out)
