"""Groups of sorted rows as they stream through a Python worker, however they fall on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def stream_groups(df: DataFrame, keys: Sequence[str], each: Callable, schema: StructType | str, order: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """each(key tuple, list of row dicts) -> iterable of row dicts, called for every group of keys.

    One shuffle and sort; unlike a grouped Pandas function it builds no frame per group, so millions of small groups
    are cheap. A group is held whole: callers bound its size. Nulls in keys form groups of their own. parts: number of
    partitions, for work that outweighs its input; else Spark chooses.
    """
    keys = list(keys)
    out = df.sparkSession.createDataFrame([], schema).schema
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        held, at, ready = [], None, []

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[c] for r in ready], types.field(c).type) for c in names]
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(out)
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != at:
                    if held:
                        ready.extend(each(at, held))
                        if len(ready) > 20_000:
                            yield flush()
                    held, at = [], key
                held.append(row)
        if held:
            ready.extend(each(at, held))
        if ready:
            yield flush()

    placed = df.repartition(*keys) if parts is None else df.repartition(parts, *keys)
    return placed.sortWithinPartitions(*keys, *order).mapInArrow(run, out)
