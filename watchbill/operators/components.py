"""Connected components of a graph given by its edges, without a graph on the driver or in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchbill.sources.tables import written

MOST = 100_000  # edges of a group that one task holds


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of each node of edges; component is its smallest node.

    Each round gives every node the smallest label among its neighbours and then the label of that label, so chains
    shorten by half. Labels are written to the shared folder each round, which cuts the lineage. Only labels that
    changed are counted on the driver. Null ends are ignored, loops make a component of one node, an empty table gives
    no rows. More than `rounds` rounds raise an error rather than give a partial result.
    """
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node is not null and other is not null")
    both = written(pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.min("node")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("up"), F.col("component").alias("before"))
        jump = step.select(F.col("node").alias("up"), F.col("up").alias("top"))
        new = written(step.join(jump, "up").select("node", F.least("top", "up").alias("component"), "before"))
        changed = new.where("component <> before").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def joined(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b, whole), read from storage; component is its smallest node.

    whole edges are known to lead to the smallest node of their component and are taken as they are, which costs
    neither a round nor a job; their smallest nodes themselves give no row. Only where others are left do rounds run.
    """
    done = edges.where("whole").select(F.col("a").alias("node"), F.col("b").alias("component"))
    rest = edges.where("not whole")
    return done.unionByName(components(rest)) if rest.limit(1).count() else done


def components_within(edges: DataFrame, within: str, a: str = "a", b: str = "b", most: int | None = None) -> DataFrame:
    """joined() of edges that never lead out of a group of the column within.

    A group of at most `most` (MOST) edges is settled by the task that holds it; the edges of a larger one go through
    the rounds of components, so that no group has to fit into a task.
    """
    most = MOST if most is None else most

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, large = [], None, False

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "whole"])

        def stars() -> list:
            parent: dict[int, int] = {}

            def find(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for x, y in held:
                low, high = sorted((find(x), find(y)))
                parent[high] = low
            return [(x, find(x), True) for x in list(parent) if find(x) != x]

        for one in batches:
            ready = []
            for key, x, y in zip(*(c.to_pylist() for c in one.columns), strict=True):
                if key != at:
                    ready += stars()
                    held, at, large = [], key, False
                if large:
                    ready.append((x, y, False))
                    continue
                held.append((x, y))
                if len(held) > most:
                    ready += [(*e, False) for e in held]
                    held, large = [], True
            yield batch(ready)
        yield batch(stars())

    pairs = edges.select(F.col(within).alias("within"), F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a is not null and b is not null")
    placed = pairs.repartition("within").sortWithinPartitions("within")
    return joined(written(placed.mapInArrow(settle, "a bigint, b bigint, whole boolean")))
