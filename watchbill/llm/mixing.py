"""Records of several sources combined so that each contributes a target share of the size.

Pfair scheduling: a source's records form blocks of equal size; block k of a source of weight w is released at slot
floor((k - 1) / w) and due at ceil(k / w). Earliest deadline first over the released blocks gives every block a slot such
that at any moment each source is less than one block away from its share.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchbill.operators.prefix import running_start
from watchbill.sources.tables import written

BLOCKS = 200_000  # blocks of the schedule, which the driver makes, at most; their size follows from the total
LEAST_BLOCK = 2_048  # tokens


def reachable(weights: dict[str, float], limits: dict[str, float], total: float) -> dict[str, float]:
    """Sizes per source, nearest to the weights' shares of total that the limits allow.

    A source whose limit is below its share gets its limit; what it lacks is shared by the others in proportion to
    their weights, until they reach their limits too.
    """
    out, left, open_ = {}, total, dict(weights)
    while open_:
        whole = sum(open_.values())
        short = [s for s, w in open_.items() if limits.get(s, 0) < left * w / whole] if whole > 0 else list(open_)
        if not short:
            return out | {s: left * w / whole for s, w in open_.items()}
        for s in short:
            out[s] = min(limits.get(s, 0), left) if whole > 0 else 0.0
            open_.pop(s)
        left = max(0.0, total - sum(out.values()))
    return out


def schedule(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block from 0) of each slot: earliest deadline first over released blocks."""
    total = sum(blocks.values())
    weight = {s: n / total for s, n in blocks.items() if n}
    release = lambda s, k: math.floor(k * total / blocks[s] + 1e-9)
    due = lambda s, k: math.ceil((k + 1) * total / blocks[s] - 1e-9)
    waiting = [(0, s, 0) for s in sorted(weight)]
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            # ties: the source that has to run again sooner, which is the heavier one
            heapq.heappush(ready, (due(s, k), -weight[s], s, k))
        if not ready:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, k), -weight[s], s, k))
        _, _, s, k = heapq.heappop(ready)
        out.append((s, k))
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, (release(s, k + 1), s, k + 1))
    return out


def mix(items: DataFrame, targets: DataFrame, id: str, source: str, tokens: str, total: int | None = None, blocks: int = BLOCKS) -> DataFrame:
    """(slot, source, id, pass_no, tokens): the mixture, in the order of slot.

    targets has (source, target_share, max_repeat). The mixture's size is `total` tokens, by default the size of all
    items of the sources in targets. Each item comes at most max_repeat times, pass by pass through its whole source in
    an order by hash; a source short of its share at max_repeat gives all it may and the others share what it lacks.
    Items of null or unknown source or without tokens take no part, nor do sources with a null or no positive share;
    a null max_repeat counts as 1. Shares that do not add up to 1 are scaled. No item is cut, so a source can exceed
    its size by part of an item. The schedule has at most about `blocks` blocks of LEAST_BLOCK tokens or more: the fewer
    blocks, the coarser the steps in which sources take turns.
    """
    spark = items.sparkSession
    rows = items.where(f"`{tokens}` > 0").select(F.col(id).alias("id"), F.col(source).alias("source"), F.col(tokens).cast("bigint").alias("tokens"))
    wanted = {r["source"]: r for r in targets.where("source is not null and target_share > 0").collect()}
    rows = written(rows.where(F.col("source").isin(list(wanted))))
    found = rows.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("rows")).collect()
    size = {r["source"]: r["n"] for r in found}
    weights = {s: float(r["target_share"]) for s, r in wanted.items() if s in size}
    limits = {s: float(size[s] * (1 if wanted[s]["max_repeat"] is None else max(0, wanted[s]["max_repeat"]))) for s in weights}
    goal = reachable(weights, limits, float(total if total is not None else sum(size.values())))
    kind = items.select(id).schema[0].dataType.simpleString()
    if not size or sum(goal.values()) <= 0:
        return spark.createDataFrame([], f"slot bigint, source string, {id} {kind}, pass_no int, tokens bigint")
    block = max(LEAST_BLOCK, math.ceil(sum(goal.values()) / blocks))
    plan = schedule({s: math.ceil(g / block) for s, g in goal.items()})
    slots = spark.createDataFrame([(n, s, k) for n, (s, k) in enumerate(plan)], "slot bigint, source string, block bigint")
    sizes = spark.createDataFrame([(s, size[s], int(round(goal[s]))) for s in weights], "source string, size bigint, goal bigint")
    at = running_start(rows, ["source"], ["id", "tokens"], "tokens", "at", sum(r["rows"] for r in found))
    at = at.join(F.broadcast(sizes), "source").where("at < goal")
    passes = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("goal") - 1 - F.col("at")) / F.col("size")))
    out = at.withColumn("pass", F.explode(passes)).withColumn("block", F.floor((F.col("pass") * F.col("size") + F.col("at")) / block))
    out = out.join(slots, ["source", "block"])
    return out.select("slot", "source", F.col("id").alias(id), (F.col("pass") + 1).cast("int").alias("pass_no"), "tokens")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, share, passes, max_repeat, off): what each source of targets really reached, and how far
    off its target that is."""
    sums = mixture.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("pass_no").alias("passes"))
    whole = sums.agg(F.sum("tokens").alias("whole"))
    out = targets.join(sums, "source", "left").crossJoin(F.broadcast(whole))  # whole is one row
    return out.select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("share"), F.coalesce("passes", F.lit(0)).alias("passes"), "max_repeat",
        (F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)) - F.col("target_share")).alias("off"))
