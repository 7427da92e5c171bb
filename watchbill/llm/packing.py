"""Items of varying length combined into containers of fixed capacity.

Items go by a hash of their ids into shards that fill about SHARD_BINS containers. In a shard a best-fit pass in order
of size gives a start; a local search then moves items between underfull containers, or exchanges one for one, two for
one and one for two, whenever that raises the sum of squared fills, until containers run empty or nothing helps. What
is left underfull in all shards is packed again together, level by level.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchbill.operators.grouped import stream_groups
from watchbill.operators.prefix import running_start
from watchbill.sources.tables import written

SHARD_BINS = 400
SHARD_ITEMS = 50_000  # a shard of many small items holds fewer containers
FULL = 0.995  # containers at least this full stay as they are between levels
DONORS = 6  # emptiest containers that give items to the others
WINDOW = 40  # items of a container that are tried as one of two
LEVELS = 4
MAX_KINDS = 1_000  # kinds of containers, which are broadcast


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[list[tuple[int, int]]]:
    """Items (size, number) into containers, large ones first, each into the fullest container with room."""
    bins: list[list[tuple[int, int]]] = []
    room: list[tuple[int, int]] = []  # (room left, container), sorted
    for size, k in sorted(items, reverse=True):
        at = bisect.bisect_left(room, (size, -1))
        if at == len(room):
            bins.append([(size, k)])
            bisect.insort(room, (capacity - size, len(bins) - 1))
        else:
            left, b = room.pop(at)
            bins[b].append((size, k))
            bisect.insort(room, (left - size, b))
    return bins


def improve(bins: list[list[tuple[int, int]]], capacity: int, donors: int = DONORS, window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """Local search: exchanges between underfull containers and the `donors` emptiest ones that raise the squared fills.

    Every exchange makes a fuller container fuller at the cost of an emptier one, so the sum of squared fills grows
    strictly and the search ends.
    """
    bins = [list(b) for b in bins]
    fill = [sum(s for s, _ in b) for b in bins]
    moved = True
    while moved:
        moved = False
        open_ = sorted((i for i in range(len(bins)) if 0 < fill[i] < capacity), key=lambda i: fill[i])
        giving = open_[:donors]
        for b in reversed(open_):
            if fill[b] == capacity or b in giving and len(giving) < 2:
                continue
            for d in giving:
                if d != b and 0 < fill[d] <= fill[b] < capacity and _exchange(bins, fill, b, d, capacity, window):
                    moved = True
    return [b for b in bins if b]


def _exchange(bins, fill, b: int, d: int, capacity: int, window: int) -> bool:
    """The exchange that fills b most from d: a move, one for one, two for one, one for two. False if none helps."""
    slack, mine, theirs = capacity - fill[b], bins[b], sorted(bins[d])
    sizes = [s for s, _ in theirs]
    best, plan = 0, None

    def largest(limit: int, below: int = -1) -> int:
        at = bisect.bisect_right(sizes, limit) - 1
        return at if at >= 0 and at != below else at - 1

    at = largest(slack)
    if at >= 0:
        best, plan = sizes[at], ((), (at,))
    own = sorted(range(len(mine)), key=lambda i: mine[i])
    for n, i in enumerate(own):
        give = mine[i][0]
        at = largest(give + slack)
        if best == slack:
            break
        if at >= 0 and best < sizes[at] - give:
            best, plan = sizes[at] - give, ((i,), (at,))
        for x in range(max(0, len(sizes) - window), len(sizes)):  # two of theirs for one of mine
            y = largest(give + slack - sizes[x], x)
            if y >= 0 and y != x and best < sizes[x] + sizes[y] - give:
                best, plan = sizes[x] + sizes[y] - give, ((i,), (x, y))
        for j in own[n + 1 : n + 1 + window]:  # one of theirs for two of mine
            two = give + mine[j][0]
            at = largest(two + slack)
            if at >= 0 and best < sizes[at] - two:
                best, plan = sizes[at] - two, ((i, j), (at,))
    if not plan or best <= 0:
        return False
    out, in_ = plan
    given, taken = [mine[i] for i in out], [theirs[i] for i in in_]
    bins[b] = [x for i, x in enumerate(mine) if i not in out] + taken
    bins[d] = [x for i, x in enumerate(theirs) if i not in in_] + given
    fill[b] += best
    fill[d] -= best
    return True


def _pack(level: int, donors: int, window: int):
    def run(key, rows):
        capacity, shard = key[1], key[2]
        items = [(r["tokens"], i) for i, r in enumerate(rows)]
        for n, b in enumerate(improve(best_fit(items, capacity), capacity, donors, window)):
            total = sum(s for s, _ in b)
            for _, i in b:
                yield rows[i] | {"bin": ((shard * LEVELS + level) << 20) + n, "filled": total}

    return run


def _kinds(targets: DataFrame, name: str, capacity: str) -> DataFrame:
    """(kind, capacity), the smallest capacity of each kind; more than MAX_KINDS kinds raise an error."""
    kinds = targets.where(f"`{capacity}` > 0 and `{name}` is not null").groupBy(F.col(name).alias("kind")).agg(F.min(capacity).cast("int").alias("capacity"))
    if kinds.limit(MAX_KINDS + 1).count() > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers: pack them in several calls")
    return kinds


def pack(
    items: DataFrame, targets: DataFrame, id: str, tokens: str, name: str = "pack_name", capacity: str = "capacity_tokens", donors: int = DONORS, window: int = WINDOW,
) -> DataFrame:
    """(name, bin, id, piece, start, tokens): where each item lies, for each container kind of `targets`.

    No container holds more than its capacity, every token of every item lies in exactly one container of each kind,
    and no item is split unless it alone is larger than the capacity: then it gives full containers of its own and one
    remainder (piece counts from 1, start is its first token). Items of null or no tokens have nothing to place and
    give no row; repeated ids are items of their own. Kinds without a positive capacity give no rows;
    of several capacities of one kind the smallest counts; more than MAX_KINDS kinds raise an error. bin is unique
    within a kind. The result depends on ids and sizes alone, not on the order of rows. `donors` and `window` bound the
    local search: more of them try more exchanges for somewhat fuller containers.
    """
    kinds = _kinds(targets, name, capacity)
    sized = items.where(f"`{tokens}` > 0").groupBy(F.col(id).alias("id"), F.col(tokens).cast("bigint").alias("size")).agg(F.count("*").alias("n"))
    # repeated rows are told apart by number, so that neither full containers nor shards confuse or gather them
    sized = written(sized.select("id", "size", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy")))
    at = sized.crossJoin(F.broadcast(kinds))  # a stated set of kinds, a handful, against all items
    whole = F.call_function("div", F.col("size"), F.col("capacity"))
    over = at.where("size >= capacity").withColumn("full", whole)
    # full containers of one item: numbered apart from the shards' below, without gaps
    over = running_start(over, ["kind"], ["id", "size", "copy"], "full", "before", sized.count())
    cut = over.select("kind", "capacity", "id", F.posexplode(F.sequence(F.lit(0).cast("bigint"), (F.col("full") - 1) * F.col("capacity"), F.col("capacity"))).alias("p", "start"), "before")
    done = [cut.select("kind", "capacity", "id", (F.col("p") + 1).alias("piece"), "start", F.col("capacity").cast("bigint").alias("tokens"), (-1 - F.col("before") - F.col("p")).alias("bin"))]
    left = F.col("size") % F.col("capacity")
    rest = at.where(left > 0).select("kind", "capacity", "id", (whole + 1).cast("int").alias("piece"), (F.col("size") - left).alias("start"), left.alias("tokens"), "copy")
    columns = ["kind", "capacity", "id", "piece", "start", "tokens"]
    kind = items.select(id).schema[0].dataType.simpleString()
    schema = f"kind string, capacity int, id {kind}, piece int, start bigint, tokens bigint, copy bigint, bin bigint, filled bigint"
    for level in range(LEVELS):
        size = F.greatest(F.sum("tokens") / (F.first("capacity") * SHARD_BINS), F.count("*") / SHARD_ITEMS)
        need = rest.groupBy("kind").agg(F.ceil(size).cast("bigint").alias("shards"))
        shards = {r["kind"]: r["shards"] for r in need.collect()}
        if not shards:
            break
        n = F.create_map(*[F.lit(x) for k, s in shards.items() for x in (k, s)])[F.col("kind")]
        spread = rest.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "copy", F.lit(level)), n))
        packed = stream_groups(spread, ["kind", "capacity", "shard"], _pack(level, donors, window), schema, order=["tokens", "id", "piece", "copy"])
        packed = written(packed)
        last = level == LEVELS - 1 or max(shards.values()) == 1
        done.append((packed if last else packed.where(f"filled >= {FULL} * capacity")).select(*columns, "bin"))
        if last:
            break
        rest = packed.where(f"filled < {FULL} * capacity").select(*columns, "copy")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("kind").alias(name), "bin", F.col("id").alias(id), "piece", "start", "tokens")


def fills(packed: DataFrame, targets: DataFrame, name: str = "pack_name", capacity: str = "capacity_tokens") -> DataFrame:
    """(name, bins, tokens, least_bins, fill) of a packing: least_bins is the fewest that could hold the tokens."""
    sums = packed.groupBy(name).agg(F.countDistinct("bin").alias("bins"), F.sum("tokens").alias("tokens"))
    sizes = _kinds(targets, name, capacity).withColumnsRenamed({"kind": name, "capacity": "_capacity"})
    out = sums.join(sizes, name)
    return out.select(name, "bins", "tokens", F.ceil(F.col("tokens") / F.col("_capacity")).alias("least_bins"), (F.col("tokens") / (F.col("bins") * F.col("_capacity"))).alias("fill"))
