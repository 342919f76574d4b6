"""Resharding by minimum-cost flow.

Documents lie in old shards; new capacities are as equal as the total allows. Copies of one text stay
together: the unit that moves is a block, all texts of an old shard whose hash falls into one of
``BINS`` bins. Block sizes (at most ``BINS`` times the number of shards rows, whatever the input)
go to the driver; there a flow network from surplus to deficit shards, one unit of cost per byte, is
solved by successive shortest paths, and each arc's flow is filled with whole blocks, largest first.
The few bytes that whole blocks cannot split are evened out by single moves and swaps of blocks. The
table of moved blocks, no larger, is broadcast; all else is one pass over the documents.

Copies of one text always stay together. A text whose copies hold more than an ``OWN_BIN``-th of a
shard has a bin of its own (there are fewer than ``OWN_BIN * shards`` such texts); if they hold more than
a whole shard's share, that shard holds nothing else and the others share the rest equally. Null
texts have no bytes and count as one text; sizes are UTF-8 bytes plus 1. Rows that repeat a doc_id, or
lack one, are rows like any others.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_size

BINS = 1024
OWN_BIN = 8
SLOT_ROWS = 20_000  # ranked in one window, about
FILE_BYTES = 64 << 20  # of text in one file, about


def min_cost_flow(arcs: list[tuple[int, int, int, int]], n: int, source: int, sink: int) -> dict[tuple[int, int], int]:
    """Flow of each arc (from, to, capacity, cost) that carries the most units at the least cost,
    by successive shortest augmenting paths over the residual network."""
    to, room, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, cap, price in arcs:
        for x, y, c, p in ((a, b, cap, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)
    while True:
        best, came, queue, queued = [float("inf")] * n, [-1] * n, deque([source]), [False] * n
        best[source] = 0
        while queue:
            x = queue.popleft()
            queued[x] = False
            for e in out[x]:
                if room[e] > 0 and best[x] + cost[e] < best[to[e]]:
                    best[to[e]], came[to[e]] = best[x] + cost[e], e
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        queue.append(to[e])
        if came[sink] < 0:
            break
        path, x = [], sink
        while x != source:
            path.append(came[x])
            x = to[came[x] ^ 1]
        units = min(room[e] for e in path)
        for e in path:
            room[e] -= units
            room[e ^ 1] += units
    return {(arcs[k][0], arcs[k][1]): room[2 * k + 1] for k in range(len(arcs)) if room[2 * k + 1]}


def transfers(old: list[int], new: list[int]) -> dict[tuple[int, int], int]:
    """Bytes to move between shards so that ``old`` sizes become ``new`` ones at the fewest bytes."""
    n = len(old)
    arcs = [(2 * n, s, old[s], 0) for s in range(n)] + [(n + s, 2 * n + 1, new[s], 0) for s in range(n)]
    arcs += [(s, n + t, old[s], int(s != t)) for s in range(n) for t in range(n)]
    flow = min_cost_flow(arcs, 2 * n + 2, 2 * n, 2 * n + 1)
    return {(a, b - n): units for (a, b), units in flow.items() if a < n and n <= b < 2 * n and a != b - n}


def goals(sizes: dict[tuple[int, int], int], shards: int) -> list[int]:
    """Bytes that each shard should hold: equal ones, but for shards with a block that exceeds an equal
    share: such a block fills its shard, and the others share what is left."""
    goal, left, free = [0] * shards, sum(sizes.values()), set(range(shards))
    for (s, _), size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if len(free) < 2 or size <= left / len(free):
            break
        t = s if s in free else min(free)
        goal[t] = size
        left -= size
        free.remove(t)
    for k, s in enumerate(sorted(free)):
        goal[s] = left // len(free) + (k < left % len(free))
    return goal


def move_blocks(sizes: dict[tuple[int, int], int], shards: int, rounds: int = 4_000) -> dict[tuple[int, int], int]:
    """New shard of each block (old shard, bin) that moves."""
    goal = goals(sizes, shards)
    held = [0] * shards
    for (s, _), size in sizes.items():
        held[s] += size
    place = {block: block[0] for block in sizes}
    own = defaultdict(list)
    for block in sorted(sizes, key=lambda b: (-sizes[b], b)):
        own[block[0]].append(block)
    for (s, t), units in sorted(transfers(held, goal).items()):
        for block in own[s]:
            if place[block] == s and sizes[block] <= units:
                place[block] = t
                units -= sizes[block]
    held = [0] * shards
    for block, s in place.items():
        held[s] += sizes[block]
    inside: list[set] = [set() for _ in range(shards)]
    for block, s in place.items():
        inside[s].add(block)
    for _ in range(rounds):
        most, least = max(range(shards), key=lambda s: held[s] - goal[s]), min(range(shards), key=lambda s: held[s] - goal[s])
        gap = (held[most] - goal[most]) - (held[least] - goal[least])
        if gap <= 1:
            break
        # moving d bytes leaves a gap of |gap - 2 d|: a block, or a block against a smaller one
        a, b = sorted((sizes[x], x) for x in inside[most]), [(0, None), *sorted((sizes[x], x) for x in inside[least])]
        best, k = (gap, None, None), 0
        for size, block in a:
            while k + 1 < len(b) and size - b[k + 1][0] > gap / 2:
                k += 1
            for j in (k, k + 1):
                if j < len(b) and 0 < size - b[j][0] < gap:
                    best = min(best, (abs(gap - 2 * (size - b[j][0])), block, b[j][1]), key=lambda x: x[0])
        if best[1] is None:
            break
        for block, s, t in ((best[1], most, least), (best[2], least, most)):
            if block is not None:
                inside[s].remove(block)
                inside[t].add(block)
                held[s] -= sizes[block]
                held[t] += sizes[block]
                place[block] = t
    return {block: s for block, s in place.items() if s != block[0]}


def reshard(docs: DataFrame, shards: int = 16, old_shard: Column | None = None, bins: int = BINS) -> DataFrame:
    """``docs`` with columns size, text_crc32, old_shard, shard and moved.

    ``old_shard`` gives each row's present shard, 0 to ``shards`` - 1; it must be the same for equal
    texts, and is the text's hash by default. Rows are kept whatever they hold.
    """
    spark = docs.sparkSession
    own = ["size", "text_crc32", "old_shard", "shard", "moved", "_key", "_bin"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own])
    rows = docs.withColumns({"size": text_size() + 1, "text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit(""))), "_key": F.xxhash64("text", F.length("text"))})
    rows = rows.withColumn("old_shard", (F.pmod("_key", F.lit(shards)) if old_shard is None else old_shard).cast("int"))
    groups = rows.groupBy("old_shard", "_key").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy = sorted(r["_key"] for r in groups.filter(F.col("bytes") > total / shards / OWN_BIN).select("_key").distinct().collect())
    of_text = F.pmod(F.xxhash64(F.col("_key"), F.lit(1)), F.lit(bins))
    own_bin = F.array_position(F.lit(heavy).cast("array<bigint>"), F.col("_key")) + bins - 1
    rows = rows.withColumn("_bin", (F.when(own_bin >= bins, own_bin).otherwise(of_text) if heavy else of_text).cast("int"))
    sizes = {(r["old_shard"], r["_bin"]): r["bytes"] for r in rows.groupBy("old_shard", "_bin").agg(F.sum("size").alias("bytes")).collect()}
    moves = spark.createDataFrame([(s, b, t) for (s, b), t in move_blocks(sizes, shards).items()], "old_shard int, _bin int, _to int")
    placed = rows.join(F.broadcast(moves), ["old_shard", "_bin"], "left").withColumn("shard", F.coalesce("_to", "old_shard"))
    return placed.withColumn("moved", F.col("_to").isNotNull()).select(*docs.columns, *own[:-2])


def with_slots(rows: DataFrame, bins: int | None = None) -> DataFrame:
    """Number the rows of each shard from 0 without gaps: rows are ranked inside hash bins of about
    ``SLOT_ROWS`` rows, and a bin's first number is the sum of the counts of the bins before it."""
    from pyspark.sql import Window as W

    if bins is None:
        largest = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        bins = max(16, -(-largest // SLOT_ROWS))
    rows = rows.withColumn("_slot_bin", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(bins)).cast("int"))
    counts = rows.groupBy("shard", "_slot_bin").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.withColumn("_first", F.sum("_n").over(W.partitionBy("shard").orderBy("_slot_bin")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(W.partitionBy("shard", "_slot_bin").orderBy("doc_id", "text_crc32"))
    return rows.withColumn("_rank", rank).join(F.broadcast(first), ["shard", "_slot_bin"]).withColumn("slot", F.col("_first") + F.col("_rank") - 1).drop("_slot_bin", "_rank", "_first")


def rewrite(spark: SparkSession, placed: DataFrame, path: str) -> list[int]:
    """Write the files of every shard that gained or lost rows below ``path`` (``shard=N`` folders)
    and return those shards; the files of the others need no change."""
    found = placed.groupBy("old_shard", "shard", "moved").agg(F.sum("size").alias("bytes")).collect()
    affected = sorted({s for r in found if r["moved"] for s in (r["old_shard"], r["shard"])})
    if affected:
        own = placed.filter(F.col("shard").isin(affected))
        parts = max(8, max(sum(r["bytes"] for r in found if r["shard"] == s) for s in affected) // FILE_BYTES)
        own.repartition("shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts))).write.mode("overwrite").partitionBy("shard").parquet(path)
    return affected
