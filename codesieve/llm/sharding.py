"""Resharding with the fewest bytes moved.

Old shard sizes and new capacities make a transport problem between shards; a minimum-cost flow
says how many bytes go from each old shard to each new one, at no cost where they stay. Each old
shard is laid out in hash order and cut at the flows: blocks of the hash range carry the sums, and
only running sums inside a block look at rows. Then the files of every shard that changes are
written anew.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.common import hash60, new_folder, staged

BLOCK_BITS = 10
PIECE_BYTES = 64 << 20
MOST_SHARDS = 4096


def minimum_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost) -> dict[tuple[int, int], int]:
    """Flows {(i, j): amount} that empty all supplies within the capacities at the least cost.

    ``cost(i, j)`` is the cost of a unit. Successive shortest paths with potentials, over shards
    only: no row of data comes here.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities do not hold the data")
    source, sink, size = n + m, n + m + 1, n + m + 2
    to, left, price, out = [], [], [], [[] for _ in range(size)]

    def arc(a: int, b: int, room: int, c: int) -> None:
        for x, y, r, p in ((a, b, room, c), (b, a, 0, -c)):
            out[x].append(len(to))
            to.append(y)
            left.append(r)
            price.append(p)

    for i, amount in enumerate(supply):
        arc(source, i, amount, 0)
    for j, room in enumerate(capacity):
        arc(n + j, sink, room, 0)
    first = len(to)
    for i in range(n):
        for j in range(m):
            arc(i, n + j, supply[i], cost(i, j))
    potential = [0] * size
    while True:
        far, by = [float("inf")] * size, [-1] * size
        far[source], queue = 0, [(0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in out[x]:
                y, step = to[e], d + price[e] + potential[x] - potential[to[e]]
                if left[e] > 0 and step < far[y]:
                    far[y], by[y] = step, e
                    heapq.heappush(queue, (step, y))
        if by[sink] < 0:
            break
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far)]
        path, x = [], sink
        while x != source:
            path.append(by[x])
            x = to[by[x] ^ 1]
        amount = min(left[e] for e in path)
        for e in path:
            left[e] -= amount
            left[e ^ 1] += amount
    arcs = ((i, j, first + 2 * (i * m + j)) for i in range(n) for j in range(m))
    return {(i, j): left[e ^ 1] for i, j, e in arcs if left[e ^ 1]}


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def by_hash(id_col: str, shards: int) -> Column:
    """The layout of a table that was spread over shards by the hash of its id."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(shards)).cast("int")


def text_size(text_col: str) -> Column:
    """UTF-8 bytes and one for the end of the row."""
    return F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1


@dataclass(frozen=True)
class Resharding:
    """rows: docs with __old, __shard, __slot and __size. moved: {(old, new): bytes}."""

    rows: DataFrame
    flows: dict[tuple[int, int], int]
    sizes: list[int]


def plan_resharding(docs: DataFrame, shards: int, old_shards: int, old_shard: Column | None = None,
                    size: Column | None = None, capacities: Sequence[int] | None = None,
                    id_col: str = "doc_id", block_bits: int = BLOCK_BITS) -> Resharding:
    """A new shard and a gapless slot in it for every row.

    ``old_shard`` (0 to old_shards - 1) and ``size`` (1 or more) are expressions over docs, by
    default a spread by id and the size of ``text``; capacities are even by default. Rows go to
    the shard their first byte falls in, so a shard passes its capacity by less than a row for each
    old shard. Null text has size 1. A null id is an id like others; rows of one id are ordered by
    size. An empty table gives no rows. All columns of docs come through; names that begin with
    two underscores are the operator's own.
    """
    if max(shards, old_shards) > MOST_SHARDS:
        raise ValueError(f"the flow is solved on the driver for {MOST_SHARDS} shards at most")
    old_shard = by_hash(id_col, old_shards) if old_shard is None else old_shard
    size = text_size("text") if size is None else size
    rows = docs.withColumns({"__old": old_shard, "__size": size, "__hash": hash60(F.col(id_col))}).withColumn(
        "__block", F.shiftright("__hash", 60 - block_bits).cast("int"))
    # One row per block: old_shards * 2^block_bits at most, whatever the data.
    blocks = staged(rows.groupBy("__old", "__block").agg(F.sum("__size").alias("bytes")), "shard-blocks")
    sums = {r[0]: r[1] for r in blocks.groupBy("__old").agg(F.sum("bytes")).collect()}
    sizes = [sums.get(i, 0) for i in range(old_shards)]
    flows = minimum_cost_flow(sizes, list(capacities or even_capacities(sum(sizes), shards)),
                              lambda i, j: int(i != j))
    cuts, upto = [], {}
    for (i, j), amount in sorted(flows.items()):
        upto[i] = upto.get(i, 0) + amount
        cuts.append((i, upto[i], j))
    spark = docs.sparkSession
    cuts = spark.createDataFrame(cuts, "__old int, upto long, shard int").groupBy("__old").agg(
        F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("__cuts"))
    along = Window.partitionBy("__old").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("__start", F.coalesce(F.sum("bytes").over(along), F.lit(0)))
    starts = staged(starts.withColumn("__piece", (F.col("__start") / PIECE_BYTES).cast("int")).drop("bytes").join(
        F.broadcast(cuts), "__old"), "shard-starts")
    # A piece is a run of blocks of about one file. The whole row goes there, once.
    spread = rows.join(F.broadcast(starts), ["__old", "__block"]).repartition("__old", "__piece")
    block = Window.partitionBy("__old", "__piece", "__block").orderBy("__hash", id_col, "__size")
    place = F.col("__start") + F.sum("__size").over(block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")
    placed = spread.withColumn("__place", place).withColumn("__shard", F.element_at(
        F.filter("__cuts", lambda c: F.col("__place") < c["upto"]), 1)["shard"])
    in_block = Window.partitionBy("__old", "__piece", "__block", "__shard").orderBy("__hash", id_col, "__size")
    placed = placed.withColumn("__slot", F.row_number().over(in_block) - 1)
    return Resharding(placed.drop("__cuts", "__start", "__place", "__hash"), flows, sizes)


def rewrite_shards(plan: Resharding, folder: str) -> DataFrame:
    """Writes the rows to files, one folder per shard, and reads them back with gapless slots.

    A shard is affected when bytes enter or leave it; in a spread from few shards to more all of
    them are. Slots count inside blocks when written; the sums over blocks, a small table, shift
    them on reading.
    """
    plan.rows.write.partitionBy("__shard").option("compression", "zstd").parquet(folder)
    written = _read(plan.rows, folder)
    counts = written.groupBy("__shard", "__old", "__block").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("__shard").orderBy("__old", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__first", F.coalesce(F.sum("n").over(along), F.lit(0))).drop("n")
    starts = staged(starts, "shard-slots")
    return written.join(F.broadcast(starts), ["__shard", "__old", "__block"]).withColumn(
        "__slot", F.col("__slot") + F.col("__first")).drop("__first", "__block", "__piece")


def _read(rows: DataFrame, folder: str) -> DataFrame:
    spark = rows.sparkSession
    return spark.read.schema(rows.schema).parquet(folder)


def reshard(docs: DataFrame, shards: int, old_shards: int, folder: str | None = None, **options) -> DataFrame:
    """Plans and rewrites: docs with __shard, __slot, __old and __size, read from the new files."""
    plan = plan_resharding(docs, shards, old_shards, **options)
    return rewrite_shards(plan, folder or new_folder(docs.sparkSession, "shards"))
