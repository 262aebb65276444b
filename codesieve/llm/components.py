"""Connected components of a link table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import staged


def _to_least(pairs: DataFrame) -> DataFrame:
    """(u, v, least): each pair with the least v of its u, or u itself if that is less."""
    # One row per u and task before the shuffle; a hub with many links is split by the join.
    least = pairs.groupBy("u").agg(F.min("v").alias("low")).select(
        F.col("u").alias("hub"), F.least("u", "low").alias("least"))
    return pairs.join(least, F.col("u") == F.col("hub")).drop("hub")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u, v), root being the least node reachable.

    Both columns are bigint and not null; the order of a pair and repeats do not matter. Each round
    is written to the shared folder. Rounds grow with the logarithm of the longest path.
    """
    down = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    down, mark = staged(down, "links"), None
    while True:
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        small = _to_least(large)
        # The pair of u itself comes from the pair that holds the least node.
        moved = small.select(F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"),
                             F.col("least").alias("v"))
        down = staged(moved.distinct(), "links")
        sums = down.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == mark:
            return down.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                down.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = sums
