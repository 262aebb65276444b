"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a target; whole copies of it are taken as often as they fit, and the rest is the
part of its rows whose hash lies below a threshold. The threshold is found without sorting: sizes
are summed by source and hash bucket, and only the bucket the budget ends in is looked at again,
on its next bits, until a single hash value is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.common import WORD, hash60, staged

MOST_COPIES = 3
BITS, LEVEL_BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weight: Column | None = None, most: int = MOST_COPIES) -> DataFrame:
    """One row per source of (source, size): source, source_size, weight, target.

    Targets share the sum of all sizes by weight. No target passes ``most`` times its source; the
    excess goes to the others by weight. Sources run by code point, null last; ``weight`` is an
    expression of their number ``place`` from 0, by default 1, 2, 3, repeating.
    """
    weight = F.col("place") % 3 + 1 if weight is None else weight
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here; none of these windows sees a document.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sums.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", weight.cast("long"))
    before = Window.orderBy(
        F.col("source_size") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    room = placed.select(
        "*", (F.sum("source_size").over(everything)
              - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weights"))
    capped = most * F.col("source_size") * F.col("weights") <= F.col("left") * F.col("weight")
    level = F.min(F.when(~F.col("capped"), F.struct("place_in_order", F.col("left") / F.col("weights")))).over(everything)
    ranked = room.withColumns({
        "capped": capped,
        "place_in_order": F.row_number().over(Window.orderBy(F.col("source_size") / F.col("weight"), "place"))})
    return ranked.withColumn("level", level["col2"]).select(
        "source", "source_size", "weight",
        F.when(F.col("capped"), (most * F.col("source_size")).cast("double"))
        .otherwise(F.col("level") * F.col("weight")).alias("target"))


def _thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, copies, below): rows with hash < below are taken once more than copies.

    ``open`` holds for each source the prefix of the bits settled so far and what of the budget
    remains inside it.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = staged(targets.withColumn("copies", whole.cast("long")).withColumn(
        "budget", F.col("target") - F.col("copies") * F.col("source_size")), "mix-targets")
    open_ = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("rest"))
    for settled in range(0, BITS, LEVEL_BITS):
        shift = BITS - settled - LEVEL_BITS
        inside = sizes.join(open_.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (
            F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix")))
        cells = inside.groupBy("source", "rest", F.shiftright("hash", shift).alias("prefix")).agg(
            F.sum("size").alias("cell"))
        upto = Window.partitionBy("source").orderBy("prefix")
        cells = cells.withColumn("upto", F.sum("cell").over(upto))
        # The first cell that passes the budget; without one all of the prefix is taken.
        cut = cells.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct(
            "prefix", (F.col("rest") - F.col("upto") + F.col("cell")).alias("rest"), "cell")).alias("c"))
        open_ = staged(cut.select("source", "c.prefix", "c.rest", "c.cell"), "mix-level")
        cut = open_
        open_ = cut.select("source", "prefix", "rest")
    # One hash value is left; its rows come in if that ends nearer to the budget.
    below = F.col("prefix") + F.when(F.col("cell") - F.col("rest") < F.col("rest"), 1).otherwise(0)
    cut = cut.select(F.col("source").alias("s"), below.cast("long").alias("below"))
    return budgets.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "copies",
        F.coalesce("below", F.when(F.col("budget") > 0, F.lit(1 << BITS)).otherwise(0).cast("long")).alias("below"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
        size: Column | None = None, weight: Column | None = None) -> DataFrame:
    """All rows of docs with __size, __source_size, __target and __copies, the times to take each.

    Rows of one id share a hash and are taken together. A null source is a source of its own; a row
    of size 0, as a null text, is taken like the rows beside it and adds nothing. The same rows
    always give the same answer. An empty table gives an empty result. All columns of ``docs``
    come through; only names that begin with two underscores are the operator's own.
    """
    size = word_count(F.col("text")) if size is None else size
    sized = docs.withColumns({"__size": size, "__hash": hash60(F.col(id_col))})
    # Slim rows, written once: every level reads these and no text.
    sizes = staged(sized.select(F.col(source_col).alias("source"), F.col("__size").alias("size"),
                                F.col("__hash").alias("hash")), "mix-sizes")
    cuts = _thresholds(sizes, source_targets(sizes, weight)).select(
        F.col("source").alias("__source"), F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"), F.col("copies").alias("__whole"), F.col("below").alias("__below"))
    joined = sized.join(staged(cuts, "mix-cuts"), F.col(source_col).eqNullSafe(F.col("__source")))
    copies = F.col("__whole") + (F.col("__hash") < F.col("__below")).cast("long")
    return joined.withColumn("__copies", copies).drop("__source", "__whole", "__below", "__hash")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    taken = mix(docs, id_col, source_col, **options).where("__copies > 0")
    repeated = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
