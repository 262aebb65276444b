"""Scan history: newest scans, latest scan per repository, trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesieve.session import written


def history(scans: DataFrame, repo_path: str | None = None, limit: int = 50) -> DataFrame:
    """Newest scans first, at most ``limit``; ties by scan id."""
    if repo_path is not None:
        scans = scans.where(F.col("repo_path") == repo_path)
    return scans.orderBy(F.desc("ts"), "scan_id").limit(limit)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` for each key.

    An aggregate, not a window: each task keeps one row per key before the shuffle, so a key
    that holds a third of the rows costs no more than others.
    """
    others = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*order)).alias("newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "newest.*").select(*rows.columns)


def latest_scan_per_repo(scans: DataFrame) -> DataFrame:
    return latest(scans, ["repo_path"], ["ts", "scan_id"])


def trend(scans: DataFrame) -> DataFrame:
    """Change of the issue total from one scan of a repository to the next, by time and scan id, nulls
    first. Rows without a repository are one repository of their own; no row is lost.

    Scans are sorted into parts by repository, time and id, so a repository, or a day of it, may fill any
    number of parts. ``lag`` runs inside a part; the total before a part comes from one row per part
    and repository.
    """
    order = ("ts", "scan_id")
    sorted_ = scans.repartitionByRange("repo_path", *order).withColumn("part", F.spark_partition_id())
    sorted_ = written(sorted_, "trend")
    ends = sorted_.groupBy("repo_path", "part").agg(F.max_by("total_issues", F.struct(*order)).alias("last"))
    along = Window.partitionBy("repo_path").orderBy("part")
    starts = ends.select(F.col("repo_path").alias("r"), F.col("part").alias("p"), F.lag("last").over(along).alias("before"))
    within = Window.partitionBy("repo_path", "part").orderBy(*order)
    previous = F.when(F.row_number().over(within) == 1, F.col("before")).otherwise(F.lag("total_issues").over(within))
    same = F.col("repo_path").eqNullSafe(F.col("r")) & (F.col("part") == F.col("p"))
    return (
        sorted_.join(starts, same)
        .withColumn("previous_issues", previous)
        .withColumn("change", F.col("total_issues") - F.col("previous_issues"))
        .drop("part", "r", "p", "before")
    )
