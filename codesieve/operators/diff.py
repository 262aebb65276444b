"""Issues of two scans compared: new, fixed, remaining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.functions.paths import relative_path
from codesieve.operators.line_store import snippet_key

MATCH_KEYS = ("repo_path", "file_path", "rule_id", "snippet_key")


def _with_key(issues: DataFrame) -> DataFrame:
    """Keyed by the hash of the trimmed line. Issues of the line store have it already."""
    return issues if "snippet_key" in issues.columns else issues.withColumn(
        "snippet_key", snippet_key(F.col("code_snippet")))


def issue_hash(ordinal: Column) -> Column:
    """Fingerprint without line numbers: an issue whose line moved keeps it. ``ordinal`` tells
    equal issues of one file apart."""
    path = relative_path(F.col("file_path"), F.col("repo_path"))
    return F.sha2(F.concat_ws("\x1f", "rule_id", path, "snippet_key", ordinal.cast("string")), 256)


def _ordinal(*keys: str) -> Column:
    order = Window.partitionBy(*keys).orderBy("line_start", "line_end", "description")
    return F.row_number().over(order)


def with_issue_hash(issues: DataFrame) -> DataFrame:
    keys = [c for c in ("scan_id",) if c in issues.columns] + list(MATCH_KEYS)
    return (_with_key(issues)
            .withColumn("issue_hash", issue_hash(_ordinal(*keys)))
            .drop("snippet_key"))


def scan_diff(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Current issues as ``new`` or ``remaining`` and lost ones as ``fixed``.

    Both scans meet in one shuffle on the match key: the n-th of several equal issues remains
    if the other scan has at least n. A group lies within one file and rule. Without a previous
    scan all issues are new. Issues that carry the keys of the line store instead of their text are
    compared without it; ``line_store.with_texts`` adds it to the result.
    """
    both = current.withColumn("side", F.lit("current"))
    if previous is not None:
        both = both.unionByName(previous.withColumn("side", F.lit("previous")))
    return diff_of_sides(both)


def diff_of_sides(both: DataFrame) -> DataFrame:
    """``scan_diff`` over issues that carry their ``side``: "current" or "previous"."""
    side = F.col("side")
    # Counting first makes the shuffle on the match key serve the numbering as well.
    group = Window.partitionBy(*MATCH_KEYS)
    counted = _with_key(both).withColumns({
        "in_current": F.count_if(side == "current").over(group),
        "in_previous": F.count_if(side == "previous").over(group),
    }).withColumn("ordinal", _ordinal(*MATCH_KEYS, "side"))
    status = (
        F.when((side == "current") & (F.col("ordinal") <= F.col("in_previous")), "remaining")
        .when(side == "current", "new")
        .when(F.col("ordinal") > F.col("in_current"), "fixed")
    )
    return (
        counted.withColumn("status", status).where(F.col("status").isNotNull())
        .withColumn("issue_hash", issue_hash(F.col("ordinal")))
        .drop("side", "in_current", "in_previous", "ordinal", "snippet_key", "scan_id")
    )
