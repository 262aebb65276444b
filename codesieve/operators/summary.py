"""Counts over issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import lines_of
from codesieve.operators.units import file_keys
from codesieve.settings import (
    LARGE_REPO_FILES,
    MAX_LINE_LENGTH,
    MIN_COMMENT_RATIO,
    SEVERITIES,
)


def issue_summary(issues: DataFrame, *by: str) -> DataFrame:
    """Totals by category, by severity and overall, long form, in one pass.

    ``by`` adds leading grouping columns such as ``scan_id``. Issues are first counted per
    category and severity, combined before the shuffle; the grouping sets then expand those
    few counts and not the issues.
    """
    keys = [F.col(c) for c in by]
    category, severity = F.col("category"), F.col("severity")
    counts = issues.groupBy(*by, "category", "severity").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.groupingSets([keys + [category], keys + [severity], keys], *keys, category, severity)
        .agg(F.grouping_id().alias("level"), F.sum("n").alias("issues"))
        .select(
            *by,
            F.when(category.isNotNull(), "category").when(severity.isNotNull(), "severity")
            .otherwise("total").alias("kind"),
            F.coalesce(category, severity, F.lit("all")).alias("name"),
            "issues")
    )


def count_map(column: str, values: tuple[str, ...]) -> Column:
    """Aggregate: a map value -> count over a closed domain, without the absent ones."""
    entries = [F.struct(F.lit(v).alias("key"), F.count_if(F.col(column) == v).alias("value"))
               for v in values]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"] > 0))


def severity_tabs(diff: DataFrame) -> DataFrame:
    """Open issues (new and remaining) per severity, one row."""
    open_issues = diff.where(F.col("status") != "fixed")
    return open_issues.agg(*[
        F.count_if(F.lower("severity") == s).alias(f"{s}_issues") for s in SEVERITIES])


def diff_overview(diff: DataFrame) -> DataFrame:
    """New, fixed, remaining and the total of the current scan, one row."""
    status = F.col("status")
    return diff.agg(
        F.count_if(status == "new").alias("new_issues"),
        F.count_if(status == "fixed").alias("fixed_issues"),
        F.count_if(status == "remaining").alias("remaining_issues"),
        F.count_if(status != "fixed").alias("total_issues"))


def issues_by_file(issues: DataFrame) -> DataFrame:
    """Per file: number of issues and the issues in line order. A file is capped in size, and
    so is what is collected for it."""
    keys = file_keys(issues)
    found = F.array_sort(F.collect_list(F.struct(
        "line_start", "line_end", "rule_id", "category", "severity", "description")))
    return issues.groupBy(*keys).agg(F.count(F.lit(1)).alias("issues"), found.alias("found"))


def file_metrics(files: DataFrame) -> DataFrame:
    """Long lines and comment ratio per file, computed inside the row."""
    lines = lines_of(F.col("content"))
    comment = F.when(F.col("language") == "python", r"^\s*#").when(
        F.col("language") == "sql", r"^\s*--").otherwise(r"^\s*(//|/\*|\*)")
    return files.select(
        *file_keys(files), "language",
        F.size(lines).cast("long").alias("line_count"),
        F.size(F.filter(lines, lambda x: F.length(x) > MAX_LINE_LENGTH)).cast("long").alias("long_lines"),
        F.size(F.filter(lines, lambda x: F.regexp_like(x, comment))).cast("long").alias("comment_lines"),
    ).withColumn("few_comments", F.col("comment_lines") < F.col("line_count") * MIN_COMMENT_RATIO)


def repo_totals(files: DataFrame) -> DataFrame:
    """Files, bytes and the large-repository flag of each repository."""
    return files.groupBy("repo_path").agg(
        F.count(F.lit(1)).alias("total_files"), F.sum("size_bytes").alias("total_bytes"),
    ).withColumn("large", F.col("total_files") > LARGE_REPO_FILES)
