"""Reuse of earlier findings: knowledge by content hash, cached results, overlays.

A hash may be shared by a third of all files. Findings are one row per hash and come to the join
by a shuffle of their own (``spread_key``), so adaptive execution can split the files of a hot hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.operators.history import latest
from codesieve.operators.units import file_keys
from codesieve.settings import CACHE_TTL_SECONDS

ISSUE_FIELDS = ("category", "severity", "line_start", "line_end", "description", "recommendation")


def spread_key(rows: DataFrame, key: str) -> DataFrame:
    """The same rows under a key the planner does not know to be shuffled already. A join then
    shuffles both sides, which is when adaptive execution splits a hot key of the other side."""
    return rows.withColumn(key, F.concat(key, F.lit("")))


def latest_knowledge(knowledge: DataFrame) -> DataFrame:
    """The valid entry of each hash: the last one saved."""
    return latest(knowledge, ["file_hash"], ["ts", "source"])


def knowledge_hits(files: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Issues of files whose content is known, under the file's current path."""
    keys = file_keys(files)
    entries = latest_knowledge(knowledge).withColumnRenamed("file_hash", "content_hash")
    known = files.select(*keys, "content_hash").join(spread_key(entries, "content_hash"), "content_hash")
    return known.select(*keys, "content_hash", F.inline("issues"))


def knowledge_misses(files: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Files whose content is not known. Of the knowledge only hashes are shuffled; of the files all
    columns given, so give keys where contents are large (``sources.contents.split_files``)."""
    known = knowledge.select(F.col("file_hash").alias("content_hash")).distinct()
    return files.join(spread_key(known, "content_hash"), "content_hash", "left_anti").select(*files.columns)


def one_per_content(files: DataFrame, *also: str) -> DataFrame:
    """One file of each distinct content (and ``also`` columns), the first by path. Copies never
    meet in one task: the choice is an aggregate over paths. The rows given are shuffled to meet
    it; ``sources.contents`` has contents once without that."""
    keys = file_keys(files)
    chosen = files.groupBy("content_hash", *also).agg(
        F.min(F.struct(*keys)).alias("chosen")).select("chosen.*")
    return files.join(chosen, keys, "left_semi")


def knowledge_rows(files: DataFrame, issues: DataFrame, ts: Column, source: str = "llm",
                   catalog_clean: bool = False) -> DataFrame:
    """Knowledge entries for the contents of ``files``.

    ``issues`` are those of the same files. Copies of a content give one entry, collected from
    one file. ``catalog_clean`` also records contents without issues, so they are not analysed
    again.
    """
    keys = file_keys(files)
    chosen = one_per_content(files).select(*keys, "content_hash")
    found = issues.select(*keys, F.struct(*ISSUE_FIELDS).alias("issue"))
    joined = chosen.join(found, keys, "left" if catalog_clean else "inner")
    return joined.groupBy(*keys, "content_hash").agg(
        F.array_sort(F.collect_list("issue")).alias("issues"),
    ).select(F.col("content_hash").alias("file_hash"), "issues", ts.alias("ts"),
             F.lit(source).alias("source"))


def _age_seconds(now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros("ts")) / 1000000


def is_fresh(now: Column, ttl: int = CACHE_TTL_SECONDS) -> Column:
    return _age_seconds(now) < ttl


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column,
                 ttl: int = CACHE_TTL_SECONDS) -> DataFrame:
    """Requests joined to the last cached entry of their key; ``hit`` if it is still valid."""
    entries = latest(cache, ["cache_key"], ["ts", "entry_id"])
    # A null key has no entry; such requests do not meet in one task.
    keyed = requests.where("cache_key IS NOT NULL").join(spread_key(entries, "cache_key"), "cache_key", "left")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in entries.schema if f.name != "cache_key"]
    unkeyed = requests.where("cache_key IS NULL").select("*", *none)
    return keyed.unionByName(unkeyed).withColumn(
        "hit", F.coalesce(is_fresh(now, ttl), F.lit(False)))


def cache_stats(cache: DataFrame, now: Column, ttl: int = CACHE_TTL_SECONDS) -> DataFrame:
    return cache.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(~is_fresh(now, ttl)).alias("expired_entries"),
        F.lit(ttl).cast("long").alias("ttl_seconds"))


def drop_expired(cache: DataFrame, now: Column, ttl: int = CACHE_TTL_SECONDS) -> DataFrame:
    return cache.where(is_fresh(now, ttl))


def overlay(review_issues: DataFrame, rule_issues: DataFrame) -> DataFrame:
    """Per file the issues of the review if it found any, else those of the rules."""
    keys = file_keys(review_issues)
    reviewed = review_issues.select(*keys).distinct()
    return review_issues.unionByName(
        rule_issues.join(reviewed, keys, "left_anti"), allowMissingColumns=True)


def files_without_review(files: DataFrame, review_issues: DataFrame) -> DataFrame:
    keys = file_keys(files)
    return files.join(review_issues.select(*keys).distinct(), keys, "left_anti")
