"""The scan: files to issues, with or without reviews, and a whole run into the store."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.operators.catalog import RULES, Rule
from codesieve.operators.diff import scan_diff
from codesieve.operators.inventory import scannable
from codesieve.operators.line_store import KEYS, distinct_texts, with_keys, with_texts
from codesieve.operators.manifest import FILE, changed_files, diff_of_trees, entries
from codesieve.operators.python_blocks import block_findings, block_issues_of, python_block_issues
from codesieve.operators.reuse import (
    ISSUE_FIELDS,
    files_without_review,
    knowledge_hits,
    knowledge_misses,
    knowledge_rows,
    latest_knowledge,
    spread_key,
)
from codesieve.operators.reviews import normalise
from codesieve.operators.scan_rules import issues_of, rule_findings, scan_rules
from codesieve.operators.units import FILE_KEYS, file_keys
from codesieve.session import configure, written
from codesieve.settings import DEFAULT_EXCLUDES, MAX_FILE_BYTES
from codesieve.sources.code_files import list_files, read_code_files, read_listed
from codesieve.sources.contents import SplitFiles, split_files
from codesieve.sources.store import VERSION, ScanStore


def scan_issues(files: DataFrame, rules: tuple[Rule, ...] = RULES, blocks: bool = True,
                spread: bool = True) -> DataFrame:
    """Issues of all rules over a table of files. Empty files have none."""
    configure(files.sparkSession)
    issues = scan_rules(files, rules)
    return issues.unionByName(python_block_issues(files, spread)) if blocks else issues


def scan_keyed(files: DataFrame, rules: tuple[Rule, ...] = RULES,
               blocks: bool = True) -> tuple[DataFrame, DataFrame]:
    """The issues of ``scan_issues`` with the keys of the line store instead of their text, and the
    texts. Lines with findings are written once, each with its text and all it was found for, so the
    cost of an issue does not depend on the length of its line."""
    lines = written(with_keys(rule_findings(files, rules)), "found-lines")
    issues, texts = issues_of(lines, *KEYS), lines
    if blocks:
        more = written(with_keys(block_findings(files)), "found-lines")
        issues = issues.unionByName(block_issues_of(more, *KEYS))
        texts = texts.select("text_key", "code_snippet").unionByName(more.select("text_key", "code_snippet"))
    return issues, distinct_texts(texts)


def scan_distinct_contents(files: DataFrame, rules: tuple[Rule, ...] = RULES,
                           blocks: bool = True) -> DataFrame:
    """The same issues as ``scan_issues``, with each content scanned once.

    Rules look at language and content only, so copies have equal issues. Contents are written in
    buckets and scanned where they lie; their issues are joined to all files that have them.
    """
    split = split_files(files)
    return _scan_split(split, split.keys, rules, blocks)


def _scan_split(split: SplitFiles, keys: DataFrame, rules: tuple[Rule, ...], blocks: bool = True) -> DataFrame:
    """Issues of the files ``keys`` names. A content that a third of them share is spread."""
    once = split.of_keys(keys).select(F.lit("").alias("repo_path"), F.col("content_key").alias("file_path"), "language", "content")
    found = scan_issues(once, rules, blocks, spread=False)
    fields = [c for c in found.columns if c not in FILE_KEYS]
    found = found.select(F.col("file_path").alias("content_key"), *fields)
    named = keys.select(*file_keys(keys), "content_key")
    return named.join(spread_key(found, "content_key"), "content_key").select(*file_keys(keys), *fields)


def scan_with_reviews(files: DataFrame, knowledge: DataFrame, review_issues: DataFrame,
                      rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each file by the first that applies: findings known for its content, a review that found
    something, the rules. Known contents without findings count as known. It is decided by keys and
    hashes; only then contents are read, those of the files that are left to the rules."""
    return _scan_split_with_reviews(split_files(files), knowledge, review_issues, rules)


def _scan_split_with_reviews(split: SplitFiles, knowledge: DataFrame, review_issues: DataFrame,
                             rules: tuple[Rule, ...]) -> DataFrame:
    keys = file_keys(split.keys)
    # Written once: hits, misses and reviews are read from them several times.
    knowledge = written(latest_knowledge(knowledge), "knowledge")
    reviews = written(normalise(review_issues), "reviews")
    known = knowledge_hits(split.keys, knowledge).drop("content_hash")
    unknown = written(knowledge_misses(split.keys, knowledge), "unknown")
    reviewed = reviews.join(unknown.select(*keys), keys, "left_semi")
    rest = files_without_review(unknown, reviewed)
    return known.unionByName(reviewed).unionByName(_scan_split(split, rest, rules), allowMissingColumns=True)


def diff_changed_files(files: DataFrame, before: DataFrame, previous: DataFrame,
                       rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``scan_diff`` of ``files`` against a scan by the same rules, of which the manifest ``before`` and
    the issues ``previous`` are known. Only files that changed are scanned."""
    changes = written(changed_files(entries(files), before), "changes")
    found = scan_issues(files.join(changes.where("change <> 'removed'"), FILE, "left_semi"), rules)
    return diff_of_trees(changes, found, previous)


def rules_key(rules: tuple[Rule, ...]) -> str:
    """Names what a scan looks for; findings are carried over only between scans by the same rules."""
    parts = [VERSION]
    for r in rules:
        predicate = r.predicate if isinstance(r.predicate, str) else str(r.predicate())
        parts.append(repr((r.rule_id, r.language, r.category, r.severity, r.description, r.recommendation,
                           predicate, r.scope, r.detail, r.ahead)))
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def _scan_since(listing: DataFrame, store: ScanStore, since: str, scan_id: str,
                rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifest, issues and new texts of the listed files. A file of the size and time it had in the
    scan ``since`` is taken to be the same and is not opened; of the others, which are read, those with
    other content are scanned. Issues of the rest are those of ``since``."""
    before = written(store.manifest(since, rules_key(rules)), "manifest")
    stat = [*FILE, "size_bytes", "modified_at"]
    listing = written(listing, "listing")
    same = before.join(listing.select(*stat), stat, "left_semi")
    files = read_listed(listing.join(before.select(*stat), stat, "left_anti"))
    current = written(same.unionByName(entries(files)), "manifest")
    changes = written(changed_files(current, before), "changes")
    scan = F.lit(scan_id).alias("scan_id")
    issues, texts = scan_keyed(files.join(changes.where("change <> 'removed'"), FILE, "left_semi").withColumn("scan_id", scan), rules)
    kept = store.keyed_issues(since).drop("scan_id").join(current.select(*FILE), FILE, "left_semi")
    kept = kept.join(changes.select(*FILE), FILE, "left_anti").withColumn("scan_id", scan)
    return current.withColumn("scan_id", scan), issues.unionByName(kept.select(*issues.columns)), texts


def run_scan(spark: SparkSession, root: str, store: ScanStore, ts: datetime,
             excludes: Iterable[str] = DEFAULT_EXCLUDES, rules: tuple[Rule, ...] = RULES,
             max_file_bytes: int = MAX_FILE_BYTES,
             review: Callable[[DataFrame], DataFrame] | None = None, since: str | None = None) -> str:
    """Scans the tree below ``root`` into the store and returns the scan id.

    ``review`` takes files the store has no knowledge of and gives their review issues; these and
    the known ones come before the rules, and what it finds goes to the knowledge. A scan that
    fails leaves a header with its error, which is raised.

    ``since`` names a stored scan of the same root made without review: files that have not changed
    since are not read, and keep its issues. If it left no manifest or was made by other rules, all
    files are read. Changed files that keep both size and time are missed, as by any tool that trusts these.
    """
    if since is not None and review is not None:
        raise ValueError("a scan with review reads all files")
    scan_id = uuid.uuid4().hex
    try:
        key = None
        if since is not None:
            listing = scannable(list_files(spark, os.path.abspath(root)), tuple(excludes), max_file_bytes)
            files, issues, texts = _scan_since(listing, store, since, scan_id, rules)
            key = rules_key(rules)
        else:
            files = read_code_files(spark, root, excludes, max_file_bytes).withColumn("scan_id", F.lit(scan_id))
            texts = None
            if review is None:
                issues, texts = scan_keyed(files, rules)
                files, key = entries(files).withColumn("scan_id", F.lit(scan_id)), rules_key(rules)
            else:
                knowledge, split = store.knowledge(), split_files(files)
                unknown = split.with_contents(knowledge_misses(split.keys, knowledge))
                found = review(unknown).select("repo_path", "file_path", *ISSUE_FIELDS)
                found = written(found.withColumn("scan_id", F.lit(scan_id)), "review")
                issues = _scan_split_with_reviews(split, knowledge, found, rules)
                store.save_knowledge(knowledge_rows(files, normalise(found), F.lit(ts)))
        store.save_scans(files, issues, F.lit(ts), texts=texts, rules_key=key)
    except Exception as error:
        store.save_failure(scan_id, os.path.abspath(root), F.lit(ts), str(error))
        raise
    return scan_id


def compare_scans(store: ScanStore, current: str, previous: str | None) -> DataFrame:
    """Stored scans compared by their keys; without a previous one all issues are new."""
    before = None if previous is None else store.keyed_issues(previous)
    return with_texts(scan_diff(store.keyed_issues(current), before), store.texts())
