"""Trees compared by hashes, so that only files that differ are read, scanned and compared.

An entry of a manifest is a file with its folder, size, time and content hash. A folder has two hashes: of
its own files, and of all files below it. Each is a sum over hashes of (path, content), so a file goes
into all folders above it in one aggregate with partial sums in the tasks: no folder, however many files
it holds, is gathered in one task, and the order of files does not count. Comparing two trees joins their
folders, which are few next to files; only files of folders whose own hash differs are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.paths import relative_path
from codesieve.operators.diff import scan_diff, with_issue_hash
from codesieve.operators.reuse import spread_key

ENTRY = ("repo_path", "file_path", "folder", "size_bytes", "modified_at", "content_hash")
#: A folder hash has this many sums, of 60 bits of a file's hash each.
LANES = 4
FILE = ["repo_path", "file_path"]
FOLDER = ["repo_path", "folder"]


def folder_of(files: DataFrame) -> Column:
    """Folder of a file relative to its repository; empty for its root."""
    return F.regexp_replace(relative_path(F.col("file_path"), F.col("repo_path")), "/?[^/]*$", "")


def entries(files: DataFrame) -> DataFrame:
    """The manifest of a table of files; contents are not needed once they are hashed."""
    return files.withColumn("folder", folder_of(files)).select(*ENTRY)


def _lanes(text: Column) -> list[Column]:
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, 16 * i + 1, 15), 16, 10).cast("decimal(20,0)") for i in range(LANES)]


def folder_hashes(manifest: DataFrame) -> DataFrame:
    """(repo_path, folder, files, own_hash, tree_hash) of every folder that has files below it.

    ``files`` counts those below; a folder without files of its own has no own hash. A file gives one row per folder above it, merged in its task.
    """
    parts = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/"))
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    named = F.concat_ws("\x1f", "file_path", F.coalesce("content_hash", F.lit("")))
    rows = manifest.select("repo_path", F.col("folder").alias("home"), F.explode(above).alias("folder"), F.array(*_lanes(named)).alias("lane"))
    own = F.col("home") == F.col("folder")
    none = F.lit(0).cast("decimal(20,0)")
    sums = [F.sum(F.col("lane")[i]).alias(f"tree{i}") for i in range(LANES)]
    sums += [F.sum(F.when(own, F.col("lane")[i]).otherwise(none)).alias(f"own{i}") for i in range(LANES)]
    found = rows.groupBy(*FOLDER).agg(F.count(F.lit(1)).alias("files"), F.count_if(own).alias("own_files"), *sums)
    joined = lambda name, n: F.sha2(F.concat_ws(
        ":", n, *[F.col(f"{name}{i}").cast("string") for i in range(LANES)]), 256)
    own_hash = F.when(F.col("own_files") > 0, joined("own", F.col("own_files")))
    return found.select(*FOLDER, "files", own_hash.alias("own_hash"),
                        joined("tree", F.col("files")).alias("tree_hash"))


def changed_folders(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(repo_path, folder, own_changed, files, previous_files) of the folders with a difference below
    them, from the folder hashes of two trees. A folder one tree does not have differs."""
    now, before = current.alias("now"), previous.alias("before")
    both = now.join(before, FOLDER, "full")
    differs = lambda name: ~F.col(f"now.{name}").eqNullSafe(F.col(f"before.{name}"))
    return both.where(differs("tree_hash")).select(
        *FOLDER, differs("own_hash").alias("own_changed"), F.coalesce("now.files", F.lit(0)).alias("files"),
        F.coalesce("before.files", F.lit(0)).alias("previous_files"))


def changed_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(repo_path, file_path, change) of two manifests: ``added``, ``changed`` or ``removed``."""
    opened = changed_folders(folder_hashes(current), folder_hashes(previous)).where("own_changed").select(*FOLDER)

    def inside(manifest: DataFrame) -> DataFrame:
        # A folder may hold a third of all files; the shuffle of both sides lets it be split.
        return manifest.join(spread_key(opened, "folder"), FOLDER, "left_semi").select(*FILE, "content_hash", F.lit(True).alias("there"))

    both = inside(current).alias("now").join(inside(previous).alias("before"), FILE, "full")
    change = (F.when(F.col("before.there").isNull(), "added").when(F.col("now.there").isNull(), "removed")
              .when(~F.col("now.content_hash").eqNullSafe(F.col("before.content_hash")), "changed"))
    return both.select(*FILE, change.alias("change")).where("change IS NOT NULL")


def diff_of_trees(changes: DataFrame, issues: DataFrame, previous: DataFrame) -> DataFrame:
    """The rows of ``scan_diff`` from the issues of the files that changed.

    ``changes`` is what ``changed_files`` gives; ``issues`` are the new findings of its files, ``previous``
    all issues of the scan before. Issues of other files remain, with the fingerprint they had.
    """
    keys = changes.select(*FILE)
    compared = scan_diff(issues, previous.join(keys, FILE, "left_semi"))
    kept = with_issue_hash(previous.join(keys, FILE, "left_anti")).withColumn("status", F.lit("remaining"))
    return compared.unionByName(kept.select(*compared.columns))
