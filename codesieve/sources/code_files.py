"""Files of source trees as a table.

Reading has two steps. Rounds of tasks open directories and write names, sizes and times. The scan filters run on that listing, and only then are contents read, spread evenly
over tasks. A tree must be reachable from every executor under the same path.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import deque
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from string import ascii_lowercase

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions.paths import dotted_extension
from codesieve.functions.text import content_hash, decode_text
from codesieve.operators.inventory import rule_language, scannable, supported_extensions
from codesieve.schemas import CODE_FILES, FILE_LISTING
from codesieve.session import shared_folder
from codesieve.settings import DEFAULT_EXCLUDES, MAX_FILE_BYTES, PRUNED_DIRECTORIES

DEFAULT_LISTING_TASKS = 256
#: Directories a task opens before it leaves the others to the next round.
OPENED_AT_ONCE = 512
LISTED_NAMES = [column.split()[0] for column in FILE_LISTING.split(", ")]
LISTED_TYPES = [pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC")]
READ_BYTES = 16 * 1024 * 1024


def _listed(root: str, prune: frozenset[str], most: int):
    """For a task's directories: rows of the files they hold, and of directories left for a next round."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo, opened, rows = deque(), 0, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 6
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, LISTED_TYPES)], ["is_dir", *LISTED_NAMES])

        for given in batches:
            todo.extend(given.column(0).to_pylist())
        while todo and opened < most:
            opened += 1
            folder = todo.popleft()
            try:
                with os.scandir(folder) as entries:
                    for e in entries:
                        if e.is_dir():
                            if e.name not in prune and not e.is_symlink():
                                todo.append(e.path)
                            continue
                        try:
                            info = os.stat(e.path)
                        except OSError:
                            continue
                        rows.append((False, root, e.path, os.path.relpath(e.path, root), info.st_size,
                                     datetime.fromtimestamp(info.st_mtime, timezone.utc)))
                        if len(rows) >= 10_000:
                            yield batch()
            except OSError:
                continue
        for folder in todo:
            rows.append((True, root, folder, None, None, None))
            if len(rows) >= 10_000:
                yield batch()
        yield batch()

    return expand


def list_files(spark: SparkSession, root: str, tasks: int = DEFAULT_LISTING_TASKS,
               prune: Iterable[str] = PRUNED_DIRECTORIES, most: int = OPENED_AT_ONCE) -> DataFrame:
    """Names, sizes and times of all files below ``root``, names with a leading dot or underscore and
    empty files too; links to directories are not followed, and what cannot be read is left out.

    The tree is opened in rounds. Each spreads the directories found so far over the tasks; a task opens
    at most ``most`` of them and those they hold, and leaves the rest to the next round. So neither a
    deep subtree nor a directory of many others stays in one task, and the driver sees the root only.
    """
    root = os.path.abspath(root)
    schema = f"is_dir boolean, {FILE_LISTING}"
    expand = _listed(root, frozenset(prune), most)
    frontier, folders = spark.createDataFrame([(root,)], "file_path string"), []
    while True:
        folders.append(f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}")
        # Dealt by hash: directories of one parent go to different tasks.
        (frontier.repartition(tasks if len(folders) > 1 else 1, "file_path").mapInArrow(expand, schema)
         .write.parquet(folders[-1]))
        frontier = spark.read.schema(schema).parquet(folders[-1]).where("is_dir").select("file_path")
        if frontier.isEmpty():
            return spark.read.schema(schema).parquet(*folders).where("NOT is_dir").drop("is_dir")


def _read_contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def text(path: str) -> str:
        try:
            with open(path, encoding="utf-8", errors="ignore") as file:
                return file.read()
        except OSError:
            return ""

    for batch in batches:
        # A batch lists thousands of files; what is sent back at once is bounded in bytes.
        part = batch["size_bytes"].cumsum() // READ_BYTES
        for _, files in batch.groupby(part):
            yield files.assign(content=files["file_path"].map(text))


def read_contents(listing: DataFrame, partitions: int | None = None) -> DataFrame:
    """Listing with contents: UTF-8, undecodable bytes dropped, newlines unified, empty if a
    file cannot be read. Names are spread by hash first, so one deep directory is no hot task."""
    spread = listing.repartition(*([partitions] if partitions else []), "file_path")
    return spread.mapInPandas(_read_contents, f"{FILE_LISTING}, content string")


def _as_code_files(files: DataFrame) -> DataFrame:
    ext = dotted_extension(F.col("file_path"))
    return files.select("repo_path", "file_path", ext.alias("ext"), rule_language(ext).alias("language"),
                        "size_bytes", "modified_at", "content",
                        content_hash(F.col("content")).alias("content_hash"))


def read_code_files(spark: SparkSession, root: str, excludes: Iterable[str] = DEFAULT_EXCLUDES,
                    cap: int = MAX_FILE_BYTES, tasks: int = DEFAULT_LISTING_TASKS,
                    partitions: int | None = None, land: bool = True) -> DataFrame:
    """``code_files`` of the tree below ``root``, of files up to ``cap`` bytes.

    Contents are read once and written below the shared folder, by language: whatever the jobs
    over the result ask for, and however often, reads that table and only the columns and
    languages it needs. With ``land=False`` every use reads the tree again.
    """
    listing = scannable(list_files(spark, root, tasks), tuple(excludes), cap)
    return read_listed(listing, partitions, land)


def read_listed(listing: DataFrame, partitions: int | None = None, land: bool = True) -> DataFrame:
    """``code_files`` of the files a listing names; no other file is opened."""
    spark, files = listing.sparkSession, _as_code_files(read_contents(listing, partitions))
    if not land:
        return files
    folder = f"{shared_folder(spark)}/code-files-{uuid.uuid4().hex}"
    save_code_files(files, folder)
    return load_code_files(spark, folder).select(*files.columns)


def read_code_files_binary(spark: SparkSession, root: str, excludes: Iterable[str] = DEFAULT_EXCLUDES,
                           cap: int = MAX_FILE_BYTES) -> DataFrame:
    """The same through Spark's binary file source, for object stores. It skips names with a
    leading dot or underscore and empty files. Extensions and the size filter reach the source."""
    base = re.sub("^file:/*", "/", root.rstrip("/"))
    names = {letter: f"[{letter}{letter.upper()}]" for letter in ascii_lowercase}
    endings = ",".join("".join(names.get(c, c) for c in ext) for ext in supported_extensions())
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", f"*{{{endings}}}").load(root).where(F.col("length") <= cap))
    path = F.regexp_replace("path", "^file:/*", "/")
    named = raw.select(F.lit(base).alias("repo_path"), path.alias("file_path"),
                       F.col("length").alias("size_bytes"),
                       F.col("modificationTime").alias("modified_at"), "content")
    kept = scannable(named, tuple(excludes), cap)
    return _as_code_files(kept.withColumn("content", decode_text(F.col("content"))))


def save_code_files(files: DataFrame, path: str) -> None:
    """Writes ``code_files`` below one folder per language: the block rules then read Python
    files only. Rebalancing splits a language that holds most files over many tasks."""
    files.hint("rebalance", "language").write.mode("overwrite").partitionBy("language").parquet(path)


def load_code_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CODE_FILES).parquet(path)
