"""Scans, their issues and the knowledge base as parquet tables below one folder.

A scan is saved by writing its issues under a new save id and then its header row with that id;
only issues a header names are read. Issues lie in a fixed number of hash buckets of the scan id,
sorted by it, so the driver lists as many folders for a million scans as for one, and a scan is
found by bucket and by the statistics of its files. Issues carry the keys of the line store; their
texts are a table of their own, one row per text in all scans, and are joined when asked for. A scan may
leave the manifest of its files in buckets of the same kind, so a later one reads only what changed.
``remove_superseded`` rewrites the buckets without the issues of replaced and broken saves.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions.text import iso_time
from codesieve.operators.history import history, latest
from codesieve.operators.inventory import detected_languages
from codesieve.operators.line_store import KEYS, distinct_texts, with_keys, with_texts
from codesieve.operators.manifest import ENTRY
from codesieve.operators.reuse import latest_knowledge, spread_key
from codesieve.operators.summary import count_map
from codesieve.session import written
from codesieve.schemas import ISSUE_COLUMNS, KNOWLEDGE, MANIFEST, SCAN_ISSUES, SCANS, TEXTS
from codesieve.settings import CATEGORIES, SEVERITIES

VERSION = "1.2.0"
BUCKETS = 64


def bucket_of(scan_id: Column) -> Column:
    return F.pmod(F.xxhash64(scan_id), F.lit(BUCKETS)).cast("int")


def scan_headers(files: DataFrame, issues: DataFrame, ts: Column, status: str = "completed",
                 error: str = "") -> DataFrame:
    """One header row per ``scan_id`` with file and issue counts and detected languages.

    Each part is counted before it is joined, so the join has one row per scan on both sides.
    """
    found = issues.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total_issues"),
        count_map("category", CATEGORIES).alias("by_category"),
        count_map("severity", SEVERITIES).alias("by_severity"))
    counted = files.groupBy("scan_id", "repo_path").agg(F.count(F.lit(1)).alias("total_files"))
    languages = detected_languages(
        files.select(F.col("scan_id").alias("repo_path"), "file_path"),
    ).withColumnRenamed("repo_path", "scan_id")
    empty = F.create_map().cast("map<string,bigint>")
    return counted.join(found, "scan_id", "left").join(languages, "scan_id", "left").select(
        "scan_id", ts.alias("ts"), "repo_path", F.lit(VERSION).alias("version"),
        F.lit(status).alias("status"), "total_files",
        F.coalesce("languages", F.array(F.lit("unknown"))).alias("languages"),
        F.coalesce("total_issues", F.lit(0)).alias("total_issues"),
        F.coalesce("by_category", empty).alias("by_category"),
        F.coalesce("by_severity", empty).alias("by_severity"), F.lit(error).alias("error"))


class ScanStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        """The table, empty before the first save."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def save_scans(self, files: DataFrame, issues: DataFrame, ts: Column,
                   status: str = "completed", error: str = "", texts: DataFrame | None = None,
                   rules_key: str | None = None) -> str:
        """Saves the scans of ``files`` with all their issues; a scan saved before is replaced.

        Both tables carry the ``scan_id``. Issues have their text, or its keys next to the table
        ``texts`` (see ``plans.scan.scan_keyed``). Headers are counted from the written issues, so the scan runs once.
        With a ``rules_key`` the files, which then carry ``manifest.ENTRY``, are kept as the scan's manifest.
        """
        save_id = uuid.uuid4().hex
        path = f"{self.folder}/scan_issues"
        if texts is None:
            issues = written(with_keys(issues), "issues")
            texts = distinct_texts(issues)
        self._save_texts(texts)
        columns = [c for c in ISSUE_COLUMNS if c != "code_snippet"]
        rows = issues.withColumn("save_id", F.lit(save_id)).select(*columns, *KEYS, "scan_id", "save_id")
        self._append(rows, path)
        if rules_key is not None:
            listed = files.select(*ENTRY, "scan_id", F.lit(save_id).alias("save_id"), F.lit(rules_key).alias("rules_key"))
            self._append(listed, f"{self.folder}/manifests")
        saved = self._read("scan_issues", SCAN_ISSUES).where(F.col("save_id") == save_id)
        columns = [f.split()[0] for f in SCANS.split(", ")]
        (scan_headers(files, saved, ts, status, error)
         .withColumns({"save_id": F.lit(save_id), "saved_at": F.current_timestamp()})
         .select(*columns).write.mode("append").parquet(f"{self.folder}/scans"))
        return save_id

    def _append(self, rows: DataFrame, path: str) -> None:
        # Rebalancing gathers the rows of a bucket into few files and splits one that is too
        # large for a task.
        rows = rows.withColumn("bucket", bucket_of(F.col("scan_id")))
        (rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "scan_id")
         .write.mode("append").partitionBy("bucket").parquet(path))

    def _save_texts(self, texts: DataFrame) -> None:
        """Adds the texts the store does not have. Two saves at a time may both add one; readers take
        any of them, as they are equal."""
        texts = texts.withColumn("text_bucket", F.substring("text_key", 1, 1))
        known = self._read("texts", TEXTS).select("text_key", "text_bucket")
        (texts.join(known, ["text_bucket", "text_key"], "left_anti").hint("rebalance", "text_bucket")
         .write.mode("append").partitionBy("text_bucket").parquet(f"{self.folder}/texts"))

    def texts(self) -> DataFrame:
        """text_key and code_snippet of every text."""
        return self._read("texts", TEXTS).select("text_key", "code_snippet").dropDuplicates(["text_key"])

    def save_failure(self, scan_id: str, repo_path: str, ts: Column, error: str) -> None:
        """A header of a scan that broke off, with its error and no issues."""
        none = F.create_map().cast("map<string,bigint>")
        (self.spark.range(1).select(
            F.lit(scan_id).alias("scan_id"), F.lit("").alias("save_id"), F.current_timestamp().alias("saved_at"),
            ts.cast("timestamp").alias("ts"), F.lit(repo_path).alias("repo_path"), F.lit(VERSION).alias("version"),
            F.lit("failed").alias("status"), F.lit(0).cast("long").alias("total_files"),
            F.array().cast("array<string>").alias("languages"), F.lit(0).cast("long").alias("total_issues"),
            none.alias("by_category"), none.alias("by_severity"), F.lit(error).alias("error"))
         .write.mode("append").parquet(f"{self.folder}/scans"))

    def remove_superseded(self) -> None:
        """Rewrites every bucket with the issues of valid saves only. To be run while nothing is
        saved; it can be run again if it breaks off."""
        valid = written(self._valid_rows(), "store-valid").withColumn("bucket", bucket_of(F.col("scan_id")))
        (valid.hint("rebalance", "bucket").sortWithinPartitions("bucket", "scan_id")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(f"{self.folder}/scan_issues"))

    def scans(self) -> DataFrame:
        return latest(self._read("scans", SCANS), ["scan_id"], ["saved_at", "save_id"])

    def issues(self, scan_id: str | None = None) -> DataFrame:
        """Issues of the valid save of each scan, with their texts. Asking for one scan reads its bucket only."""
        rows = with_texts(self.keyed_issues(scan_id), self.texts())
        return rows.select(*ISSUE_COLUMNS, "scan_id")

    def keyed_issues(self, scan_id: str | None = None) -> DataFrame:
        """The same with the keys of the line store instead of the texts."""
        return self._valid_rows(scan_id).drop("save_id", "bucket")

    def manifest(self, scan_id: str, rules_key: str) -> DataFrame:
        """Files of the valid save of a scan; empty if it left none or was made by other rules."""
        rows = self._valid_rows(scan_id, "manifests", MANIFEST).where(F.col("rules_key") == rules_key)
        return rows.select(*ENTRY)

    def _valid_rows(self, scan_id: str | None = None, name: str = "scan_issues", schema: str = SCAN_ISSUES) -> DataFrame:
        rows, headers = self._read(name, schema), self.scans()
        if scan_id is not None:
            rows = rows.where((F.col("bucket") == bucket_of(F.lit(scan_id))) & (F.col("scan_id") == scan_id))
            headers = headers.where(F.col("scan_id") == scan_id)
        valid = spread_key(headers.select("scan_id", "save_id"), "scan_id")
        return rows.join(valid, ["scan_id", "save_id"], "left_semi")

    def get_scan(self, scan_id: str) -> DataFrame:
        """A scan's header next to each of its issues; one row of nulls if it has none."""
        header = self.scans().where(F.col("scan_id") == scan_id).withColumn(
            "scan_date", iso_time(F.col("ts")))
        return header.drop("save_id", "saved_at").join(
            self.issues(scan_id).drop("repo_path"), "scan_id", "left")

    def history(self, repo_path: str | None = None, limit: int = 50) -> DataFrame:
        scans = self.scans().withColumn("scan_date", iso_time(F.col("ts")))
        return history(scans.drop("save_id", "saved_at"), repo_path, limit)

    def save_knowledge(self, entries: DataFrame) -> None:
        """Appends entries; the last one of a hash is valid."""
        entries.write.mode("append").parquet(f"{self.folder}/knowledge")

    def knowledge(self) -> DataFrame:
        return latest_knowledge(self._read("knowledge", KNOWLEDGE))
