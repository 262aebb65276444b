"""New, fixed and remaining issues as versions of files arrive.

Two streams. The first scans each micro-batch of files and writes one row per version with its issues,
keyed as in the line store, and their texts. The second keeps for every file the issues of its last
version as state and compares the next one with them. The state of a file is bounded by the size cap of
files; it lies in the state store, on disk, and survives a restart with the checkpoint.

Versions of a file are ordered by ``modified_at``, then content hash. One that is not later than the last
one compared is left out, so a batch that is run again after a failure changes nothing. A version with
null content is a file that went: its issues are fixed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from codesieve.operators.catalog import RULES, Rule
from codesieve.operators.diff import issue_hash
from codesieve.plans.scan import scan_keyed
from codesieve.session import configure, written

FILE = ["repo_path", "file_path"]
VERSION = [*FILE, "modified_at", "content_hash"]
#: Fields of an issue in the order equal issues of a file are numbered by.
ISSUE = ("rule_id", "snippet_key", "line_start", "line_end", "description", "category", "severity",
         "recommendation", "text_key")
ISSUE_TYPE = ", ".join(f"{c} {'int' if c.startswith('line') else 'string'}" for c in ISSUE)
VERSIONS = f"repo_path string, file_path string, modified_at timestamp, content_hash string, issues array<struct<{ISSUE_TYPE}>>"
COMPARED = f"repo_path string, file_path string, modified_at long, content_hash string, {ISSUE_TYPE}, ordinal int, status string"
#: State stores that hold more than one variable of a key.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scanned_versions(files: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """One row per version of a file with its issues, and their texts. A version given twice counts once."""
    versions = files.withColumn("content_hash", F.coalesce("content_hash", F.lit(""))).withColumn(
        "scan_id", F.concat_ws(":", F.unix_micros("modified_at").cast("string"), "content_hash"))
    versions = written(versions.dropDuplicates(["scan_id", *FILE]), "versions")
    issues, texts = scan_keyed(versions.where("content IS NOT NULL"), rules)
    of_file = issues.groupBy("scan_id", *FILE).agg(F.sort_array(F.collect_list(F.struct(*ISSUE))).alias("issues"))
    rows = versions.select(*VERSION, "scan_id").join(of_file, ["scan_id", *FILE], "left")
    return rows.select(*VERSION, F.coalesce("issues", F.array().cast(f"array<struct<{ISSUE_TYPE}>>")).alias("issues")), texts


def start_version_scan(files: DataFrame, target: str, checkpoint: str, rules: tuple[Rule, ...] = RULES,
                       available_now: bool = False) -> StreamingQuery:
    """Scans arriving files (``CODE_FILES``); writes ``target``/versions and ``target``/texts by batch."""

    def scan_batch(batch: DataFrame, number: int) -> None:
        versions, texts = scanned_versions(batch, rules)
        texts.write.mode("overwrite").parquet(f"{target}/texts/batch={number}")
        versions.write.mode("overwrite").parquet(f"{target}/versions/batch={number}")

    configure(files.sparkSession)
    writer = files.writeStream.foreachBatch(scan_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_versions(spark: SparkSession, target: str, files_per_trigger: int = 1000) -> DataFrame:
    """The versions ``start_version_scan`` writes, as a stream."""
    return (spark.readStream.schema(VERSIONS).option("maxFilesPerTrigger", files_per_trigger)
            .option("recursiveFileLookup", "true").parquet(f"{target}/versions"))


def texts_of(spark: SparkSession, target: str) -> DataFrame:
    """text_key and code_snippet of every text found so far."""
    texts = spark.read.option("recursiveFileLookup", "true").parquet(f"{target}/texts")
    return texts.select("text_key", "code_snippet").dropDuplicates(["text_key"])


def compare_versions(last: list[tuple], issues: list[tuple]) -> Iterator[tuple[tuple, int, str]]:
    """(issue, ordinal, status) of two versions, issues in the order of ``ISSUE``. The n-th of several
    equal issues remains if the other version has at least n."""
    before, now = Counter(i[:2] for i in last), Counter(i[:2] for i in issues)
    seen: Counter = Counter()
    for issue in issues:
        seen[issue[:2]] += 1
        yield issue, seen[issue[:2]], "remaining" if seen[issue[:2]] <= before[issue[:2]] else "new"
    seen.clear()
    for issue in last:
        seen[issue[:2]] += 1
        if seen[issue[:2]] > now[issue[:2]]:
            yield issue, seen[issue[:2]], "fixed"


class LastVersion(StatefulProcessor):
    """State of a file: when its last version was modified, its hash, and its issues one by one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "modified_at long, content_hash string")
        self.issues = handle.getListState("issues", ISSUE_TYPE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at = tuple(self.at.get()) if self.at.exists() else None
        last = [tuple(i) for i in self.issues.get()] if self.issues.exists() else []
        start = at
        # A batch holds few versions of a file, and of each its issues only.
        for version in sorted(rows, key=lambda r: (r["modified_at"], r["content_hash"])):
            order = (version["modified_at"], version["content_hash"])
            if at is not None and order <= at:
                continue
            issues = [tuple(i[field] for field in ISSUE) for i in version["issues"]]
            for issue, ordinal, status in compare_versions(last, issues):
                yield Row(**dict(zip(VERSION, (*key, *order))), **dict(zip(ISSUE, issue)), ordinal=ordinal, status=status)
            at, last = order, issues
        if at != start:
            self.at.update(at)
            self.issues.put(last) if last else self.issues.clear()

    def close(self) -> None:
        pass


def stream_diff(versions: DataFrame) -> DataFrame:
    """Issues of each arriving version as ``new`` or ``remaining`` and those it lost as ``fixed``, with
    the fingerprints of ``scan_diff`` and the keys of the line store. A first version has new ones only."""
    # Times are compared as whole microseconds, which no time zone touches.
    versions = versions.withColumn("modified_at", F.unix_micros("modified_at"))
    compared = versions.groupBy(*FILE).transformWithState(LastVersion(), COMPARED, "Append", "None")
    return compared.withColumns({"modified_at": F.timestamp_micros("modified_at"),
                                 "issue_hash": issue_hash(F.col("ordinal"))}).drop("ordinal")


def start_version_diff(versions: DataFrame, target: str, checkpoint: str,
                       available_now: bool = False) -> StreamingQuery:
    """Appends ``stream_diff`` below ``target``; each row is written once."""
    versions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    writer = stream_diff(versions).writeStream.format("parquet").outputMode("append").option(
        "path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
