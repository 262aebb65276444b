"""Queries over the given tables, one per operator or job. Each takes (spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions import paths, text
from codesieve.operators import diff, history, inventory, manifest, requests, reuse, reviews, summary
from codesieve.operators.catalog import (
    OPTIONAL_RULES,
    RULES,
    Rule,
    register_rule,
    rules_from_table,
    within_first_lines,
)
from codesieve.operators.line_store import with_texts
from codesieve.operators.python_blocks import python_block_issues
from codesieve.operators.scan_rules import scan_rules, scan_with_context
from codesieve.operators.secrets import secret_lines
from codesieve.operators.snippets import context_snippets
from codesieve.operators.units import code_lines
from codesieve.plans import corpora
from codesieve.plans.corpora import spread_table, table
from codesieve.plans.scan import diff_changed_files, scan_distinct_contents, scan_issues, scan_keyed, scan_with_reviews
from codesieve.schemas import CODE_FILES
from codesieve.session import configure, shared_folder, written
from codesieve.sources.export import export_rows, numbered_report, report_lines, write_csv
from codesieve.sources.store import ScanStore
from codesieve.streaming import versions
from codesieve.streaming.incremental import start_incremental_scan, stream_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = "2024-01-15 12:00:00"


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


def _rules(*prefixes: str) -> tuple[Rule, ...]:
    return tuple(r for r in RULES if r.rule_id.startswith(prefixes))


def _bigint(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("long")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- scans --------------------------------------------------------------------------

@query
def scan_issues_all(spark, sf_dir):
    return scan_issues(corpora.corpus_files(spark, sf_dir))


@query
def rules_python_secrets(spark, sf_dir):
    return scan_rules(corpora.corpus_files(spark, sf_dir), _rules("PY-01", "PY-02"))


@query
def rules_python_blocks(spark, sf_dir):
    return python_block_issues(corpora.corpus_files(spark, sf_dir))


@query
def rules_long_files(spark, sf_dir):
    """All rules over files of 600 lines: credentials past line 500, functions over 50 lines."""
    return scan_issues(corpora.long_files(spark, sf_dir))


@query
def rules_first_lines(spark, sf_dir):
    """Credential rules limited to the first 500 lines, on request."""
    return scan_rules(corpora.long_files(spark, sf_dir), within_first_lines(_rules("PY", "JS-0")))


@query
def rules_python_sql_format(spark, sf_dir):
    """The optional rule, over the corpus with database calls put around Python values."""
    files = corpora.corpus_files(spark, sf_dir)
    changed = F.replace(F.replace("content", F.lit("= 1\n"), F.lit('= db.execute("x" % 1)\n')),
                        F.lit("(src)"), F.lit('.raw(f"{src}")'))
    return scan_rules(files.withColumn("content", changed), OPTIONAL_RULES)


@query
def rules_js(spark, sf_dir):
    return scan_rules(corpora.corpus_files(spark, sf_dir), _rules("JS", "RN"))


@query
def rules_java(spark, sf_dir):
    return scan_rules(corpora.corpus_files(spark, sf_dir), _rules("JV"))


@query
def rules_go(spark, sf_dir):
    return scan_rules(corpora.corpus_files(spark, sf_dir), _rules("GO"))


@query
def rules_rust(spark, sf_dir):
    return scan_rules(corpora.corpus_files(spark, sf_dir), _rules("RS"))


@query
def rules_react_lookahead(spark, sf_dir):
    return scan_rules(corpora.corpus_files(spark, sf_dir), _rules("JS-10", "RN-01", "RN-02"))


@query
def rules_doc_comment(spark, sf_dir):
    return scan_rules(corpora.corpus_files(spark, sf_dir), _rules("JV-10", "GO-07", "RS-08"))


@query
def rules_sql_statements(spark, sf_dir):
    return scan_rules(corpora.corpus_files(spark, sf_dir), _rules("SQ"))


@query
def rules_json_valid(spark, sf_dir):
    return scan_rules(corpora.json_files(spark, sf_dir), _rules("JN-01"))


@query
def rules_json_keys(spark, sf_dir):
    return scan_rules(corpora.json_files(spark, sf_dir), _rules("JN-02"))


@query
def rules_json_depth(spark, sf_dir):
    return scan_rules(corpora.json_files(spark, sf_dir), _rules("JN-04"))


@query
def rules_json_large(spark, sf_dir):
    """Each document's whole text 48 times in a JSON list, so that the longest ones pass the size
    limit of the rule."""
    # The text is escaped once: its JSON form is taken out of a list of one.
    item = F.expr("substring(item, 2, length(item) - 2)")
    files = corpora.document_files(spark, sf_dir).withColumn("item", F.to_json(F.array("content"))).withColumns({
        "language": F.lit("json"),
        "content": F.concat(F.lit("["), F.repeat(F.concat(item, F.lit(",")), F.lit(47)), item, F.lit("]"))}).drop("item")
    return scan_rules(files, _rules("JN-03")).drop("code_snippet")


@query
def rules_custom(spark, sf_dir):
    """Rules a user adds: one from code, one from a table of SQL predicates."""
    extra = register_rule(
        "X-01", "go", "architecture", "info", "Method with receiver", "Review the receiver.",
        lambda: F.startswith("text", F.lit("func (")), rules=())
    rows = table(spark, sf_dir, "region").where(F.col("r_regionkey") == 0).select(
        F.lit("X-02").alias("rule_id"), F.lit("rust").alias("language"),
        F.lit("bug").alias("category"), F.lit("warning").alias("severity"),
        F.lit("Index zero").alias("description"), F.lit("Use first().").alias("recommendation"),
        F.lit("contains(text, '[0]') AND line_no > 1").alias("predicate"), F.lit("line").alias("scope"))
    return scan_rules(corpora.corpus_files(spark, sf_dir), rules_from_table(rows, rules=extra))


@query
def rules_custom_units(spark, sf_dir):
    """Table rules over other units: functions without a return, error checks without one in the next
    seven lines, and repeated JSON keys named ``a``."""
    one = table(spark, sf_dir, "region").where(F.col("r_regionkey") == 0)

    def rule(rule_id: str, language: str, predicate: str, scope: str, ahead: int = 0) -> DataFrame:
        values = {"rule_id": rule_id, "language": language, "predicate": predicate, "scope": scope, "ahead": ahead,
                  "category": "bug", "severity": "warning", "description": "Found", "recommendation": "Look at it"}
        return one.select(*[F.lit(v).alias(k) for k, v in values.items()])

    rows = rule("X-03", "python", "kind = 'function' AND NOT exists(body, l -> l RLIKE '(^|[^a-z])return([^a-z]|$)')", "block")
    rows = rows.unionByName(rule("X-04", "go", "contains(text, 'err != nil') AND NOT contains(ahead, 'return')", "line", 7))
    rows = rows.unionByName(rule("X-05", "json", "text = 'a'", "key"))
    rules = rules_from_table(rows, rules=())
    files = corpora.corpus_files(spark, sf_dir).unionByName(corpora.json_files(spark, sf_dir), allowMissingColumns=True)
    return scan_rules(files, rules).select("file_path", "rule_id", "line_start", "line_end", "code_snippet")


@query
def secrets_in_documents(spark, sf_dir):
    return secret_lines(spread_table(spark, sf_dir, "documents"), "text", "doc_id")


@query
def secrets_in_pages(spark, sf_dir):
    pages = spread_table(spark, sf_dir, "pages").select(
        "page_id", F.replace("html", F.lit("&quot;"), F.lit('"')).alias("text"))
    return secret_lines(pages, "text", "page_id")


@query
def streaming_scan(spark, sf_dir):
    """The corpus, landed twice, scanned as a stream."""
    folder = _scratch(spark, "stream")
    files = corpora.corpus_files(spark, sf_dir).drop("file_no")
    for _ in range(2):
        files.write.mode("append").parquet(f"{folder}/landing")
    stream = stream_files(spark, f"{folder}/landing")
    run = start_incremental_scan(stream, f"{folder}/issues", f"{folder}/checkpoint", available_now=True)
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/issues").drop("batch")


@query
def streaming_diff(spark, sf_dir):
    """Versions of the files of two trees compared as they arrive. Both streams stop after the first
    tree and go on from their checkpoints; files the second does not have arrive without content."""
    folder, columns = _scratch(spark, "stream"), [c.split()[0] for c in CODE_FILES.split(", ")]
    current, previous = _two_trees(spark, sf_dir)
    later = F.col("modified_at") + F.expr("INTERVAL 1 DAY")
    gone = previous.join(current, versions.FILE, "left_anti").withColumns(
        {"content": F.lit(None).cast("string"), "content_hash": F.lit(None).cast("string")})
    for files in (previous, current.unionByName(gone).withColumn("modified_at", later)):
        files.select(*columns).write.mode("append").parquet(f"{folder}/landing")
        arriving = spark.readStream.schema(CODE_FILES).parquet(f"{folder}/landing")
        versions.start_version_scan(arriving, folder, f"{folder}/scan-checkpoint", available_now=True).awaitTermination()
        versions.start_version_diff(versions.stream_versions(spark, folder), f"{folder}/diff", f"{folder}/diff-checkpoint",
                                    available_now=True).awaitTermination()
    compared = with_texts(spark.read.parquet(f"{folder}/diff"), versions.texts_of(spark, folder))
    return compared.select("repo_path", "file_path", "rule_id", "category", "severity", "line_start", "line_end",
                           "description", "code_snippet", "status", "issue_hash")


# --- lines, functions ---------------------------------------------------------------

@query
def numbered_lines(spark, sf_dir):
    files = corpora.document_files(spark, sf_dir).withColumn("language", F.col("doc_id"))
    return code_lines(files).select(
        F.col("language").alias("doc_id"), "line_no", "line")


@query
def context_snippet(spark, sf_dir):
    return scan_with_context(corpora.corpus_files(spark, sf_dir), _rules("JV")).select(
        "file_path", "rule_id", "line_start", "context_start", "context_end", "context")


@query
def context_of_blocks(spark, sf_dir):
    """Lines around the issues of the block rules, which are not found in the line pass."""
    files = corpora.corpus_files(spark, sf_dir)
    return context_snippets(files, python_block_issues(files)).select(
        "file_path", "rule_id", "line_start", "context_start", "context_end", "context")


@query
def text_helpers(spark, sf_dir):
    content = F.col("text")
    data = F.concat(F.encode("text", "UTF-8"), F.when(F.col("lang") == "fr", F.lit(b"\x00")).otherwise(F.lit(b"")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.content_hash(content).alias("content_hash"),
        _bigint(text.count_lines(content)).alias("line_count"),
        text.estimate_tokens(content).alias("tokens"),
        text.is_binary(data).alias("is_binary"),
        text.human_size(F.octet_length(content).cast("long") * (F.col("doc_id") + 1) * 997).alias("size"),
        text.capitalize(F.concat("source", F.upper("lang"))).alias("label"),
        text.capitalize(F.concat("source", F.upper("lang")), lower_tail=False).alias("tail_kept"))


@query
def decoded_text(spark, sf_dir):
    """Bytes with broken sequences and foreign line ends, decoded again."""
    data = F.concat(F.lit(b"\xff"), F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8"),
                    F.lit(b"\xc3"))
    return table(spark, sf_dir, "documents").select("doc_id", text.decode_text(data).alias("text"))


@query
def path_helpers(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", paths.tail_parts(url).alias("tail"),
        paths.relative_path(url, F.regexp_extract(url, "^(https?://[^/]+)", 1)).alias("inside"),
        paths.relative_path(url, F.lit("/srv")).alias("outside"),
        paths.extension(F.regexp_extract(url, "^https?://([^/]+)", 1)).alias("extension"))


@query
def severity_map(spark, sf_dir):
    issues = scan_rules(corpora.corpus_files(spark, sf_dir))
    return issues.select(
        "file_path", "rule_id", text.display_severity(F.col("category")).alias("shown"),
        text.zero_based(F.col("line_start")).alias("first"),
        text.zero_based(F.col("line_end")).alias("last"))


# --- inventory ----------------------------------------------------------------------

@query
def scannable_files(spark, sf_dir):
    return inventory.scannable(corpora.tree_paths(spark, sf_dir)).select("file_path", "size_bytes")


@query
def exclude_globs(spark, sf_dir):
    return inventory.exclude_globs(
        corpora.tree_paths(spark, sf_dir), ("**/node_modules/**", "*/dist/*.py", "*.TXT", "/repo?/*/f[12]?.js"),
    ).select("file_path")


@query
def recent_files(spark, sf_dir):
    now = F.lit("1998-01-01 00:00:00").cast("timestamp")
    return inventory.recent_only(corpora.corpus_files(spark, sf_dir), 365, now).select("file_path")


@query
def language_inventory(spark, sf_dir):
    return inventory.language_inventory(corpora.tree_paths(spark, sf_dir))


@query
def config_languages(spark, sf_dir):
    return inventory.language_inventory(corpora.tree_paths(spark, sf_dir), "config")


@query
def detected_languages(spark, sf_dir):
    return inventory.detected_languages(corpora.tree_paths(spark, sf_dir)).select(
        "repo_path", F.array_join("languages", ",").alias("languages"))


@query
def supported_extensions(spark, sf_dir):
    """Files per analyzed extension, and the language whose rules read it."""
    ext = paths.dotted_extension(F.col("file_path"))
    kept = inventory.filter_supported(corpora.tree_paths(spark, sf_dir)).withColumn("ext", ext)
    return kept.groupBy("ext", inventory.rule_language(F.col("ext")).alias("language")).agg(
        F.count(F.lit(1)).alias("files"))


@query
def first_names(spark, sf_dir):
    return inventory.first_names(corpora.tree_paths(spark, sf_dir), 20).select("file_path")


@query
def repo_size(spark, sf_dir):
    return inventory.repo_size(corpora.tree_paths(spark, sf_dir))


@query
def frameworks(spark, sf_dir):
    return inventory.frameworks(corpora.tree_paths(spark, sf_dir))


@query
def repo_totals(spark, sf_dir):
    return summary.repo_totals(corpora.document_files(spark, sf_dir).withColumn(
        "size_bytes", F.octet_length("content").cast("long")))


@query
def large_repos(spark, sf_dir):
    """Every line item as a file, in two repositories; one is over the limit."""
    name = F.when(F.col("l_linenumber") == 7, "rare").otherwise("main")
    return summary.repo_totals(table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("/lines/"), name).alias("repo_path"), F.col("l_quantity").cast("long").alias("size_bytes")))


@query
def file_metrics(spark, sf_dir):
    files = corpora.corpus_files(spark, sf_dir)
    return summary.file_metrics(files).drop("repo_path")


@query
def long_document_lines(spark, sf_dir):
    files = corpora.document_files(spark, sf_dir).withColumn("language", F.lit("text"))
    return summary.file_metrics(files).select("file_path", "line_count", "long_lines")


# --- summaries, diff, history -------------------------------------------------------

def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the two snapshots, scanned together."""
    return scan_issues(corpora.snapshot_files(spark, sf_dir)).withColumnRenamed("scan_id", "side")


@query
def issue_summary(spark, sf_dir):
    return summary.issue_summary(scan_issues(corpora.corpus_files(spark, sf_dir)))


@query
def issues_by_file(spark, sf_dir):
    found = summary.issues_by_file(scan_issues(corpora.corpus_files(spark, sf_dir)))
    rules = F.array_join(F.transform("found", lambda i: F.concat_ws(":", i["line_start"], i["rule_id"])), " ")
    return found.select("file_path", "issues", rules.alias("found"))


@query
def issue_fingerprints(spark, sf_dir):
    issues = scan_rules(corpora.corpus_files(spark, sf_dir))
    return diff.with_issue_hash(issues).select("file_path", "rule_id", "line_start", "issue_hash")


@query
def scan_diff(spark, sf_dir):
    return diff.diff_of_sides(_snapshots(spark, sf_dir)).drop("recommendation")


@query
def scan_diff_long_lines(spark, sf_dir):
    """Lines of several KB that are only indented anew remain. Their texts are joined last."""
    files = corpora.snapshot_files(spark, sf_dir, padded=True)
    issues, texts = scan_keyed(files, _rules("GO"), blocks=False)
    found = diff.diff_of_sides(issues.withColumnRenamed("scan_id", "side"))
    return with_texts(found, texts).select(
        "file_path", "rule_id", "line_start", "code_snippet", "status", "issue_hash")


def _two_trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files of the current and of the previous scan, landed."""
    files = written(corpora.tree_snapshots(spark, sf_dir), "trees")
    return tuple(files.where(F.col("scan_id") == side).drop("scan_id") for side in ("current", "previous"))


@query
def tree_changes(spark, sf_dir):
    """Files that differ between two trees, found by the hashes of their folders."""
    current, previous = _two_trees(spark, sf_dir)
    return manifest.changed_files(manifest.entries(current), manifest.entries(previous))


@query
def tree_changed_folders(spark, sf_dir):
    """Folders with a difference below them."""
    sides = [manifest.folder_hashes(manifest.entries(files)) for files in _two_trees(spark, sf_dir)]
    return manifest.changed_folders(*sides)


@query
def scan_diff_of_trees(spark, sf_dir):
    """The comparison of two scans, of which the second scans only what changed."""
    current, previous = _two_trees(spark, sf_dir)
    before = written(scan_issues(previous), "issues-before")
    return diff_changed_files(current, manifest.entries(previous), before).drop("recommendation")


@query
def scan_diff_first(spark, sf_dir):
    """Without a previous scan every issue is new."""
    issues = scan_rules(corpora.corpus_files(spark, sf_dir), _rules("GO"))
    return diff.scan_diff(issues, None).select("file_path", "rule_id", "line_start", "status")


@query
def scan_diff_overview(spark, sf_dir):
    return summary.diff_overview(diff.diff_of_sides(_snapshots(spark, sf_dir)))


@query
def issue_severity_tabs(spark, sf_dir):
    return summary.severity_tabs(diff.diff_of_sides(_snapshots(spark, sf_dir)))


@query
def scan_history_topk(spark, sf_dir):
    rows = history.history(corpora.order_scans(spark, sf_dir), "/repo7")
    return rows.select("scan_id", "repo_path", "status", text.iso_time(F.col("ts")).alias("scan_date"),
                       "total_issues")


@query
def latest_scan_per_repo(spark, sf_dir):
    return history.latest_scan_per_repo(corpora.order_scans(spark, sf_dir)).select(
        "scan_id", "repo_path", "status", text.iso_time(F.col("ts")).alias("scan_date"), "total_issues")


@query
def trend(spark, sf_dir):
    return history.trend(corpora.order_scans(spark, sf_dir)).select(
        "scan_id", "repo_path", "total_issues", "previous_issues", "change")


@query
def trend_null_keys(spark, sf_dir):
    """Scans of which some have no time, some no repository, some neither."""
    key = F.col("scan_id")
    scans = corpora.order_scans(spark, sf_dir).withColumns({
        "ts": F.when(key % 7 != 0, F.col("ts")), "repo_path": F.when(key % 5 != 0, F.col("repo_path"))})
    return history.trend(scans).select("scan_id", "repo_path", "total_issues", "previous_issues", "change")


# --- store --------------------------------------------------------------------------

def _saved_snapshots(spark: SparkSession, sf_dir: str) -> ScanStore:
    """Both snapshots of each repository saved, then the current ones again with errors only."""
    store = ScanStore(spark, _scratch(spark, "store"))
    # Written once: each save reads the files for its scan and twice for its headers.
    files = written(corpora.snapshot_files(spark, sf_dir).withColumn(
        "scan_id", F.concat("scan_id", F.replace("repo_path", F.lit("/"), F.lit("-")))), "snapshots")
    ts = F.lit(NOW).cast("timestamp")
    store.save_scans(files, scan_rules(files), ts)
    current = files.where(F.startswith("scan_id", F.lit("current")))
    store.save_scans(current, scan_rules(current).where(F.col("severity") == "error"), ts)
    return store


def _map_text(column: str) -> Column:
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), " ")


@query
def store_scans(spark, sf_dir):
    return _saved_snapshots(spark, sf_dir).scans().select(
        "scan_id", "repo_path", "status", text.iso_time(F.col("ts")).alias("scan_date"), "total_files",
        F.array_join("languages", ",").alias("languages"), "total_issues",
        _map_text("by_category").alias("by_category"), _map_text("by_severity").alias("by_severity"))


@query
def store_issues(spark, sf_dir):
    return _saved_snapshots(spark, sf_dir).issues().drop("recommendation")


@query
def store_get_scan(spark, sf_dir):
    rows = _saved_snapshots(spark, sf_dir).get_scan("current-repo2")
    return rows.select("scan_id", "status", "scan_date", "file_path", "rule_id", "severity", "line_start")


@query
def knowledge_entries(spark, sf_dir):
    """Knowledge from a scan of the corpus, one entry per content, clean contents included."""
    files = corpora.corpus_files(spark, sf_dir)
    entries = reuse.knowledge_rows(files, scan_rules(files, _rules("SQ", "GO")),
                                   F.lit(NOW).cast("timestamp"), "rules", True)
    store = ScanStore(spark, _scratch(spark, "knowledge"))
    store.save_knowledge(entries)
    return store.knowledge().select("file_hash", _bigint(F.size("issues")).alias("issues"), "source")


# --- reuse --------------------------------------------------------------------------

@query
def knowledge_hits(spark, sf_dir):
    files = corpora.document_files(spark, sf_dir)
    return reuse.knowledge_hits(files, corpora.labelled_knowledge(spark, sf_dir)).drop("repo_path")


@query
def knowledge_misses(spark, sf_dir):
    files = corpora.document_files(spark, sf_dir)
    return reuse.knowledge_misses(files, corpora.labelled_knowledge(spark, sf_dir)).select(
        "file_path", "content_hash")


@query
def scan_distinct(spark, sf_dir):
    """Documents read as Rust files; many are exact copies, and each content is scanned once."""
    files = corpora.document_files(spark, sf_dir).withColumn("language", F.lit("rust"))
    return scan_distinct_contents(files, _rules("RS-01", "RS-07"), blocks=False)


@query
def distinct_contents(spark, sf_dir):
    return reuse.one_per_content(corpora.document_files(spark, sf_dir)).select("file_path", "content_hash")


@query
def cache_ttl_lookup(spark, sf_dir):
    entries = corpora.event_requests(spark, sf_dir)
    asked = entries.select(F.col("entry_id").alias("request_id"), "cache_key")
    found = reuse.cache_lookup(asked, entries.select("cache_key", "entry_id", "ts"),
                               F.lit(NOW).cast("timestamp"), 86400 * 20)
    return found.select("request_id", "cache_key", "entry_id", "hit")


@query
def cache_stats(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp")
    return reuse.cache_stats(corpora.event_requests(spark, sf_dir), now)


@query
def cache_cleanup(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp")
    return reuse.drop_expired(corpora.event_requests(spark, sf_dir), now).select("entry_id", "cache_key")


@query
def rate_audit(spark, sf_dir):
    return requests.rate_audit(corpora.dense_requests(spark, sf_dir)).select(
        "entry_id", "provider", "last_minute", "last_hour", "allowed")


@query
def rate_admission(spark, sf_dir):
    """What the limits let through, of providers with a break of two hours now and then."""
    late = F.expr("make_interval(0, 0, 0, 0, 2 * CAST(entry_id div 700 AS int))")
    rows = corpora.dense_requests(spark, sf_dir).withColumn("ts", F.col("ts") + late)
    return requests.admissions(rows).select("entry_id", "provider", "admitted")


# --- reviews ------------------------------------------------------------------------

def _answer_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed and normalised issues for corpus files: every answer is about one of the files, of
    which every third has a review."""
    files = corpora.corpus_files(spark, sf_dir).select("repo_path", "file_path", "file_no")
    answers = corpora.order_answers(spark, sf_dir).select(
        F.expr("CAST(regexp_extract(file_path, '([0-9]+)$', 1) AS long) div 150 * 3").alias("file_no"),
        F.inline(reviews.parse_answer(F.col("response"))))
    return reviews.normalise(files.join(answers, "file_no")).drop("file_no")


@query
def review_overlay(spark, sf_dir):
    rules = scan_rules(corpora.corpus_files(spark, sf_dir), _rules("GO", "RS", "JS-01"))
    return reuse.overlay(_answer_issues(spark, sf_dir), rules).select(
        "file_path", "rule_id", "category", "severity", "line_start", "description")


@query
def scan_with_reuse(spark, sf_dir):
    """The first repository is known from an earlier scan with fewer rules; other files take
    their review's issues if it found any, else those of the rules."""
    files = corpora.corpus_files(spark, sf_dir)
    first = files.where(F.col("repo_path") == "/repo0")
    knowledge = reuse.knowledge_rows(first, scan_rules(first, _rules("GO", "SQ")),
                                     F.lit(NOW).cast("timestamp"), catalog_clean=True)
    return scan_with_reviews(files, knowledge, _answer_issues(spark, sf_dir)).select(
        "file_path", "rule_id", "category", "severity", "line_start", "description")


@query
def files_without_review(spark, sf_dir):
    return reuse.files_without_review(
        corpora.corpus_files(spark, sf_dir), _answer_issues(spark, sf_dir)).select("file_path")


@query
def answers_parsed(spark, sf_dir):
    return corpora.order_answers(spark, sf_dir).select(
        "file_path", F.inline(reviews.parse_answer(F.col("response"))))


@query
def answers_normalised(spark, sf_dir):
    return reviews.normalise(answers_parsed(spark, sf_dir))


def _document_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(
        "source", "doc_id", F.expr("doc_id div 512").alias("block"),
        text.estimate_tokens(F.col("text")).alias("tokens"))
    return reviews.review_batches(files, "source", "block", "doc_id")


@query
def review_batches(spark, sf_dir):
    return _document_batches(spark, sf_dir).select("source", "doc_id", "tokens", "batch")


def _corpus_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpora.corpus_files(spark, sf_dir)
    sized = files.select(
        "repo_path", "file_no", F.expr("file_no div 256").alias("block"),
        text.estimate_tokens(F.col("content")).alias("tokens"))
    placed = reviews.review_batches(sized, "repo_path", "block", "file_no")
    ext = paths.dotted_extension(F.col("file_path"))
    return placed.drop("block", "tokens").join(files, ["repo_path", "file_no"]).select(
        "repo_path", "file_no", "batch", "file_path",
        inventory.review_language(ext).alias("language"), "content")


@query
def batch_prompts(spark, sf_dir):
    prompts = reviews.batch_prompts(_corpus_batches(spark, sf_dir), "repo_path", "file_no")
    return prompts.select("repo_path", "batch", "files", F.sha2("prompt", 256).alias("prompt_hash"))


@query
def single_prompts(spark, sf_dir):
    prompt = reviews.single_prompt(F.col("doc_id").cast("string"), F.col("lang"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(prompt, 256).alias("prompt_hash"))


@query
def batch_answers(spark, sf_dir):
    """Answers for batches of files: SQL files are left out of them, and answers about the
    second repository are broken."""
    batched = _corpus_batches(spark, sf_dir)
    entry = F.concat(F.lit('"'), "file_path", F.lit('": [{"category": "bug", "line_start": '),
                     (F.col("file_no") % 50).cast("string"), F.lit("}]"))
    entries = F.array_join(F.array_sort(F.collect_list(F.when(F.col("language") != "sql", entry))), ", ")
    answers = batched.groupBy("repo_path", "batch").agg(entries.alias("entries")).select(
        "repo_path", "batch", F.concat(
            F.lit("Answer: {"), "entries",
            F.when(F.col("repo_path") == "/repo1", ",").otherwise(""), F.lit("} end")).alias("response"))
    found = reviews.batch_answer_issues(batched, answers, "repo_path")
    return found.select("file_path", "batch", _bigint(F.size("issues")).alias("issues"),
                        F.try_element_at("issues", F.lit(1))["line_start"].alias("line_start"))


# --- exports ------------------------------------------------------------------------

@query
def export_table(spark, sf_dir):
    rows = export_rows(scan_rules(corpora.corpus_files(spark, sf_dir)))
    return rows.toDF(*[c.lower().replace(" ", "_") for c in rows.columns])


@query
def export_csv(spark, sf_dir):
    """The CSV files, read back."""
    path = _scratch(spark, "csv")
    write_csv(scan_rules(corpora.corpus_files(spark, sf_dir), _rules("JV", "PY")), path)
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.toDF(*[c.lower().replace(" ", "_") for c in rows.columns])


@query
def text_report(spark, sf_dir):
    issues = scan_rules(corpora.corpus_files(spark, sf_dir))
    return report_lines(issues, "2024-01-15T12:00:00").withColumn("line_no", _bigint("line_no")).drop("ordinal")


@query
def report_in_order(spark, sf_dir):
    """The lines of a report by number, over issues that are equal: the same SQL statement twice in a
    file, and ``+=`` inside two loops."""
    files = corpora.corpus_files(spark, sf_dir)
    issues = scan_rules(files, _rules("SQ")).unionByName(python_block_issues(files).where("rule_id = 'PY-08'"))
    return numbered_report(issues)


@query
def text_report_reviews(spark, sf_dir):
    """A report over review and rule issues: no rule names in the former, and no category for
    errors."""
    rules = scan_rules(corpora.corpus_files(spark, sf_dir), _rules("GO", "RS", "JS-01"))
    issues = reuse.overlay(_answer_issues(spark, sf_dir), rules).withColumn(
        "category", F.when(F.col("severity") != "error", F.col("category")))
    return report_lines(issues).withColumn("line_no", _bigint("line_no")).drop("ordinal")
