"""Diff, history, reuse, batches, answers, requests, store, exports."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codesieve.functions import paths, text
from codesieve.operators import diff, history, inventory, requests, reuse, reviews, summary
from codesieve.operators.scan_rules import scan_rules
from codesieve.schemas import SCAN_ISSUES
from codesieve.sources.export import REPORT_ORDER, export_rows, report_lines, text_report, write_csv, write_report
from codesieve.sources.store import ScanStore, bucket_of

NOW = datetime(2024, 1, 15, 12)


def issues_of(files_of, contents):
    return scan_rules(files_of(contents))


def test_diff_properties(files_of):
    rng = random.Random(3)
    lines = ["a.unwrap()", "println!(user)", "x", "b[1]", "// todo", "  a.unwrap()"]
    old = {f"/r/f{i}.rs": "\n".join(rng.choices(lines, k=30)) for i in range(12)}
    new = {p: "\n".join(l for l in t.split("\n") + ["z[2]"] if rng.random() > 0.2) for p, t in old.items()}
    previous, current = issues_of(files_of, old), issues_of(files_of, new)
    status = Counter(r.status for r in diff.scan_diff(current, previous).collect())
    assert status["new"] + status["remaining"] == current.count()
    assert status["fixed"] + status["remaining"] == previous.count()
    assert min(status.values()) > 0
    same = diff.scan_diff(current, current)
    assert {r.status for r in same.collect()} == {"remaining"} and same.count() == current.count()
    assert {r.status for r in diff.scan_diff(current, None).collect()} == {"new"}
    # The fingerprints say the same as the counts.
    a = {r.issue_hash for r in diff.with_issue_hash(current).collect()}
    b = {r.issue_hash for r in diff.with_issue_hash(previous).collect()}
    assert (len(a - b), len(b - a), len(a & b)) == (status["new"], status["fixed"], status["remaining"])
    card = summary.diff_overview(diff.scan_diff(current, previous)).first()
    assert card.total_issues == current.count() and card.fixed_issues == status["fixed"]


def test_moved_line_remains(files_of):
    before = issues_of(files_of, {"/r/a.rs": "a.unwrap()"})
    after = issues_of(files_of, {"/r/a.rs": "\n\n  a.unwrap()"})
    row = diff.scan_diff(after, before).first()
    assert (row.status, row.line_start) == ("remaining", 3)


def test_summary_totals(files_of):
    issues = issues_of(files_of, {"/r/a.rs": "a.unwrap()\nb[1]\nprintln!(user)", "/r/b.go": "v, _ = f()"})
    rows = {(r.kind, r.name): r.issues for r in summary.issue_summary(issues).collect()}
    assert rows[("total", "all")] == 4 == sum(n for (k, _), n in rows.items() if k == "category")
    assert rows[("severity", "warning")] == 2 and rows[("category", "bug")] == 3
    by_file = {r.file_path: (r.issues, len(r.found)) for r in summary.issues_by_file(issues).collect()}
    assert by_file == {"/r/a.rs": (3, 3), "/r/b.go": (1, 1)}


def test_trend_with_a_hot_repository(spark):
    rng = random.Random(5)
    rows = [(i, "/hot" if rng.random() < 0.6 else f"/r{i % 7}",
             NOW + timedelta(hours=rng.randrange(0, 400, 6)), rng.randrange(50)) for i in range(800)]
    scans = spark.createDataFrame(rows, "scan_id long, repo_path string, ts timestamp, total_issues long")
    found = {r.scan_id: r.previous_issues for r in history.trend(scans).collect()}
    last = {}
    for scan_id, repo, _, total in sorted(rows, key=lambda r: (r[2], r[0])):
        assert found[scan_id] == last.get(repo)
        last[repo] = total
    latest = {r.repo_path: r.scan_id for r in history.latest_scan_per_repo(scans).collect()}
    assert latest == {repo: max((r[2], r[0]) for r in rows if r[1] == repo)[1] for repo in {r[1] for r in rows}}
    assert [r.scan_id for r in history.history(scans, "/hot", 5).collect()] == [
        r[0] for r in sorted((r for r in rows if r[1] == "/hot"), key=lambda r: (-r[2].timestamp(), r[0]))[:5]]


def test_rate_audit(spark):
    rng = random.Random(11)
    start = datetime(2024, 1, 1, 23, 30)
    gaps = [0, 1, 59_999_999, 60_000_000, 3_599_999_999, 3_600_000_000, 3_600_000_001]
    rows, at = [], start
    for i in range(900):
        at = at + timedelta(microseconds=rng.choice(gaps) if rng.random() < 0.05 else rng.randrange(30_000_000))
        rows.append((i, "hot" if rng.random() < 0.7 else "cold", at))
    log = spark.createDataFrame(rows, "id long, provider string, ts timestamp")
    found = {r.id: r for r in requests.rate_audit(log).collect()}
    assert len(found) == len(rows)
    micro = timedelta(microseconds=1)
    for i, provider, ts in rows:
        # Requests at the same instant count for each other.
        ages = [(ts - t) / micro for j, p, t in rows if p == provider and j != i and t <= ts]
        minute, hour = sum(a < 60_000_000 for a in ages), sum(a <= 3_600_000_000 for a in ages)
        assert (found[i].last_minute, found[i].last_hour) == (minute, hour)
        assert found[i].allowed == (hour < 100 and minute < 10)


def plain_admissions(rows, per_minute, per_hour):
    """{id: admitted}: one loop over each provider's requests by time and id."""
    held, out = defaultdict(list), {}
    for i, provider, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        times = held[provider] = [t for t in held[provider] if ts - t <= timedelta(hours=1)]
        out[i] = len(times) < per_hour and sum(ts - t < timedelta(minutes=1) for t in times) < per_minute
        if out[i]:
            times.append(ts)
    return out


@pytest.mark.parametrize("per_minute, per_hour", [(10, 100), (3, 7), (1, 1), (5, 2), (0, 5)])
def test_admissions(spark, per_minute, per_hour):
    """Dense requests, many at one instant, with gaps about the limits and a hot provider."""
    rng = random.Random(per_minute)
    gaps = [0, 0, 0, 1, 59_999_999, 60_000_000, 3_599_999_999, 3_600_000_000, 3_600_000_001]
    rows, at = [], datetime(2024, 1, 1, 23, 30)
    for i in rng.sample(range(2500), 2500):
        at = at + timedelta(microseconds=rng.choice(gaps) if rng.random() < 0.1 else rng.randrange(12_000_000))
        rows.append((i, rng.choice(["hot", "hot", "cold", None]), at))
    log = spark.createDataFrame([*rows, (9999, "hot", None)], "entry_id long, provider string, ts timestamp")
    found = {r.entry_id: r.admitted for r in requests.admissions(
        log, per_minute=per_minute, per_hour=per_hour).collect()}
    assert found.pop(9999) is False
    assert found == plain_admissions(rows, per_minute, per_hour)
    assert requests.admissions(log.limit(0)).count() == 0


def test_trend_of_any_keys(spark):
    """Null times and repositories, and a day that fills many parts."""
    rng = random.Random(5)
    day = datetime(2024, 1, 1)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, day, day + timedelta(hours=rng.randrange(40))]),
             rng.choice([None, 1, 5, 9])) for i in range(900)]
    scans = spark.createDataFrame(rows, "scan_id long, repo_path string, ts timestamp, total_issues long")
    found = {r.scan_id: r for r in history.trend(scans).collect()}
    last = {}
    for i, repo, ts, total in sorted(rows, key=lambda r: (r[2] is not None, r[2] or day, r[0])):
        before = last.get(repo)
        change = None if total is None or before is None else total - before
        assert (found[i].repo_path, found[i].previous_issues, found[i].change) == (repo, before, change)
        last[repo] = total
    assert len(found) == len(rows)


def greedy(sizes, max_files=5, max_tokens=6000):
    batch, files, tokens, out = 0, 0, 0, []
    for size in sizes:
        if not files or files >= max_files or tokens + size > max_tokens:
            batch, files, tokens = batch + 1, 0, 0
        files, tokens = files + 1, tokens + size
        out.append(batch)
    return out


@pytest.mark.parametrize("block_size,part,superblock", [
    (1, 5, 2), (2, 6, 3), (7, 5, 256), (64, 13, 4), (1000, 512, 256), (3, 100, 1)])
def test_batches_equal_one_walk(spark, monkeypatch, block_size, part, superblock):
    monkeypatch.setattr(reviews, "BLOCK_FILES", part)
    monkeypatch.setattr(reviews, "SUPERBLOCK", superblock)
    rng = random.Random(block_size)
    rows = []
    for group in ("a", "b", "c"):
        for i in range(300):
            rows.append((group, i, i // block_size, rng.choice([0, 1, 900, 1500, 3000, 6000, 6001, 9000])))
    files = spark.createDataFrame(rows, "repo string, no long, block long, tokens long")
    found = {(r.repo, r.no): r.batch for r in reviews.review_batches(files, "repo", "block", "no").collect()}
    for group in ("a", "b", "c"):
        expected = greedy([r[3] for r in rows if r[0] == group])
        assert [found[(group, i)] for i in range(300)] == expected
    plan = reviews.review_batches(files, "repo", "block", "no")._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan


def test_unbounded_blocks_are_refused(spark, monkeypatch):
    monkeypatch.setattr(reviews, "MOST_IN_BLOCK", 10)
    files = spark.range(11).select(F.lit("r").alias("repo"), F.col("id").alias("no"), F.lit(0).alias("block"), F.lit(1).alias("tokens"))
    with pytest.raises(Exception, match="more files than a task"):
        reviews.review_batches(files, "repo", "block", "no").collect()


def test_prompts(spark):
    df = spark.createDataFrame([("r", 1, 1, "/a.py", "python", "x = {1}"), ("r", 2, 1, "/b.js", "javascript", "y")],
                               "repo string, no long, batch long, file_path string, language string, content string")
    single = df.select(reviews.single_prompt(F.col("file_path"), F.col("language"), F.col("content"))).first()[0]
    assert "the following python code" in single and "```python\nx = {1}\n```" in single and '  {\n    "category"' in single
    prompt = reviews.batch_prompts(df, "repo", "no").first().prompt
    assert "\n--- File 1: /a.py (python) ---\n```python\nx = {1}\n```\n\n--- File 2: /b.js (javascript) ---\n" in prompt


def test_answers(spark):
    item = '{"category": "BUG", "severity": "Error", "line_start": 3, "description": "d"}'
    cases = {
        f"Sure: [{item}] done": 1, f'{{"issues": [{item}, {item}]}}': 2, "[]": 0, f"[{item}": 0, "": 0, "none": 0,
        "[1]": 0, f"[1, {item}]": 1, item: 0, f"see [1] and [{item}]": 0, f"text\n[\n{item}\n]\n": 1, '{"a": []}': 0,
        '{"issues": "x"}': 0,
    }
    df = spark.createDataFrame([(k,) for k in cases], "response string")
    for r in df.select("response", reviews.parse_answer(F.col("response")).alias("i")).collect():
        assert len(r.i) == cases[r.response], r.response
    parsed = df.select(F.inline(reviews.parse_answer(F.col("response"))))
    row = reviews.normalise(parsed).first()
    assert (row.category, row.severity, row.line_start, row.line_end, row.recommendation) == ("bug", "error", 3, 1, "")
    odd = spark.createDataFrame([("style", "fatal", None, None, None, None)], parsed.schema)
    row = reviews.normalise(odd).first()
    assert tuple(row) == ("maintainability", "info", 1, 1, "Issue detected by LLM", "")


def test_batch_answers(spark):
    batched = spark.createDataFrame(
        [("r", 1, "/a"), ("r", 1, "/b"), ("r", 2, "/c"), ("r", 3, "/d")], "repo string, batch long, file_path string")
    answers = spark.createDataFrame(
        [("r", 1, 'ok {"/a": [{"category": "bug"}], "/z": []} bye'), ("r", 2, '{"/c": [')],
        "repo string, batch long, response string")
    rows = reviews.batch_answer_issues(batched, answers, "repo").collect()
    assert {r.file_path: len(r.issues) for r in rows} == {"/a": 1, "/b": 0, "/c": 0, "/d": 0}


def test_knowledge_and_copies(files_of, spark):
    hot = "db.Query(a + b)"
    contents = {f"/r/copy{i}.go": hot for i in range(50)} | {"/r/clean.go": "x", "/r/other.go": "v, _ = f()"}
    files = files_of(contents)
    ts = F.lit(NOW)
    assert reuse.one_per_content(files).count() == 3
    entries = reuse.knowledge_rows(files, scan_rules(files), ts)
    assert sorted(len(r.issues) for r in entries.collect()) == [1, 1]
    clean = reuse.knowledge_rows(files, scan_rules(files), ts, catalog_clean=True)
    assert sorted(len(r.issues) for r in clean.collect()) == [0, 1, 1]
    later = entries.withColumns({"ts": F.col("ts") + F.expr("INTERVAL 1 DAY"), "issues": F.slice("issues", 1, 0)})
    hits = reuse.knowledge_hits(files, entries)
    assert hits.count() == 51 and {r.file_path for r in hits.collect()} == set(contents) - {"/r/clean.go"}
    assert reuse.knowledge_hits(files, entries.unionByName(later)).count() == 0
    assert [r.file_path for r in reuse.knowledge_misses(files, entries).collect()] == ["/r/clean.go"]


def test_distinct_contents_scan_alike(files_of):
    from codesieve.plans.scan import scan_distinct_contents, scan_issues

    body = "for a in b:\n    s += eval(a)\n"
    contents = {f"/r/{i}.py": body for i in range(30)} | {"/r/a.rs": "a.unwrap()", "/r/b.go": "a.unwrap()", "/r/c.rs": "x"}
    files = files_of(contents).unionByName(files_of({"/r/0.py": body, "/r/a.rs": "b[0]"}, repo="/q"))
    plain = sorted(map(repr, scan_issues(files).collect()))
    assert sorted(map(repr, scan_distinct_contents(files).collect())) == plain and len(plain) == 64


def test_hot_keys_are_split(spark):
    """A hash that most files share: adaptive execution splits its files, which are read once."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        files = spark.range(60_000, numPartitions=8).select(
            F.lit("/r").alias("repo_path"), F.concat(F.lit("/r/"), F.col("id").cast("string")).alias("file_path"),
            F.when(F.col("id") % 10 > 0, "hot").otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("content_hash"))
        known = files.where("content_hash = 'hot'").limit(1).select(F.col("content_hash").alias("file_hash"), F.array(
            F.struct(F.lit("bug").alias("category"), F.lit("error").alias("severity"))).alias("issues"),
            F.lit(NOW).alias("ts"), F.lit("s").alias("source"))
        hits = reuse.knowledge_hits(files, known)
        assert hits.count() == 54_000 and reuse.knowledge_misses(files, known).count() == 6_000
        hits.write.format("noop").mode("overwrite").save()
        rows = hits.collect()
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert len(rows) == 54_000 and "skew=true" in plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_overlay(files_of, spark):
    files = files_of({"/r/a.go": "v, _ = f()", "/r/b.go": "v, _ = f()"})
    rules = scan_rules(files)
    review = spark.createDataFrame([("/r", "/r/a.go", "bug", "info", 1, 1, "d", "r")],
                                   "repo_path string, file_path string, category string, severity string, "
                                   "line_start int, line_end int, description string, recommendation string")
    rows = {(r.file_path, r.description) for r in reuse.overlay(review, rules).collect()}
    assert rows == {("/r/a.go", "d"), ("/r/b.go", "Error value ignored")}
    assert [r.file_path for r in reuse.files_without_review(files, review).collect()] == ["/r/b.go"]


def test_cache(spark):
    cache = spark.createDataFrame(
        [("a", 1, NOW - timedelta(seconds=3600)), ("b", 2, NOW - timedelta(seconds=3599)),
         ("c", 3, NOW - timedelta(days=1)), ("c", 4, NOW)], "cache_key string, entry_id long, ts timestamp")
    asked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "cache_key string, id long")
    found = {r.cache_key: (r.entry_id, r.hit) for r in reuse.cache_lookup(asked, cache, F.lit(NOW)).collect()}
    assert found == {"a": (1, False), "b": (2, True), "c": (4, True), "d": (None, False)}
    assert reuse.cache_stats(cache, F.lit(NOW)).first().expired_entries == 2
    assert reuse.drop_expired(cache, F.lit(NOW)).count() == 2


def test_store(files_of, spark, tmp_path):
    store = ScanStore(spark, str(tmp_path / "store"))
    assert store.history().count() == 0 and store.issues().count() == 0 and store.knowledge().count() == 0
    files = files_of({"/r/a.go": "v, _ = f()\nv, _ = f()", "/r/b.py": ""}).withColumn("scan_id", F.lit("s1"))
    issues = scan_rules(files)
    store.save_scans(files, issues, F.lit(NOW))
    row = store.scans().first()
    assert (row.total_files, row.total_issues, row.languages, row.by_category) == (2, 2, ["python"], {"bug": 2})
    assert row.version == "1.2.0" and row.status == "completed" and row.error == ""
    # Saved again without issues: the old ones are gone.
    store.save_scans(files, issues.limit(0), F.lit(NOW))
    assert store.issues("s1").count() == 0 and store.scans().count() == 1
    assert store.scans().first().total_issues == 0
    # A save that lost its header is not seen.
    issues.withColumns({"save_id": F.lit("lost"), "bucket": bucket_of(F.col("scan_id"))}).write.mode("append").partitionBy(
        "bucket").parquet(f"{store.folder}/scan_issues")
    assert store.issues("s1").count() == 0
    row = store.get_scan("s1").first()
    assert row.scan_date == "2024-01-15T12:00:00" and row.file_path is None
    store.save_scans(files, issues, F.lit(NOW))
    store.save_failure("s2", "/r", F.lit(NOW), "no such tree")
    assert [(r.scan_id, r.status, r.error) for r in store.history().collect()] == [
        ("s1", "completed", ""), ("s2", "failed", "no such tree")]
    everything = store._read("scan_issues", SCAN_ISSUES)
    assert everything.count() == 6
    store.remove_superseded()
    assert store._read("scan_issues", SCAN_ISSUES).count() == 2 == store.issues("s1").count()
    assert store.get_scan("nope").count() == 0
    assert store.history("/r", 1).count() == 1 and store.history("/x").count() == 0


def test_exports(files_of, tmp_path):
    issues = issues_of(files_of, {"/r/b.go": 'v, _ = f()\ntoken="abcdefgh"', "/r/a.json": '{"q\\"x,":1,"k":1,"k":2}'})
    write_csv(issues, str(tmp_path / "csv"))
    spark = issues.sparkSession
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == ["Category", "Severity", "File", "Line Start", "Line End", "Description", "Recommendation"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, export_rows(issues).collect()))
    write_csv(issues.limit(0), str(tmp_path / "none"))
    assert [r.value for r in spark.read.text(str(tmp_path / "none")).collect()] == ["No issues found"]
    expected = [
        "Code Scan Report", "================", "Total Issues: 3", "Scan Date: D", "",
        "Category: BUG", "-------------",
        "[WARNING] /r/a.json:1", "Description: Duplicate key 'k' found in JSON",
        "Recommendation: Remove duplicate keys. The last occurrence will override previous ones.", "",
        "[WARNING] /r/b.go:1", "Description: Error value ignored",
        "Recommendation: Always check error return values in Go.", "", "",
        "Category: SECURITY", "------------------",
        "[ERROR] /r/b.go:2", "Description: Potential hardcoded credential detected",
        "Recommendation: Use environment variables or secure configuration management for credentials.", "", ""]
    assert [r.line for r in text_report(issues, "D").collect()] == expected
    write_report(issues, str(tmp_path / "report"), "markdown", "D")
    parts = sorted((tmp_path / "report").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "\n".join(expected) + "\n"
    empty = [r.line for r in text_report(issues.limit(0)).collect()]
    assert empty[2:] == ["Total Issues: 0", "Scan Date: Unknown", "", "No issues found."]
    with pytest.raises(ValueError):
        write_report(issues, "x", "html")
    assert report_lines(issues).select(*REPORT_ORDER).distinct().count() == len(expected)


def test_paths(spark):
    names = {"a.tar.gz": "gz", ".bashrc": "", ".x.py": "py", "a.": "", "a": "", "d.e/f": "", "A.PY": "PY"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.e for r in df.select("n", paths.extension(F.col("n")).alias("e")).collect()} == names
    tails = {"a/b/c/d": "b/c/d", "a\\b\\c\\d": "b/c/d", "a": "a", "a/b": "a/b"}
    df = spark.createDataFrame([(n,) for n in tails], "n string")
    assert {r.n: r.t for r in df.select("n", paths.tail_parts(F.col("n")).alias("t")).collect()} == tails
    df = spark.createDataFrame([("/a/b", "/a"), ("/ab/c", "/a"), ("/a/b", "/a/"), ("/a", "/a")], "p string, b string")
    assert [r[0] for r in df.select(paths.relative_path(F.col("p"), F.col("b"))).collect()] == ["b", "/ab/c", "b", "/a"]


def test_globs(spark):
    from fnmatch import fnmatchcase

    names = ["/r/node_modules/a.py", "node_modules/a.py", "/r/x/dist/y/z.js", "/r/a.b", "/r/[x].py", "/r/x.py", "/r/!.py",
             "/r/a+b.py", "/r/a\nb.py", "/r/^.py", "/r/].py"]
    globs = ["**/node_modules/**", "*/dist/*", "?r/x.py", "/r/[x].py", "/r/[!x].py", "/r/a+b.*", "*.p[x-z]", "/r/[[]*",
             "/r/[^x].py", "/r/[]].py", "/r/a?b.py", "[", "*"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for g in globs:
        rows = df.select("n", paths.matches_any_glob(F.col("n"), [g]).alias("m")).collect()
        assert {r.n for r in rows if r.m} == {n for n in names if fnmatchcase(n, g)}, g
    assert not any(r.m for r in df.select(paths.matches_any_glob(F.col("n"), []).alias("m")).collect())


def test_sizes(spark):
    def plain(size):
        for unit in ("B", "KB", "MB", "GB"):
            if size < 1024.0:
                return f"{size:.1f} {unit}"
            size /= 1024.0
        return f"{size:.1f} TB"

    sizes = [0, 1, 1023, 1024, 1280, 1792, 1024**2 - 1, 1024**2, 5 * 1024**3 // 4, 1024**4, 3 * 1024**5, 1536]
    df = spark.createDataFrame([(s,) for s in sizes], "s long")
    for r in df.select("s", text.human_size(F.col("s")).alias("h")).collect():
        assert r.h == plain(r.s)


def test_inventory(spark):
    listing = spark.createDataFrame(
        [("/r", "/r/a.py", 10), ("/r", "/r/node_modules/b.js", 10), ("/r", "/r/build/c.sql", 10),
         ("/r", "/r/d.py", 1024 * 1024 + 1), ("/r", "/r/e.py", 1024 * 1024), ("/r", "/r/f.txt", 1), ("/r", "/r/g.py", None),
         ("/q", "/q/x.txt", 1), ("/build", "/build/a.go", 1)],
        "repo_path string, file_path string, size_bytes long")
    kept = {r.file_path for r in inventory.scannable(listing).collect()}
    assert kept == {"/r/a.py", "/r/e.py"}
    assert {r.file_path for r in inventory.scannable(listing, (), 1 << 21).collect()} == {
        "/r/a.py", "/r/d.py", "/r/e.py", "/build/a.go"}
    names = {r.repo_path: r.languages for r in inventory.detected_languages(listing).collect()}
    assert names == {"/r": ["python", "sql"], "/q": ["unknown"], "/build": ["unknown"]}
    config = inventory.language_inventory(listing, "config").where("repo_path = '/r'")
    assert {r.language: r.files for r in config.collect()} == {"python": 4, "dag": 4, "sql": 1}
    assert len(inventory.supported_extensions()) == 12


def test_manifests(spark):
    """Folder hashes against a plain tree: nulls, names in the root, moved and swapped contents."""
    from codesieve.operators import manifest

    def entries(files):
        rows = [("/r", f"/r/{path}", content) for path, content in files.items()]
        df = spark.createDataFrame(rows, "repo_path string, file_path string, content_hash string")
        return manifest.entries(df.selectExpr("*", "1L AS size_bytes", "timestamp'2024-01-01' AS modified_at"))

    before = {"a.py": "1", "x/b.py": "2", "x/c.py": "3", "x/y/d.py": None, "x/y/e.py": "5", "z/f.py": "6", "z/g.py": "7"}
    after = {**before, "x/b.py": "3", "x/c.py": "2", "x/y/d.py": "4", "n/w/h.py": "8"}
    del after["z/g.py"]
    changes = {r.file_path[3:]: r.change for r in manifest.changed_files(entries(after), entries(before)).collect()}
    assert changes == {"x/b.py": "changed", "x/c.py": "changed", "x/y/d.py": "changed", "n/w/h.py": "added", "z/g.py": "removed"}
    folders = manifest.changed_folders(manifest.folder_hashes(entries(after)), manifest.folder_hashes(entries(before)))
    assert {tuple(r)[1:] for r in folders.collect()} == {
        ("", False, 7, 7), ("x", True, 4, 4), ("x/y", True, 2, 2), ("z", True, 1, 2), ("n", False, 1, 0), ("n/w", True, 1, 0)}
    assert manifest.changed_files(entries(before), entries(before)).count() == 0
    none = entries(before).limit(0)
    assert {r.change for r in manifest.changed_files(none, entries(before)).collect()} == {"removed"}
    assert manifest.changed_files(none, none).count() == 0
