"""File sources and the stream."""

import os
from datetime import datetime, timezone

from pyspark.sql import functions as F

from codesieve.plans.scan import scan_issues
from codesieve.sources.code_files import list_files, read_code_files, read_code_files_binary
from codesieve.streaming.incremental import start_incremental_scan, stream_files

TREE = {
    "a.py": b"password = '12345678'\r\nx = 1\r", "__init__.py": b"", ".hidden.py": b"eval(x)\n", "_u.py": b"y",
    "bad.py": b"a\xff\xfeb\xc3", "sub/deep/b.GO": b"v, _ = f()", "sub/node_modules/c.js": b"eval(x)", "build/d.py": b"z",
    "sub/build.py": b"x", "note.txt": b"x", "full.sql": b"-" * (1 << 20), "over.sql": b"-" * ((1 << 20) + 1),
    "vendor/e.rs": b"a.unwrap()",
}


def tree(folder):
    for name, data in TREE.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    os.symlink("/nonexistent", folder / "dangling.py")
    return str(folder)


def test_read_code_files(spark, tmp_path):
    root = tree(tmp_path / "tree")
    for tasks in (1, 2, 256):
        files = {os.path.relpath(r.file_path, root): r for r in read_code_files(spark, root, tasks=tasks).collect()}
        assert set(files) == {"a.py", "__init__.py", ".hidden.py", "_u.py", "bad.py", "sub/deep/b.GO", "sub/build.py",
                              "full.sql", "vendor/e.rs"}
    assert files["a.py"].content == "password = '12345678'\nx = 1\n"
    assert files["bad.py"].content == "ab" and files["__init__.py"].content == ""
    assert (files["sub/deep/b.GO"].ext, files["sub/deep/b.GO"].language) == (".go", "go")
    assert files["full.sql"].size_bytes == 1 << 20 and files["a.py"].repo_path == root
    kept = read_code_files(spark, root, excludes=["**/vendor/**", "*.sql"]).collect()
    assert len(kept) == 7
    found = {(os.path.relpath(r.file_path, root), r.rule_id) for r in scan_issues(read_code_files(spark, root)).collect()}
    assert found == {("a.py", "PY-01"), (".hidden.py", "PY-03"), ("sub/deep/b.GO", "GO-03"), ("vendor/e.rs", "RS-03")}


def test_listing(spark, tmp_path):
    root = tree(tmp_path / "tree")
    rows = {r.rel_path: r for r in list_files(spark, root, prune=()).collect()}
    assert set(rows) == set(TREE)
    assert abs(rows["a.py"].modified_at.timestamp() - os.stat(f"{root}/a.py").st_mtime) < 1
    assert "sub/node_modules/c.js" not in {r.rel_path for r in list_files(spark, root).collect()}


def test_binary_source(spark, tmp_path):
    root = tree(tmp_path / "tree")
    walked = {r.file_path: (r.content, r.language) for r in read_code_files(spark, root).collect()}
    binary = {r.file_path: (r.content, r.language) for r in read_code_files_binary(spark, root).collect()}
    skipped = {p for p in walked if os.path.basename(p)[0] in "._" or walked[p][0] == ""}
    assert binary == {p: v for p, v in walked.items() if p not in skipped}


def test_saved_files_are_pruned_by_language(spark, tmp_path):
    from codesieve.operators.python_blocks import python_block_issues
    from codesieve.sources.code_files import load_code_files, save_code_files

    files = read_code_files(spark, tree(tmp_path / "tree"))
    save_code_files(files, str(tmp_path / "saved"))
    saved = load_code_files(spark, str(tmp_path / "saved"))
    assert sorted(map(repr, saved.collect())) == sorted(map(repr, files.select(*saved.columns).collect()))
    plan = python_block_issues(saved)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(language" in plan and "PushedFilters: [IsNotNull(content)" in plan


def test_large_trees_are_read_in_parts(spark, tmp_path, monkeypatch):
    import pandas as pd

    from codesieve.sources import code_files

    root = tmp_path / "tree"
    root.mkdir()
    for i in range(10):
        (root / f"f{i}.py").write_text("x" * 100)
    listing = pd.DataFrame({"file_path": [str(root / f"f{i}.py") for i in range(10)], "size_bytes": [100] * 10})
    monkeypatch.setattr(code_files, "READ_BYTES", 250)
    parts = list(code_files._read_contents(iter([listing])))
    assert [len(p) for p in parts] == [2, 2, 3, 2, 1] and all(p["content"].str.len().eq(100).all() for p in parts)


def test_stream_scans_a_file_once(files_of, spark, tmp_path):
    landing, target, checkpoint = (str(tmp_path / n) for n in ("landing", "issues", "checkpoint"))
    files = files_of({"/r/a.go": "v, _ = f()", "/r/b.py": "for a in b:\n    s += 1"}).withColumns({
        "ext": F.lit(""), "size_bytes": F.lit(1).cast("long"),
        "modified_at": F.lit(datetime(2001, 1, 1, tzinfo=timezone.utc))})
    for _ in range(2):
        files.write.mode("append").parquet(landing)
        run = start_incremental_scan(stream_files(spark, landing), target, checkpoint, available_now=True)
        run.awaitTermination()
    rows = spark.read.parquet(target).drop("batch").collect()
    assert sorted(r.rule_id for r in rows) == ["GO-03", "PY-08"]
    changed = files.withColumn("content_hash", F.lit("new"))
    changed.write.mode("append").parquet(landing)
    start_incremental_scan(stream_files(spark, landing), target, checkpoint, available_now=True).awaitTermination()
    assert spark.read.parquet(target).count() == 4


def test_run_and_compare(spark, tmp_path):
    from codesieve.plans.scan import compare_scans, run_scan
    from codesieve.sources.store import ScanStore

    root = tmp_path / "tree"
    tree(root)
    store = ScanStore(spark, str(tmp_path / "store"))
    first = run_scan(spark, str(root), store, datetime(2024, 1, 1))
    (root / "a.py").write_text("\nx = eval(y)\npassword = '12345678'\n")
    (root / "vendor/e.rs").write_text("a\n")
    second = run_scan(spark, str(root), store, datetime(2024, 1, 2))
    status = {(r.rule_id, r.status) for r in compare_scans(store, second, first).collect()}
    assert status == {("PY-01", "remaining"), ("PY-03", "remaining"), ("PY-03", "new"),
                      ("GO-03", "remaining"), ("RS-03", "fixed")}
    assert {r.status for r in compare_scans(store, first, None).collect()} == {"new"}
    heads = [(r.scan_id, r.total_files, r.total_issues, r.scan_date) for r in store.history(str(root)).collect()]
    assert heads == [(second, 9, 4, "2024-01-02T00:00:00"), (first, 9, 4, "2024-01-01T00:00:00")]
    assert store.history().first().languages == ["python", "sql"]


def test_contents_are_read_once(spark, tmp_path):
    """No job over read files goes back to the tree."""
    from codesieve.operators.reuse import knowledge_rows
    from codesieve.plans.scan import scan_distinct_contents, scan_with_reviews

    files = read_code_files(spark, tree(tmp_path / "tree"))
    review = spark.createDataFrame([], "repo_path string, file_path string, category string, severity string, "
                                   "line_start int, line_end int, description string, recommendation string")
    knowledge = knowledge_rows(files, scan_issues(files), F.current_timestamp())
    for job in (scan_issues(files), scan_distinct_contents(files), scan_with_reviews(files, knowledge, review)):
        plan = job._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" not in plan and "FileScan parquet" in plan
    direct = read_code_files(spark, str(tmp_path / "tree"), land=False)
    assert sorted(map(repr, direct.collect())) == sorted(map(repr, files.collect()))


def test_size_limit_is_a_setting(spark, tmp_path):
    (tmp_path / "big.json").write_text('["' + "x" * (1 << 20) + '"]')
    for read in (read_code_files, read_code_files_binary):
        assert read(spark, str(tmp_path)).count() == 0
        found = scan_issues(read(spark, f"file:{tmp_path}" if read is read_code_files_binary else str(tmp_path), cap=1 << 22))
        assert [(r.rule_id, os.path.basename(r.file_path)) for r in found.collect()] == [("JN-03", "big.json")]


def test_default_excludes(spark, tmp_path):
    for name in ("src/a.py", "target/b.py", "bin/c.py", ".idea/d.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [os.path.basename(r.file_path) for r in read_code_files(spark, str(tmp_path)).collect()] == ["a.py"]
    assert read_code_files(spark, str(tmp_path), excludes=()).count() == 4


def test_run_with_review(spark, tmp_path):
    """What a review finds is reported and known to the next run, which asks about the rest only."""
    import pytest

    from codesieve.plans.scan import run_scan
    from codesieve.sources.store import ScanStore

    root, store, asked = tmp_path / "tree", ScanStore(spark, str(tmp_path / "store")), []
    root.mkdir()
    (root / "a.py").write_text("x = eval(y)")
    (root / "b.go").write_text("v, _ = f()")

    def review(files):
        asked.append(sorted(os.path.basename(r.file_path) for r in files.collect()))
        return files.where(F.endswith("file_path", F.lit(".py"))).select(
            "repo_path", "file_path", F.lit("Bug").alias("category"), F.lit("error").alias("severity"),
            F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit("found").alias("description"),
            F.lit("r").alias("recommendation"))

    for k in range(2):
        scan_id = run_scan(spark, str(root), store, datetime(2024, 1, 1 + k), review=review)
        rows = {(os.path.basename(r.file_path), r.category, r.rule_id) for r in store.issues(scan_id).collect()}
        assert rows == {("a.py", "bug", None), ("b.go", "bug", "GO-03")}
    assert asked == [["a.py", "b.go"], ["b.go"]]
    with pytest.raises(ZeroDivisionError):
        run_scan(spark, str(root), store, datetime(2024, 1, 3), review=lambda files: 1 // 0)
    assert [r.status for r in store.history().collect()] == ["failed", "completed", "completed"]


def test_contents_stay_in_their_buckets(spark, files_of):
    """Decisions move keys, never contents, with copies, empty and null contents, with broadcasts off."""
    import re

    from codesieve.plans.scan import scan_distinct_contents, scan_issues
    from codesieve.sources.contents import split_files

    texts = {f"/r/a{i}.py": "def f(a=[]):\n    x = eval(a)\n" for i in range(20)} | {
        "/r/b.js": "eval(x)", "/r/c.js": "", "/r/d.js": None, "/r/e.rs": "a.unwrap()"}
    files = files_of(texts)
    split = split_files(files, buckets=3)
    assert split.keys.count() == len(texts) and "content" not in split.keys.columns
    back = {r.file_path: r.content for r in split.with_contents(split.keys).collect()}
    assert back == {p: t for p, t in texts.items() if t is not None}
    assert split.of_keys(split.keys).count() == 4
    assert spark.sql("SHOW TABLES").where("tableName LIKE 'contents_%'").count() == 0
    plain, once = scan_issues(files), scan_distinct_contents(files)
    assert sorted(map(repr, once.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = scan_distinct_contents(files)._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)
    assert moved and not any(c.split("#")[0].strip() == "content" for line in moved for c in line.split(","))
    assert scan_distinct_contents(files.limit(0)).count() == 0


def test_listing_in_rounds(spark, tmp_path):
    """A long chain and a wide directory, opened a few directories at a time, with links and names of
    any kind; the rounds give what a walk gives."""
    deep = tmp_path
    for i in range(60):
        deep = deep / f"d{i}"
    deep.mkdir(parents=True)
    (deep / "last.py").write_text("x")
    for i in range(300):
        (tmp_path / "wide" / f"w{i}").mkdir(parents=True)
        (tmp_path / "wide" / f"w{i}" / ".f é.py").write_text("y" * i)
    (tmp_path / "wide" / "loop").symlink_to(tmp_path)
    (tmp_path / "wide" / "w0" / "link.py").symlink_to(deep / "last.py")
    (tmp_path / "wide" / "w0" / "broken.py").symlink_to(tmp_path / "none")
    want = {(os.path.relpath(os.path.join(f, n), tmp_path), os.stat(os.path.join(f, n)).st_size)
            for f, _, names in os.walk(tmp_path) for n in names if os.path.exists(os.path.join(f, n))}
    for most in (7, 1000):
        rows = list_files(spark, str(tmp_path), tasks=8, prune=(), most=most)
        found = [(r.rel_path, r.size_bytes) for r in rows.collect()]
        assert len(found) == len(set(found)) == 302 and set(found) == want
    assert list_files(spark, str(tmp_path / "none")).count() == 0
    parts = list_files(spark, str(tmp_path), tasks=8, prune=("d0",), most=7).select(F.spark_partition_id()).distinct().count()
    assert parts > 1


def test_scan_since_reads_what_changed(spark, tmp_path):
    """A file of the same size and time is not opened; a touched one is read, not scanned anew."""
    from codesieve.operators.catalog import RULES
    from codesieve.plans.scan import compare_scans, run_scan
    from codesieve.sources.store import ScanStore

    root = tmp_path / "tree"
    tree(root)
    (root / "gone.go").write_text("v, _ = f()\n")
    store = ScanStore(spark, str(tmp_path / "store"))
    first = run_scan(spark, str(root), store, datetime(2024, 1, 1))
    # Not the content scanned first, but its size and time: if it were opened its issue would go.
    unread = root / "vendor/e.rs"
    times = os.stat(unread)
    unread.write_bytes(b" " * times.st_size)
    os.utime(unread, ns=(times.st_atime_ns, times.st_mtime_ns))
    os.utime(root / "sub/deep/b.GO", (1, 1))
    (root / "a.py").write_text("\nx = eval(y)\npassword = '12345678'\n")
    (root / "sub/new.rs").write_text("a.unwrap()\n")
    (root / "gone.go").unlink()
    second = run_scan(spark, str(root), store, datetime(2024, 1, 2), since=first)
    compared = compare_scans(store, second, first).collect()
    assert {(os.path.relpath(r.file_path, root), r.rule_id, r.status) for r in compared} == {
        ("a.py", "PY-01", "remaining"), ("a.py", "PY-03", "new"), (".hidden.py", "PY-03", "remaining"),
        ("sub/deep/b.GO", "GO-03", "remaining"), ("vendor/e.rs", "RS-03", "remaining"),
        ("sub/new.rs", "RS-03", "new"), ("gone.go", "GO-03", "fixed")}
    assert {r.code_snippet for r in compared if r.rule_id == "RS-03"} == {"a.unwrap()"}
    head = store.scans().where(F.col("scan_id") == second).first()
    assert (head.total_files, head.total_issues) == (10, 6)
    # A third scan builds on the second; other rules read everything.
    third = run_scan(spark, str(root), store, datetime(2024, 1, 3), since=second)
    assert {r.status for r in compare_scans(store, third, second).collect()} == {"remaining"}
    rust = tuple(r for r in RULES if r.rule_id.startswith("RS"))
    fourth = run_scan(spark, str(root), store, datetime(2024, 1, 4), rules=rust, since=third)
    assert "vendor/e.rs" not in {os.path.relpath(r.file_path, root) for r in store.issues(fourth).collect()}


def test_versions_compared_on_arrival(files_of, spark, tmp_path):
    """Each version against the one before it as ``scan_diff`` does, over a restart of both streams."""
    from codesieve.operators.diff import scan_diff
    from codesieve.operators.line_store import with_texts
    from codesieve.schemas import CODE_FILES
    from codesieve.streaming import versions

    landing, scanned, target = (str(tmp_path / n) for n in ("landing", "scanned", "diff"))
    columns = [c.split()[0] for c in CODE_FILES.split(", ")]
    texts = [
        {"/r/a.go": "v, _ = f()\nv, _ = f()\n", "/r/b.py": "for a in b:\n    s += 1", "/r/c.rs": "a.unwrap()"},
        {"/r/a.go": "v, _ = f()\n", "/r/b.py": "for a in b:\n    s += 1\n    s += 1\nx = eval(y)", "/r/c.rs": None},
        {"/r/a.go": "\n\n  v, _ = f()\nv, _ = f()\ntoken := \"abcdef_123\"", "/r/b.py": "", "/r/c.rs": "a.unwrap()"},
    ]
    rounds = [files_of(t).withColumns({"ext": F.lit(""), "size_bytes": F.lit(1).cast("long"),
                                       "modified_at": F.lit(datetime(2024, 1, day, tzinfo=timezone.utc))}).select(*columns)
              for day, t in enumerate(texts, 1)]

    def arrive(*files):
        for f in files:
            f.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(CODE_FILES).parquet(landing)
        versions.start_version_scan(stream, scanned, str(tmp_path / "c1"), available_now=True).awaitTermination()
        versions.start_version_diff(versions.stream_versions(spark, scanned), target, str(tmp_path / "c2"),
                                    available_now=True).awaitTermination()
        return spark.read.parquet(target)

    fields = ["file_path", "rule_id", "line_start", "status", "issue_hash", "code_snippet"]
    expected, before = set(), None
    for files in rounds:
        now = scan_issues(files.where("content IS NOT NULL"))
        expected |= {tuple(r) for r in scan_diff(now, before).select(*fields).collect()} if before is not None else {
            tuple(r) for r in scan_diff(now, None).select(*fields).collect()}
        before = now
    first = arrive(rounds[0])
    assert {r.status for r in first.collect()} == {"new"} and first.count() == 4
    arrive(rounds[1], rounds[2])
    # Versions that were compared already, arriving again.
    rows = with_texts(arrive(rounds[0], rounds[2]), versions.texts_of(spark, scanned)).select(*fields).collect()
    assert {tuple(r) for r in rows} == expected
    assert {r.status for r in rows} == {"new", "fixed", "remaining"}


def test_files_of_the_stored_snapshots_are_built_once(spark, monkeypatch):
    """Scan and headers of both saves read the written files."""
    from codesieve.plans.queries import QUERIES
    from codesieve.sources.store import ScanStore

    plans, save = [], ScanStore.save_scans

    def saved(self, files, *rest, **more):
        plans.append(files._jdf.queryExecution().optimizedPlan().toString())
        return save(self, files, *rest, **more)

    monkeypatch.setattr(ScanStore, "save_scans", saved)
    QUERIES["store_scans"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 2 and not any("Aggregate" in plan for plan in plans)
