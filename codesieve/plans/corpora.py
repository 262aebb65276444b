"""Corpora derived from the given tables: code files, scans, requests and answers."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions.text import content_hash

LINES_PER_FILE = 50
# Long files: a Python one consists of functions of 120 lines.
LONG_FILE_LINES, FUNCTION_LINES = 600, 120
FUNCTION_LINE = "def whole(a, b=[], c=lambda x, y: x, d={k: 1 for k in []}, e=(((((((((1))))))))), f=2):"
LANGUAGES = ("python", "javascript", "java", "go", "rust", "sql")
EXTENSIONS = (".py", ".js", ".java", ".go", ".rs", ".sql")

# Twenty line templates per language, written "language number|line".
TEMPLATES = r"""
python 0|def load(a, b=[], c={}):
python 1|    password = "hunter2hunter2"
python 2|    api_key = "abcdefghijklmnopqrstuvwxyz"
python 3|    for i in items:
python 4|        total += i
python 5|    try:
python 6|    except:
python 7|        pass
python 8|x = eval(src)
python 9|def wide(a, b, c, d, e, f):
python 10|    return evaluate(a)
python 11|        while ready:
python 12|            s += "x"
python 13|    except ValueError:
python 14|
python 15|exec(code); eval(code)
python 16|# password = "short"
python 17|    value = 1
python 18|def one(): return 0
python 19|    Password="longenough1"
javascript 0|const api_key = "abcdefghijklmnopqrstuv";
javascript 1|token: "abcdefgh12345678",
javascript 2|eval (src);
javascript 3|el.innerHTML = html;
javascript 4|<div dangerouslySetInnerHTML={x}/>
javascript 5|if (a == b) {
javascript 6|// a == b
javascript 7|if (a === b) {
javascript 8|console.log(a);
javascript 9|// console.log(a)
javascript 10|xs.map(f).filter(g)
javascript 11|return xs.map(x => <Li/>) // return
javascript 12|<Li key={x.id}/>
javascript 13|<Button onClick={() => go()}/>
javascript 14|const [s, set] = useState({a: 1});
javascript 15|<FlatList data={xs}
javascript 16|keyExtractor={k}
javascript 17|accessible={true}
javascript 18|useEffect(() => {
javascript 19|let y = 1;
java 0|String password = "abcd-1234";
java 1|stmt.executeQuery("select " + q);
java 2|Object o = new ObjectInputStream(in).readObject();
java 3|} catch (IOException e) { }
java 4|} catch (Exception e) {
java 5|if (name == "x") {
java 6|for (;;) { s += "x"; }
java 7|List v = new Vector();
java 8|// todo: fix me
java 9|  public int size() {
java 10|/** doc */
java 11|  public void run() {
java 12|if (a.get() == null) return;
java 13|Random r = new Random();
java 14|int n = 0;
java 15|ps.executeUpdate();
java 16|// plain note
java 17|String s == t
java 18|} catch (RuntimeException e) {}
java 19|private int k() {
go 0|token="abcdef_123"
go 1|token := "abcdef_123"
go 2|db.Query("select " + q)
go 3|db.Exec(fmt.Sprintf(q, a))
go 4|v, _ := f()
go 5|if err != nil { }
go 6|for i := 0; i < 3; i++ { s += "x" }
go 7|// FIXME later
go 8|func Exported(a int) {
go 9|// Exported does
go 10|func hidden() {
go 11|import "unsafe"
go 12|if err != nil {
go 13|x := 1
go 14|return v, nil
go 15|rows.Scan(&a)
go 16|func (t T) Method() {
go 17|  a , _ = g()
go 18|//  hack
go 19|func Other() {
rust 0|let secret = "abc_def-99";
rust 1|unsafe {
rust 2|let x = y.unwrap();
rust 3|let z = y.expect("");
rust 4|for a in b { c.push(a.clone()); }
rust 5|let s = String::new() + &t;
rust 6|// XXX check
rust 7|pub fn go() {
rust 8|/// docs
rust 9|let q = v[0];
rust 10|let q = vec![1][0];
rust 11|println!("{}", user);
rust 12|println!("ok");
rust 13|fn private() {
rust 14|let k = y.expect("msg");
rust 15|  pub fn two() {
rust 16|  unsafe {
rust 17|let m = m2;
rust 18|/// more
rust 19|let w = v[12] + &String::new();
sql 0|SELECT * FROM t;
sql 1|DELETE FROM t;
sql 2|UPDATE t SET a = 1;
sql 3|DELETE FROM t WHERE a = 1;
sql 4|select a from t where a = 1 or b = 2;
sql 5|SELECT a FROM t CROSS JOIN u;
sql 6|SELECT a FROM t LIMIT 5;
sql 7|select a from orders where brand = 1;
sql 8|SELECT a,
sql 9|  b FROM t;
sql 10|-- note
sql 11|UPDATE t SET a = ';' WHERE b = 2;
sql 12|
sql 13|SELECT*FROM u;
sql 14|  delete from u;
sql 15|SELECT 1;
sql 16|SELECT b FROM v WHERE FORK = 1;
sql 17|INSERT INTO t VALUES (1);
sql 18|SELECT a FROM t WHERE x = 1 OR y = 2;
sql 19|SELECT 2;
"""

# First line of React and React Native files.
REACT_LINE = "import React from 'react';"
REACT_NATIVE_LINE = "import React from 'react'; import 'react-native';"


def template_lines() -> list[str]:
    """The 120 lines, 20 for each of ``LANGUAGES`` in order."""
    return [entry.split("|", 1)[1] for entry in TEMPLATES.strip("\n").split("\n")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table for work that costs much per row. A table with fewer input splits than cores,
    such as a single small file, is spread over all cores; a large one is read as it is."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.split(F.lit(" ".join(values)), " "), index)


def corpus_lines(spark: SparkSession, sf_dir: str, per_file: int = LINES_PER_FILE) -> DataFrame:
    """Code lines from ``orders``: ``per_file`` consecutive orders make one file."""
    key, file_no = F.col("o_orderkey"), F.col("file_no")
    number = file_no % len(LANGUAGES)
    templates = F.split(F.lit("\n".join(template_lines())), "\n")
    repo = F.concat(F.lit("/repo"), (file_no % 4).cast("string"))
    opening = F.when(file_no % 12 == 1, REACT_NATIVE_LINE).otherwise(REACT_LINE)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("modified_at"),
        F.expr(f"o_orderkey div {per_file}").alias("file_no"),
        (key % per_file + 1).cast("int").alias("line_no"),
        ((F.col("o_custkey") + key) % 20).alias("t"),
    ).select(
        "o_orderkey", "modified_at", "file_no", repo.alias("repo_path"),
        F.concat(repo, F.lit("/src/f"), file_no.cast("string"), _pick(EXTENSIONS, number))
        .alias("file_path"),
        _pick(LANGUAGES, number).alias("language"), "line_no",
        F.when((number == LANGUAGES.index("javascript")) & (F.col("line_no") == 1), opening)
        .otherwise(F.get(templates, number * 20 + F.col("t"))).alias("line"),
    )


def files_of(lines: DataFrame, *extra: str) -> DataFrame:
    """Lines to files. A file holds a fixed number of lines, so no group grows with the data."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    content = F.array_join(F.transform(ordered, lambda s: s["line"]), "\n")
    return (
        lines.groupBy(*extra, "repo_path", "file_path", "language", "file_no")
        .agg(content.alias("content"), F.max("modified_at").alias("modified_at"))
        .withColumns({
            "ext": _pick(EXTENSIONS, F.col("file_no") % 6),
            "size_bytes": F.octet_length("content").cast("long"),
            "content_hash": content_hash(F.col("content")),
        })
    )


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(corpus_lines(spark, sf_dir))


def long_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 600 lines; Python lines lie inside functions of 120 lines."""
    lines = corpus_lines(spark, sf_dir, LONG_FILE_LINES)
    inside = F.when(F.col("line_no") % FUNCTION_LINES == 1, FUNCTION_LINE).otherwise(F.concat(F.lit("    "), "line"))
    return files_of(lines.withColumn(
        "line", F.when(F.col("language") == "python", inside).otherwise(F.col("line"))))


def snapshot_files(spark: SparkSession, sf_dir: str, padded: bool = False) -> DataFrame:
    """The same files in two scans, each with some of the lines left out. ``padded`` makes a
    third of the lines longer than 4 KB and indents the current scan."""
    lines = corpus_lines(spark, sf_dir)
    key = F.col("o_orderkey")
    scans = F.array_compact(F.array(F.when(key % 11 != 0, F.lit("previous")),
                                    F.when(key % 13 != 0, F.lit("current"))))
    lines = lines.withColumn("scan_id", F.explode(scans))
    if padded:
        lines = lines.withColumn("line", F.concat(
            F.when(F.col("scan_id") == "current", "    ").otherwise(""), "line",
            F.when(key % 3 == 0, F.repeat(F.lit(" pad"), F.lit(1200))).otherwise("")))
    return files_of(lines, "scan_id")


def tree_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans of one tree of folders. A few files differ, a few are in one scan only."""
    lines, number = corpus_lines(spark, sf_dir), F.col("file_no")
    folder = F.concat(F.lit("/src/d"), (number % 7).cast("string"), F.lit("/m"), (number % 35).cast("string"), F.lit("/"))
    lines = lines.withColumn("file_path", F.replace("file_path", F.lit("/src/"), folder))
    previous = (number % 29 != 3) & ~((number % 19 == 5) & (F.col("o_orderkey") % 3 == 0))
    scans = F.array_compact(F.array(F.when(previous, F.lit("previous")), F.when(number % 31 != 4, F.lit("current"))))
    return files_of(lines.withColumn("scan_id", F.explode(scans)), "scan_id")


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing of a tree: the corpus files, some of them below directories a scan skips, with
    marker files of frameworks and names that are no code."""
    number = F.col("file_no") % 10
    folder = F.when(number == 7, "/node_modules/pkg/").when(number == 8, "/src/dist/").when(
        number == 9, "/.git/").otherwise("/src/")
    names = F.array(
        F.concat(F.lit("f"), F.col("file_no").cast("string"), F.element_at(F.split("file_path", "f[0-9]+"), -1)),
        F.concat(F.lit("note"), F.col("file_no").cast("string"), F.lit(".TXT")),
        F.when(number == 3, "package.json").when(number == 5, "pom.xml").when(
            number == 6, "dags/flow.PY").otherwise("app.py"))
    files = files_of(corpus_lines(spark, sf_dir))
    return files.select(
        "repo_path", "file_no", F.explode(names).alias("name"),
        (F.col("size_bytes") * F.when(number == 4, 1000).otherwise(1)).alias("size_bytes"),
        "modified_at", folder.alias("folder"),
    ).select("repo_path", F.concat("repo_path", "folder", "name").alias("file_path"),
             "size_bytes", "modified_at", "file_no")


def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files from ``events``: valid, broken, nested, with repeated keys, scalar."""
    n, p = F.col("event_id"), F.col("props")
    user, depth = F.col("user_id").cast("string"), (F.col("event_id") % 14).cast("int")

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    content = (
        F.when(n % 8 == 0, p)
        .when(n % 8 == 1, text('{"k": ', user, ', "n": ', p, ', "list": [', p, ", ", p, "]}"))
        .when(n % 8 == 2, text(p, " x"))
        .when(n % 8 == 3, F.substring(p, F.lit(1), F.length(p) - 1))
        .when(n % 8 == 4, text(F.repeat(F.lit('{"d":'), depth), p, F.repeat(F.lit("}"), depth)))
        .when(n % 8 == 5, text(F.repeat(F.lit("["), depth), F.repeat(F.lit("]"), depth)))
        .when(n % 8 == 6, text('{"a": 1, "a": ', user, ', "b": {"a": [', p, "]}}"))
        .otherwise(text('"', F.col("event_type"), '"')))
    return spread_table(spark, sf_dir, "events").select(
        F.lit("/events").alias("repo_path"),
        F.concat(F.lit("/events/e"), n.cast("string"), F.lit(".json")).alias("file_path"),
        F.lit("json").alias("language"), content.alias("content"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one file."""
    return spread_table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("/docs/"), "source").alias("repo_path"),
        F.concat(F.lit("/docs/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"),
        F.col("text").alias("content"), content_hash(F.col("text")).alias("content_hash"))


def labelled_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge entries of the labelled documents: one issue per bad label, saved in the order
    of the documents. Copies of a text give several entries; the last one is valid."""
    labels = table(spark, sf_dir, "labels")

    def issue(category: str, severity: str, description: str) -> Column:
        return F.struct(
            F.lit(category).alias("category"), F.lit(severity).alias("severity"),
            F.lit(1).alias("line_start"), F.size(F.split("content", "\n")).alias("line_end"),
            F.lit(description).alias("description"), F.lit("Review the text").alias("recommendation"))

    issues = F.array_compact(F.array(
        F.when(F.col("quality") == 0, issue("maintainability", "info", "Low quality")),
        F.when(F.col("toxic") == 1, issue("security", "error", "Toxic"))))
    return document_files(spark, sf_dir).join(labels, "doc_id").select(
        F.col("content_hash").alias("file_hash"), issues.alias("issues"),
        F.timestamp_seconds("doc_id").alias("ts"), F.lit("labels").alias("source"))


def order_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan headers from ``orders``."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("scan_id"),
        F.concat(F.lit("/repo"), (F.col("o_custkey") % 20).cast("string")).alias("repo_path"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").alias("total_issues"))


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and cache entries from ``events``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("entry_id"), F.col("event_type").alias("provider"),
        F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("cache_key"),
        F.col("ts").cast("timestamp").alias("ts"))


def dense_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests with time running 20 or 400 times as fast, so that the limits bind."""
    faster = F.when(F.col("provider") == "click", 400).otherwise(20)
    return event_requests(spark, sf_dir).withColumn(
        "ts", F.timestamp_micros(F.floor(F.unix_micros("ts") / faster).cast("long")))


def order_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to review requests, one per order, in the shapes services return."""
    key = F.col("o_orderkey")
    number = (key % 40).cast("string")

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    status = F.col("o_orderstatus")
    severity = F.when(status == "F", "Error").when(status == "O", "WARNING").otherwise("fatal")
    item = text('{"category": "Security", "severity": "', severity,
                '", "line_start": ', number, ', "line_end": ', number,
                ', "description": "Found by ', status, '", "recommendation": "Fix ', number, '"}')
    plain = text('{"category": "bug", "severity": "ERROR", "description": "Plain"}')
    foreign = text('{"category": "style", "severity": "fatal"}')
    response = (
        F.when(key % 14 == 0, text("Here are the issues:\n[", item, ", ", plain, "]\nRegards"))
        .when(key % 14 == 1, text('{"issues": [', item, "]}"))
        .when(key % 14 == 2, "[]")
        .when(key % 14 == 3, text("[", item))
        .when(key % 14 == 4, "")
        .when(key % 14 == 5, "No issues found.")
        .when(key % 14 == 6, text("[", foreign, "]"))
        .when(key % 14 == 7, text("[1, ", item, "]"))
        .when(key % 14 == 8, "[{'category': 'bug', 'description': 'single quotes'}]")
        .when(key % 14 == 9, '[{"category": "bug", "line_start": "10", "line_end": "12"}]')
        .when(key % 14 == 10, '[{"category": "security", "line_start": 10.0, "line_end": 11.0}]')
        .when(key % 14 == 11, '[{"severity": "error", "line_start": "x", "line_end": null}]')
        .when(key % 14 == 12, """[{"line_start": 3, "extra": {"a": [1]}, "description": "a \\"b\\" 'c'"}]""")
        .otherwise(item))
    return spread_table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/repo/f"), key.cast("string")).alias("file_path"), response.alias("response"))
