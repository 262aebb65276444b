"""Hits, near misses and edges of each rule."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codesieve.operators.catalog import OPTIONAL_RULES, RULES, register_rule, rule_table, rules_from_table
from codesieve.operators.scan_rules import scan_rules
from codesieve.plans.scan import scan_issues
from codesieve.session import configure

RN = "import 'react-native';\n"
REACT = "import React from 'react';\n"

# (extension, content, expected (rule, line) pairs)
CASES = [
    (".py", "\n" * 499 + 'password = "12345678"', [("PY-01", 500)]),
    (".py", "\n" * 500 + 'password = "12345678"', [("PY-01", 501)]),
    (".py", 'password = "1234567"', []),
    (".py", 'PassWord="12345678"; api_key = "12345678901234567890"', [("PY-01", 1)]),
    (".py", "API-KEY = '12345678901234567890'", [("PY-02", 1)]),
    (".pyw", "password = 'abcdefgh'\r", [("PY-01", 1)]),
    (".js", "eval (a); b.innerHTML= c; dangerouslySetInnerHTML", [("JS-03", 1), ("JS-04", 1), ("JS-05", 1)]),
    (".js", "a.innerHTML == b", [("JS-05", 1), ("JS-06", 1)]),
    (".ts", "a === b == c", [("JS-06", 1)]),
    (".js", "a === b", []), (".js", "// a == b", []), (".js", "a == b // c", [("JS-06", 1)]), (".js", "a !== b", []),
    (".mjs", 'apikey: "12345678901234567890"', [("JS-01", 1)]),
    (".js", 'token = "12345678901234567890"; api_key = "12345678901234567890"', [("JS-01", 1)]),
    (".js", "\n" * 500 + 'token: "12345678"', [("JS-02", 501)]), (".js", "Secret='12345678'", [("JS-02", 1)]),
    (".js", "  // console.log(1)", []), (".js", "x; console.debug(1)", [("JS-07", 1)]), (".js", "console.error(1)", []),
    (".js", "a.map(f).map(g)", [("JS-08", 1)]), (".js", "a.map(f)", []),
    (".jsx", "a.map(f); return 1", []),
    (".jsx", REACT + "a.map(f); return 1\n1\n2\n<a key=1>", []),
    (".jsx", REACT + "a.map(f); return 1\n1\n2\n3\n<a key=1>", [("JS-10", 2)]),
    (".jsx", REACT + "return a.map(x => <i key={x}/>)", []),
    (".tsx", REACT + "return a.map(f)", [("JS-10", 2)]),
    (".tsx", REACT + "<a onPress = {() => 1}>\nuseState ({})", [("JS-11", 2), ("JS-13", 3)]),
    (".tsx", "<a onPress = {() => 1}>", []),
    (".js", RN + "<Button accessible>", [("RN-01", 2)]),
    (".js", RN + "<Button\naccessible", []),
    (".js", RN + "<Button\naccessibilityLabel=1", [("RN-01", 2)]),
    (".js", RN + "<Pressable\n\n\n\n\naccessible", []), (".js", RN + "<Pressable\n\n\n\n\n\naccessible", [("RN-01", 2)]),
    (".js", RN + "<FlatList keyExtractor={k}", [("RN-02", 2)]),
    (".js", RN + "<FlatList" + "\n" * 10 + "keyExtractor", []), (".js", RN + "<FlatList" + "\n" * 11 + "keyExtractor", [("RN-02", 2)]),
    (".js", REACT + "<FlatList", []),
    (".java", "catch (Exception e) { }", [("JV-04", 1), ("JV-05", 1)]),
    (".java", 'token : "abcd-1234"', []), (".java", "Token='abcd_1234'", [("JV-01", 1)]),
    (".java", "executeQuery(a + b)\nexecuteUpdate(String.format(a))\nexecuteQuery(a)", [("JV-02", 1), ("JV-02", 2)]),
    (".java", "new ObjectInputStream(i).readObject()", [("JV-03", 1)]),
    (".java", 'if (a == "x") {\nstr b == c\nif (a == b)', [("JV-06", 1), ("JV-06", 2)]),
    (".java", 'while (x) s += "a";\nfor (;;) s += a;', [("JV-07", 1)]),
    (".java", "new Vector<>()\nVector v;", [("JV-08", 1)]),
    (".java", "public int a() {}", []), (".java", "\npublic int a() {}", [("JV-10", 2)]),
    (".java", "  /** doc */\npublic int a() {}\npublic static int b() {}", []),
    (".java", "if (a.get() == NULL) {}\na.get(1) == null", [("JV-11", 1)]),
    (".java", "new Random();\n// TOKEN", [("JV-12", 1)]), (".java", "new Random();", []),
    (".go", 'token := "abcdefgh"', []), (".go", 'token="abcdefgh"', [("GO-01", 1)]),
    (".go", "db.Query(a + b)\ndb.Exec(fmt.Sprintf(a))\ndb.Query(a)", [("GO-02", 1), ("GO-02", 2)]),
    (".go", " v , _ := f()\nv, err := f()\n1, _ = f()", [("GO-03", 1)]),
    (".go", "if err != nil { }\nif err != nil { x }", [("GO-04", 1)]),
    (".go", 'for a = "x"\nfor a := "x"\nfor "x"', [("GO-05", 1), ("GO-05", 2)]),
    (".go", "func Aa()\nfunc Bb()\n// c\nfunc Cc()\nfunc (t T) Dd()\nfunc ee()", [("GO-07", 2)]),
    (".go", 'import "unsafe"', [("GO-08", 1)]),
    (".rs", "unsafe {\nx unsafe {", [("RS-02", 1)]),
    (".rs", "a.unwrap()\na.unwrap_or(1)", [("RS-03", 1)]),
    (".rs", "a.expect('')\na.expect(\"m\")", [("RS-04", 1)]),
    (".rs", "for a in b { a.clone() }\na.clone()", [("RS-05", 1)]),
    (".rs", "String + &a\na + &b", [("RS-06", 1)]),
    (".rs", "pub fn a()\npub fn b()\n/// d\n pub fn c()\n// e\npub fn d()", [("RS-08", 2), ("RS-08", 6)]),
    (".rs", "a[0]\nVEC![1][0]\na[i]", [("RS-09", 1)]),
    (".rs", "println!(USER)\nprintln!(x)", [("RS-10", 1)]),
    (".rs", "let secret = 'abc_def-99';", [("RS-01", 1)]),
    (".sql", "select *\nfrom t; select*from u; select a", [("SQ-01", 1), ("SQ-01", 1)]),
    (".sql", "delete from t;\n update t set a = 1;\ndelete from t where a;", [("SQ-02", 1), ("SQ-02", 1)]),
    (".sql", "select a cross join b;\n-- limit", []), (".sql", "a\nselect a Cross Join b", [("SQ-03", 2)]),
    (".sql", "x WHERE FORK = 1\nx where a or b\nOR where a", [("SQ-04", 2)]),
    (".json", '{"a":1,"b":{"a":2},"c":[{"a":3}]}', [("JN-02", 1), ("JN-02", 1)]),
    (".json", '{"a":1,"a":2}', [("JN-02", 1)]),
    (".json", '{"a":1} x', [("JN-01", 1)]), (".json", '{"a":1', [("JN-01", 1)]), (".json", "", []),
    (".json", '[NaN, -Infinity, 1e5, -0.5, "a\\u00e9\\n"]', []), (".json", '["\\x"]', [("JN-01", 1)]),
    (".json", "[01]", [("JN-01", 1)]), (".json", "[1,]", [("JN-01", 1)]), (".json", "1 2", [("JN-01", 1)]),
    (".json", " null\n", []), (".json", '"a" "b"', [("JN-01", 1)]), (".json", "[][]", [("JN-01", 1)]),
    (".json", "[" * 10 + "]" * 10, []), (".json", "[" * 11 + "]" * 11, [("JN-04", 1)]),
    (".json", "[" * 10 + "1" + "]" * 10, [("JN-04", 1)]), (".json", "[" * 9 + '"[[[]]]"' + "]" * 9, []),
    (".json", '["' + "x" * (1 << 20) + '"]', [("JN-03", 1)]), (".json", '["' + "x" * ((1 << 20) - 4) + '"]', []),
    (".txt", 'password = "12345678"', []),
]


def test_cases(files_of):
    contents = {f"/r/c{i:03}{ext}": text for i, (ext, text, _) in enumerate(CASES)}
    files = files_of(contents)
    configure(files.sparkSession)
    found = {}
    for r in scan_rules(files).select("file_path", "rule_id", "line_start", "line_end").collect():
        assert r.line_start == r.line_end
        found.setdefault(r.file_path, Counter())[(r.rule_id, r.line_start)] += 1
    for path, (ext, text, expected) in zip(contents, CASES):
        assert found.get(path, Counter()) == Counter(expected), (path, text[:80])


def test_strict_start(files_of):
    files = files_of({"/r/a.sql": "delete from t;\nupdate t set a = 1;delete from u"})
    texts = lambda strict: sorted(r.code_snippet for r in scan_rules(files, strict_start=strict).collect())
    assert texts(False) == ["delete from t;", "delete from u", "update t set a = 1;"]
    assert texts(True) == ["delete from t;", "delete from u"]


def test_every_rule_has_a_case():
    hit = {rule for _, _, expected in CASES for rule, _ in expected}
    assert {r.rule_id for r in RULES} - hit <= {"JV-09", "GO-06", "RS-07"}


def test_descriptions(files_of):
    files = files_of({
        "/r/a.java": "x // xxx and fixme", "/r/b.sql": "update t set a = 1", "/r/c.json": '{"k":1,"k":2}',
        "/r/d.json": "[" * 12 + "]" * 12, "/r/e.json": '["' + "x" * (1 << 20) + '"]'})
    texts = {r.file_path: r.description for r in scan_rules(files).collect()}
    assert texts == {
        "/r/a.java": "Found xxx comment", "/r/b.sql": "UPDATE statement without WHERE clause",
        "/r/c.json": "Duplicate key 'k' found in JSON", "/r/d.json": "Deeply nested JSON structure (depth: 12)",
        "/r/e.json": "Large JSON file (1024KB)"}


def test_json_validity_against_parser(spark):
    import random

    from codesieve.operators.json_files import json_depth, json_is_valid
    rng = random.Random(7)

    def value(depth):
        kind = rng.randrange(8 if depth < 13 else 5)
        if kind < 5:
            return rng.choice(["a[", 'q"\\', 1, -2.5e-3, True, None, "", "{}", "é\n"])
        if kind < 7:
            return {rng.choice(["a", "b", "c}", "d"]): value(depth + 1) for _ in range(rng.randrange(3))}
        return [value(depth + 1) for _ in range(rng.randrange(3))]

    def depth_of(data, at=1):
        items = data.values() if isinstance(data, dict) else data if isinstance(data, list) else []
        return max([depth_of(i, at + 1) for i in items], default=at)

    def repeats(text):
        """True if an object repeats a key: the parser then keeps the last value only."""
        seen = []
        json.loads(text, object_pairs_hook=lambda pairs: seen.append(len(pairs) - len(dict(pairs))))
        return any(seen)

    texts = []
    for _ in range(600):
        text = json.dumps(value(0), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        texts.append(text)
        if text:
            at = rng.randrange(len(text))
            texts.append(text[:at] + rng.choice(["", ",", "}", "]", '"', "x", " ", "\\", "0"]) + text[at + rng.randrange(2):])
    configure(spark)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    broken = 0
    for r in df.select("t", json_is_valid(F.col("t")).alias("ok"), json_depth(F.col("t")).alias("d")).collect():
        try:
            data = json.loads(r.t)
        except json.JSONDecodeError:
            assert not r.ok, r.t
            broken += 1
            continue
        assert r.ok, r.t
        assert r.d >= depth_of(data), r.t
        if not repeats(r.t):
            assert r.d == depth_of(data), r.t
    assert 100 < broken < 600


def test_custom_rules(files_of, spark):
    rules = register_rule("X-01", "go", "bug", "info", "d", "r", "contains(text, 'zzz') AND line_no = 2")
    rules = register_rule("X-02", "json", "bug", "info", "d", "r", lambda: F.col("json_chars") > 3, "file", rules)
    files = files_of({"/r/a.go": "zzz\nzzz", "/r/b.json": "[10]"})
    found = sorted((r.rule_id, r.line_start) for r in scan_rules(files, rules).collect())
    assert found == [("X-01", 2), ("X-02", 1)]
    with pytest.raises(ValueError):
        register_rule("GO-01", "go", "bug", "info", "d", "r", "true")
    with pytest.raises(ValueError):
        register_rule("X-03", "go", "bad", "info", "d", "r", "true")
    table = spark.createDataFrame([("X-09", "go", "bug", "error", "it's", "r", "startswith(text, 'z')", "line")],
                                  "rule_id string, language string, category string, severity string, "
                                  "description string, recommendation string, predicate string, scope string")
    assert [r.description for r in scan_rules(files, rules_from_table(table, ())).collect()] == ["it's"] * 2


def test_optional_rule(files_of):
    lines = ['db.execute("x" % 1)', 'db.raw(f"{x}")', 'db.executemany("{}".format(1))', 'db.execute("x", 1)']
    rows = scan_rules(files_of({"/r/a.py": "\n".join(lines)}), OPTIONAL_RULES).collect()
    assert [r.line_start for r in rows] == [1, 2, 3]


def test_catalog(spark):
    rows = rule_table(spark).collect()
    assert len({r.rule_id for r in rows}) == len(rows) == 59


def test_partitioning_does_not_matter(files_of):
    files = files_of({f"/r/f{i}.py": "for a in b:\n    s += eval(a)\n" * (i + 1) for i in range(20)})
    one = scan_issues(files.coalesce(1)).orderBy("file_path", "line_start", "rule_id").collect()
    many = scan_issues(files.repartition(13)).orderBy("file_path", "line_start", "rule_id").collect()
    assert one == many and one


def test_no_shuffle_for_line_rules(files_of, tmp_path):
    files = files_of({"/r/a.js": REACT})
    plan = scan_rules(files.select("repo_path", "file_path", "language", "content"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    from codesieve.operators.python_blocks import python_block_issues
    plan = python_block_issues(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_long_lines_are_kept_once(files_of):
    """A file that is one line of many findings: keyed issues are small, and the line is one text."""
    from codesieve.plans.scan import scan_keyed

    line = "eval(x); " * 20000
    issues, texts = scan_keyed(files_of({"/r/a.py": line, "/r/b.js": line, "/r/c.js": "eval(x)"}))
    counts = {r.file_path: r.n for r in issues.groupBy("file_path").agg(F.count("*").alias("n")).collect()}
    assert counts == {"/r/a.py": 20000, "/r/b.js": 1, "/r/c.js": 1}
    assert "code_snippet" not in issues.columns and issues.select("text_key").distinct().count() == 2
    assert sorted(r.code_snippet for r in texts.collect()) == ["eval(x)", line]


def test_whole_text_of_long_lines(files_of):
    """Issues show the whole text at any length, also when it is joined late."""
    from codesieve.operators.line_store import with_texts
    from codesieve.plans.scan import scan_keyed

    wide = "x = 'é" + "a" * 5000 + "'; "
    texts = {"/r/a.py": f"eval(y)\n{wide}eval(x)\nif z:\n    {wide}eval(x)\n", "/r/b.js": f"eval(x); {wide}\neval(x)",
             "/r/c.sql": f"SELECT 1;\n  SELECT * FROM t\nWHERE a = '{'b' * 5000}';", "/r/d.json": '{"a": 1, "a": 2}'}
    files = files_of(texts)
    issues = scan_issues(files)
    rows = issues.collect()
    assert sum(len(r.code_snippet or "") > 5000 for r in rows) >= 4
    for r in rows:
        if r.file_path.endswith("sql"):
            assert r.code_snippet in texts[r.file_path]
        elif not r.file_path.endswith("json"):
            assert r.code_snippet == texts[r.file_path].split("\n")[r.line_start - 1]
    late = with_texts(*scan_keyed(files)).select(*issues.columns)
    assert sorted(map(repr, late.collect())) == sorted(map(repr, rows))


def test_deep_loops(files_of):
    loops = "".join("  " * i + "for a in b:\n" for i in range(90))
    files = files_of({"/r/a.py": (loops + "  " * 90 + "s += 1; t += 2\n") * 50})
    assert scan_issues(files).where("rule_id = 'PY-08'").count() == 90 * 2 * 50


def test_rules_of_other_units(files_of):
    """Rules of a user over blocks, keys and lines ahead."""
    from codesieve.operators.catalog import register_rule

    rules = register_rule("X-1", "python", "bug", "info", "d", "r", "kind = 'function' AND NOT exists(body, l -> contains(l, 'return'))", "block", rules=())
    rules = register_rule("X-2", "go", "bug", "info", "d", "r", "contains(text, 'open') AND NOT contains(ahead, 'close')", rules=rules, ahead=2)
    rules = register_rule("X-3", "json", "bug", "info", "d", "r", "text = 'k'", "key", rules=rules)
    rules = register_rule("X-4", "python", "bug", "info", "d", "r", "kind = 'loop' AND size(body) > 2", "block", rules=rules)
    files = files_of({
        "/r/a.py": "def one():\n    x = 'return'\n    # return\ndef two():\n    for i in x:\n        y\n        z\n    return 1\n",
        "/r/b.go": "open\na\nclose\nopen\na\nb\nclose\nopen", "/r/c.json": '{"k": 1, "k": 2, "j": 1, "j": 2}'})
    found = sorted((r.rule_id, r.line_start, r.line_end, r.code_snippet) for r in scan_rules(files, rules).collect())
    assert found == [("X-1", 1, 2, "def one():"), ("X-2", 4, 4, "open"), ("X-2", 8, 8, "open"), ("X-3", 1, 1, "k"),
                     ("X-4", 5, 7, "    for i in x:")]
    for wrong in ({"scope": "block", "language": "go"}, {"scope": "key", "language": "go"}, {"scope": "file", "ahead": 2}):
        with pytest.raises(ValueError):
            register_rule("X-9", wrong.get("language", "go"), "bug", "info", "d", "r", "true", wrong["scope"], ahead=wrong.get("ahead", 0))


def test_files_are_made_once_for_rules_over_whole_files(spark):
    """What contents are computed from is not computed again in a filter below the scan."""
    files = spark.range(3).selectExpr(
        "'/r' AS repo_path", "concat('/r/', id, '.json') AS file_path", "'json' AS language",
        "to_json(array_repeat(repeat('x', int(id) * 20000), 48)) AS content")
    found = scan_rules(files, tuple(r for r in RULES if r.rule_id == "JN-03"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rlike") + plan.count("RLIKE") <= 4 and "size(" not in plan
    assert [(r.file_path, r.rule_id) for r in found.collect()] == [("/r/2.json", "JN-03")]
    assert sorted(r.rule_id for r in scan_rules(files.where("file_path LIKE '%2.json'"), RULES).collect()) == ["JN-03"]
    broken = files.withColumn("content", F.concat("content", F.lit("]")))
    assert scan_rules(broken, tuple(r for r in RULES if r.rule_id == "JN-03")).count() == 0
    assert scan_rules(broken, tuple(r for r in RULES if r.rule_id in ("JN-01", "JN-03"))).count() == 3
