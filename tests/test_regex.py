"""Portable patterns against Python's ``re``, and the traps of long inputs."""

import re

import pytest
from pyspark.sql import functions as F

from codesieve.functions.regex import lstrip, matches, portable, sql_text, strip
from codesieve.operators import catalog
from codesieve.operators.json_files import json_is_valid
from codesieve.operators.python_blocks import masked_text
from codesieve.operators.units import sql_statements

PATTERNS = {n: v for n, v in vars(catalog).items()
            if n.isupper() and isinstance(v, str) and n.split("_")[0] in
            ("PY", "JS", "RN", "CREDENTIAL", "JAVA", "TODO", "GO", "RUST", "SQL")
            and n not in ("TODO",)}
PROBES = [
    'password = "hunter2hunter2"', 'PAſſWORD="hunter2hunter2"', "token:'abc-def_99'", 'secret = "abcdé_-fgh"',
    'api-key\u00a0=\u2003"abcdefghijklmnopqrstuvwxyz"', "} catch (IOException\u00a0e)\u2009{ }", "catch (Exception é) {",
    'String naïve == t', "a.é()", "// \u3000ToDo", "//\x1ffixme", "  é , _ := f()", "x , _ = g()", "if err\u00a0!= nil {}",
    "func Éa", "func Aé", "  unsafe{", "pub fn é()", "v[٣]", "v[12]", "console.log(1)", "a == b", "a\x85==\u2028b",
    "useState\u00a0( {", "<ButtonX", "onClick = {() \r => 1}", "+ \u00a0&x", 'expect("")', "WHERE a OR b", "WHERE éORb",
    "WHERE a ORé", "WHERE OR", "eval\x0b(", "innerHTML \x1c=", ".map(x)", 'execute(f"x")', "",
]


def test_same_as_python(spark):
    lines = spark.createDataFrame([(p,) for p in PROBES], "text string")
    names = sorted(PATTERNS)
    assert len(names) > 25
    for ignore_case in (False, True):
        row = lines.select("text", *[matches(F.col("text"), PATTERNS[n], ignore_case).alias(n) for n in names])
        for r in row.collect():
            for n in names:
                expected = re.search(PATTERNS[n], r.text, (re.I if ignore_case else 0) | re.S) is not None
                assert r[n] == expected, (n, r.text, ignore_case)


def test_same_as_python_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    names = ("CREDENTIAL", "PY_PASSWORD", "JS_SECRET", "RUST_INDEX", "JAVA_BARE_CALL")
    rows = docs.select("text", *[matches(F.col("text"), PATTERNS[n], True).alias(n) for n in names]).collect()
    for r in rows:
        for n in names:
            assert r[n] == (re.search(PATTERNS[n], r.text, re.I | re.S) is not None)


def test_braces_and_sets():
    assert portable("a{2,}{b}") == r"(?s)a{2,}\{b\}"
    assert portable(r"[\w\-]\d", True) == r"(?siu)[\p{L}\p{N}_\-][\p{Nd}]"
    assert portable(r"x", True, "re2") == "(?si)x"


def test_sql_text(spark):
    for text in ("it's", "a\\b", "\\'", "x\ny", '"'):
        assert spark.sql(f"SELECT {sql_text(text)} AS v").first().v == text


def test_strip(spark):
    texts = ["  a ", "\u00a0\x1fa\u3000", "\u2028", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", strip(F.col("t")).alias("s"), lstrip(F.col("t")).alias("l")).collect():
        assert (r.s, r.l) == (r.t.strip(), r.t.lstrip())


@pytest.mark.parametrize("text", [
    "SELECT " + "'a\\'b', " * 60000 + "1; x", "'" * 100001, '"' * 100001, "--\n" * 200000, "a/-" * 200000,
    '"a\\"" ' * 60000, "'''" * 50001, '{"a": [1, 2]}, ' * 40000, "\\" * 300000, "#'\"\n" * 100000,
])
def test_long_texts(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    t = F.col("t")
    assert df.select(F.size(sql_statements(t)), F.length(masked_text(t)), json_is_valid(t)).first() is not None


def test_statements(spark):
    cases = {
        "SELECT 1; SELECT 2": ["SELECT 1;", "SELECT 2"],
        "UPDATE t SET a = ';' WHERE b = 2;\n\n": ["UPDATE t SET a = ';' WHERE b = 2;"],
        "-- don't; stop\nSELECT 1;": ["-- don't; stop\nSELECT 1;"],
        "/* a; 'b */ SELECT \";\";x": ["/* a; 'b */ SELECT \";\";", "x"],
        "SELECT 'it''s;'; y": ["SELECT 'it''s;';", "y"],
        "a - b / c; d'": ["a - b / c;", "d'"],
        "": [], " \n ": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", sql_statements(F.col("t")).alias("s")).collect():
        assert [s.strip() for s in r.s] == cases[r.t]
