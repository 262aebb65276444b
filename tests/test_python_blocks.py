"""Block rules against Python's own syntax tree."""

import ast
import glob
import os
import sysconfig
from collections import Counter

from codesieve.operators.python_blocks import python_block_issues


# Rule, node type, condition, and how the node shows: its own line, its lines, or its first line only.
OWN, WHOLE, FIRST = range(3)
FUNCTIONS = ast.FunctionDef
TABLE = (
    ("PY-03", ast.Call, lambda n: getattr(n.func, "id", None) in ("eval", "exec"), FIRST),
    ("PY-04", ast.ExceptHandler, lambda n: n.type is None, WHOLE),
    ("PY-05", FUNCTIONS, lambda n: sum(type(d) in (ast.List, ast.Dict, ast.Set) for d in n.args.defaults), OWN),
    ("PY-06", FUNCTIONS, lambda n: n.end_lineno - n.lineno > 50, WHOLE),
    ("PY-07", FUNCTIONS, lambda n: len(n.args.args) > 5, OWN),
)


def by_ast(path, content):
    """(path, rule, first line, last line) of each node a row of the table holds for, as often as
    it holds; PY-08 for each ``+=`` and loop around it. PY-03 without the last line."""
    nodes = list(ast.walk(ast.parse(content)))
    shown = {OWN: lambda n: n.lineno, WHOLE: lambda n: n.end_lineno, FIRST: lambda n: None}
    found = [(path, rule, n.lineno, shown[show](n)) for rule, kind, holds, show in TABLE
             for n in nodes if isinstance(n, kind) for _ in range(int(holds(n)))]
    inside = [m for loop in nodes if isinstance(loop, (ast.For, ast.While)) for m in ast.walk(loop)]
    return found + [(path, "PY-08", m.lineno, m.end_lineno) for m in inside
                    if isinstance(m, ast.AugAssign) and isinstance(m.op, ast.Add)]


def ours(files):
    rows = python_block_issues(files).collect()
    return [(r.file_path, r.rule_id, r.line_start, None if r.rule_id == "PY-03" else r.line_end) for r in rows]


def test_standard_library(files_of):
    root = sysconfig.get_paths()["stdlib"]
    contents = {}
    for path in sorted(glob.glob(os.path.join(root, "*.py")) + glob.glob(os.path.join(root, "*", "*.py"))):
        with open(path, encoding="utf-8", errors="ignore") as file:
            text = file.read()
        if "site-packages" in path or "\f" in text or not text or len(contents) >= 400:
            continue
        try:
            ast.parse(text)
        except (SyntaxError, ValueError):
            continue
        contents[path] = text
    expected = Counter(row for path, text in contents.items() for row in by_ast(path, text))
    found = Counter(ours(files_of(contents)))
    kinds = Counter(row[1] for row in expected.elements())
    assert len(contents) > 200 and all(kinds[f"PY-0{n}"] > 10 for n in range(3, 9))
    missing, extra = expected - found, found - expected
    assert not missing and not extra, (sorted(missing)[:10], sorted(extra)[:10])


CASES = {
    "nested loops count twice": "for a in x:\n    for b in y:\n        s += b\n",
    "loop else belongs to the loop": "for a in x:\n    pass\nelse:\n    s += 1\ns += 2\n",
    "empty else": "for a in x:\n    pass\nelse: s += 1\ns += 2\n",
    "one-line loop with else": "for a in x: s += a\nelse: t += a\nu += 1\n",
    "one-line loop": "for a in x: s += a\nt += a\n",
    "two on a line": "while a:\n    s += 1; t += 2\n",
    "span 50": "def f():\n" + "    x = 1\n" * 50,
    "span 51": "def f():\n" + "    x = 1\n" * 51,
    "blank and comment lines at the end": "def f():\n    x = 1\n" + "\n# c\n" * 40 + "y = 2\n",
    "five parameters": "def f(a, b, c, d, e): pass\n",
    "six parameters": "def f(self, b, c, d, e, g): pass\n",
    "keyword only and star": "def f(a, b, c, d, e, *args, g=1, **k): pass\ndef g(a, *, b=[], c={}): pass\n",
    "positional only": "def f(a, b, c, /, d, e, g, h=[], i={}): pass\n",
    "two mutable defaults": "def f(a=[], b={1}, c=(), d={}): pass\n",
    "default is no bare display": "def f(a=[1][0], b=[] or None, c=list()): pass\n",
    "commas of a lambda": "def f(a, b=lambda p, q, r, s, t: 0, c=lambda: [], d=[]): pass\n",
    "lambda in a lambda": "def f(a=lambda p, q=[1, 2]: lambda r, s: {p: q}, b=1, c=2, d=3, e=4): pass\n",
    "comprehensions": "def f(a=[x for x in y], b={x for x in y}, c={x: [] for x in y}, d=[[x for x in y]]): pass\n",
    "deep brackets": "def f(a=" + "(" * 9 + "[1], 2" + ")" * 9 + ", b=[], c=1, d=1, e=1, g=1):\n    pass\n",
    "annotated": "def f(a: Dict[str, int] = {}, b: Tuple[int, str] = ()) -> List[int]:\n    pass\n",
    "async": "async def f(a=[], b=1, c=2, d=3, e=4, g=5):\n" + "    x = 1\n" * 60
             + "    try:\n        eval(a)\n    except:\n        pass\n",
    "async loop": "async def f():\n    async for a in b:\n        s += a\n    while s:\n        s += 1\n",
    "bare except spans its body": "try:\n    a()\nexcept:\n    b()\n\n    c()\nfinally:\n    d()\n",
    "multi-line signature": "def f(\n    a,\n    b=[],  # note (\n    c=')',\n):\n    '''doc\n    def g(x=[]): '''\n    return 1\n",
    "strings and comments": "x = 'eval(1)'  # exec(2)\ny = '''\neval(3)\nfor a in b:\n    s += 1\n'''\neval(x)\n",
    "calls by attribute": "a.eval(1)\nb.exec(2)\nevaluate(3)\nexec(code); eval(code)\n",
    "backslash": "x = 1 + \\\n    2\nfor a in b:\n    x += \\\n        a\ny += 1\n",
    "nested functions": "def f():\n    def g(a=[]):\n        for x in a:\n            s += 1\n    return g\n",
    "class body": "class A:\n    def f(self, a={}):\n        while True:\n            if a:\n                a += 1\n            else:\n                a += 2\n",
    "if else after loop": "if a:\n    for x in y:\n        s += 1\nelse:\n    s += 2\n",
    "tabs": "def f(a=[]):\n\tfor x in a:\n\t\ts += 1\n\treturn s\n",
    "decorator": "@d(1)\ndef f(a=[]):\n    pass\n",
    "names like keywords": "forward = 1\nwhile_x = 2\nforward += 1\ndefault = []\nexcept_ = 3\n",
}


def test_cases(files_of):
    contents = {f"/r/{name}.py": text for name, text in CASES.items()}
    expected = Counter(row for path, text in contents.items() for row in by_ast(path, text))
    assert Counter(ours(files_of(contents))) == expected


def test_texts(files_of):
    source = "def f(a, b, c, d, e, g=[]):\n" + "    x = 1\n" * 51 + "exec(\n  y\n)\n"
    rows = {r.rule_id: r for r in python_block_issues(files_of({"/r/a.py": source})).collect()}
    assert rows["PY-05"].description == "Function 'f' has mutable default argument"
    assert rows["PY-06"].description == "Function 'f' is too long (51 lines)"
    assert (rows["PY-06"].line_start, rows["PY-06"].line_end) == (1, 52)
    assert rows["PY-07"].description == "Function 'f' has too many parameters (6)"
    assert rows["PY-03"].description == "Use of 'exec' function can be dangerous"
    assert rows["PY-03"].recommendation == "Avoid using exec()."
    assert (rows["PY-03"].line_start, rows["PY-03"].line_end) == (53, 55)
    assert rows["PY-05"].code_snippet == "def f(a, b, c, d, e, g=[]):"


def test_lines_of_a_task_are_bounded(spark):
    """Many small files: their texts are little to shuffle, their lines are many to sort."""
    from pyspark.sql import functions as F

    from codesieve.operators.python_blocks import logical_lines

    files = spark.range(200).select(
        F.concat(F.lit("/r"), (F.col("id") % 4).cast("string")).alias("repo_path"), F.concat(F.lit("/r/"), F.col("id").cast("string"), F.lit(".py")).alias("file_path"),
        F.lit("python").alias("language"), F.repeat(F.lit("x += 1\n"), F.lit(1000)).alias("content"))
    counts = logical_lines(files).select("k").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(counts) == 200_000 and max(counts) <= 40_000
