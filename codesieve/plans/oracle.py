"""SQL twins of the queries, for a plain SQL engine over the same tables.

They state the meaning of each operator in the most direct relational form: windows over
lines instead of arrays, self joins instead of event streams, recursion instead of blocks.
Fixed texts and patterns come from the catalog; the logic is written anew.
"""

from __future__ import annotations

from codesieve.functions.regex import SPACE, portable
from codesieve.operators import catalog
from codesieve.operators.catalog import BLOCK_RULES, OPTIONAL_RULES, RULES
from codesieve.operators.reviews import BATCH_HEAD, BATCH_TAIL, SINGLE_PROMPT
from codesieve.plans.corpora import (
    FUNCTION_LINE,
    FUNCTION_LINES,
    LONG_FILE_LINES,
    REACT_LINE,
    REACT_NATIVE_LINE,
    template_lines,
)
from codesieve.settings import FRAMEWORK_MARKERS, LANGUAGE_PROFILES


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rx(pattern: str, ignore_case: bool = False, column: str = "line") -> str:
    return f"regexp_matches({column}, {_q(portable(pattern, ignore_case, engine='re2'))})"


def _has(*texts: str, column: str = "line") -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(t)})" for t in texts) + ")"


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join(
        "(" + ", ".join(_q(v) if isinstance(v, str) else str(v).lower() for v in row) + ")"
        for row in rows)


LANGS = "['python', 'javascript', 'java', 'go', 'rust', 'sql']"
EXTS = "['.py', '.js', '.java', '.go', '.rs', '.sql']"
_TEMPLATES = _values([(i, line) for i, line in enumerate(template_lines())])



def _code_lines(per_file: int = 50) -> str:
    return f"""
templates(number, template) AS ({_TEMPLATES}),
numbered AS (
  SELECT o_orderkey, o_orderdate AS modified_at, o_orderkey // {per_file} AS file_no,
         CAST(o_orderkey % {per_file} + 1 AS INTEGER) AS line_no,
         (o_orderkey // {per_file}) % 6 AS lang_no, (o_custkey + o_orderkey) % 20 AS t
  FROM orders),
lines AS (
  SELECT o_orderkey, modified_at, file_no, line_no, '/repo' || (file_no % 4) AS repo_path,
         '/repo' || (file_no % 4) || '/src/f' || file_no || {EXTS}[lang_no + 1] AS file_path,
         {LANGS}[lang_no + 1] AS language,
         CASE WHEN lang_no = 1 AND line_no = 1 AND file_no % 12 = 1 THEN {_q(REACT_NATIVE_LINE)}
              WHEN lang_no = 1 AND line_no = 1 THEN {_q(REACT_LINE)}
              ELSE template END AS line
  FROM numbered JOIN templates ON number = lang_no * 20 + t)"""


LINES = _code_lines()

SCAN_LINES = LINES + ", code AS (SELECT '' AS scan_id, * FROM lines)"
SNAPSHOT_LINES = LINES + """,
picked AS (
  SELECT 'previous' AS scan_id, * FROM lines WHERE o_orderkey % 11 <> 0
  UNION ALL SELECT 'current', * FROM lines WHERE o_orderkey % 13 <> 0),
code AS (
  SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY scan_id, file_path ORDER BY line_no) AS INTEGER) AS line_no)
  FROM picked)"""

TREE_LINES = LINES + """,
picked AS (
  SELECT 'previous' AS scan_id, * FROM lines WHERE file_no % 29 <> 3 AND NOT (file_no % 19 = 5 AND o_orderkey % 3 = 0)
  UNION ALL SELECT 'current', * FROM lines WHERE file_no % 31 <> 4),
code AS (
  SELECT * REPLACE (
    CAST(row_number() OVER (PARTITION BY scan_id, file_path ORDER BY line_no) AS INTEGER) AS line_no,
    replace(file_path, '/src/', '/src/d' || (file_no % 7) || '/m' || (file_no % 35) || '/') AS file_path)
  FROM picked)"""

LONG_LINES = _code_lines(LONG_FILE_LINES) + f""",
code AS (
  SELECT '' AS scan_id, * REPLACE (
    CASE WHEN language <> 'python' THEN line
         WHEN line_no % {FUNCTION_LINES} = 1 THEN {_q(FUNCTION_LINE)} ELSE '    ' || line END AS line)
  FROM lines)"""
PADDED_LINES = LINES + """,
picked AS (
  SELECT 'previous' AS scan_id, * FROM lines WHERE o_orderkey % 11 <> 0
  UNION ALL SELECT 'current', * FROM lines WHERE o_orderkey % 13 <> 0),
code AS (
  SELECT * REPLACE (
    CAST(row_number() OVER (PARTITION BY scan_id, file_path ORDER BY line_no) AS INTEGER) AS line_no,
    CASE WHEN scan_id = 'current' THEN '    ' ELSE '' END || line
      || CASE WHEN o_orderkey % 3 = 0 THEN repeat(' pad', 1200) ELSE '' END AS line)
  FROM picked)"""

FILES = """
files AS (
  SELECT scan_id, repo_path, file_path, language, file_no, max(modified_at) AS modified_at,
         string_agg(line, chr(10) ORDER BY line_no) AS content
  FROM code GROUP BY ALL)"""

CONTEXT = FILES + f""",
ctx AS (
  SELECT c.*,
         lag(c.line) OVER w AS prev_line,
         contains(f.content, 'react-native') AS native,
         contains(f.content, 'import React') OR contains(f.content, 'react-native')
           OR contains(f.content, 'from ''react''') OR contains(f.content, 'from "react"') AS react,
         contains(lower(f.content), 'password') OR contains(lower(f.content), 'token') AS sensitive,
         contains(upper(f.content), 'LIMIT') AS limited,
         coalesce(bool_or(contains(c.line, 'key=')) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), false) AS ahead_key,
         coalesce(bool_or(contains(c.line, 'accessible')) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), false) AS ahead_accessible,
         coalesce(bool_or(contains(c.line, 'keyExtractor')) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), false) AS ahead_extractor
  FROM code c JOIN files f USING (scan_id, file_path)
  WINDOW w AS (PARTITION BY c.scan_id, c.file_path ORDER BY c.line_no))"""

_LSTRIP_PREV = f"regexp_replace(prev_line, '^[{SPACE}]+', '')"
_TODO = (_rx(catalog.TODO_COMMENT, True),
         f"regexp_extract(line, {_q(portable(catalog.TODO_MARKER, True, 're2'))}, 1)")


def _undocumented(pattern: str, start: str) -> str:
    return (f"{_rx(pattern)} AND prev_line IS NOT NULL "
            f"AND NOT starts_with({_LSTRIP_PREV}, {_q(start)})")


LINE_RULES: dict[str, str | tuple[str, str]] = {
    "PY-01": f"{_rx(catalog.PY_PASSWORD, True)}",
    "PY-02": f"{_rx(catalog.PY_API_KEY, True)} AND NOT {_rx(catalog.PY_PASSWORD, True)}",
    "JS-01": f"{_rx(catalog.JS_API_KEY, True)}",
    "JS-02": f"{_rx(catalog.JS_SECRET, True)} AND NOT {_rx(catalog.JS_API_KEY, True)}",
    "JS-03": _rx(catalog.JS_EVAL),
    "JS-04": _has("dangerouslySetInnerHTML"),
    "JS-05": _rx(catalog.JS_INNER_HTML),
    "JS-06": f"{_rx(catalog.JS_LOOSE_EQUAL)} AND NOT contains(split_part(line, '==', 1), '//')",
    "JS-07": f"{_rx(catalog.JS_CONSOLE)} AND NOT " + _rx(r"^\s*//"),
    "JS-08": f"len(regexp_extract_all(line, {_q(catalog.JS_ARRAY_CALL)})) > 1",
    "JS-10": "react AND contains(line, '.map(') AND contains(line, 'return') "
             "AND NOT contains(line, 'key=') AND NOT ahead_key",
    "JS-11": f"react AND {_rx(catalog.JS_INLINE_HANDLER)}",
    "JS-13": f"react AND {_rx(catalog.JS_STATE_OBJECT)}",
    "RN-01": f"native AND {_rx(catalog.RN_TOUCHABLE)} AND NOT ahead_accessible",
    "RN-02": "native AND contains(line, '<FlatList') AND NOT ahead_extractor",
    "JV-01": _rx(catalog.CREDENTIAL_EQUALS, True),
    "JV-02": _has("executeQuery(", "executeUpdate(") + " AND " + _has("+", "String.format"),
    "JV-03": "contains(line, 'ObjectInputStream') AND contains(line, 'readObject')",
    "JV-04": _rx(catalog.JAVA_EMPTY_CATCH),
    "JV-05": _rx(catalog.JAVA_CATCH_ALL),
    "JV-06": f"({_rx(catalog.JAVA_STRING_EQUAL)} OR {_rx(catalog.JAVA_LITERAL_EQUAL)})",
    "JV-07": _has("for(", "for (", "while(", "while (") + " AND contains(line, '+=') AND contains(line, '\"')",
    "JV-08": _has("new Vector"),
    "JV-09": _TODO,
    "JV-10": _undocumented(catalog.JAVA_PUBLIC_METHOD, "/**"),
    "JV-11": f"{_rx(catalog.JAVA_BARE_CALL)} AND contains(lower(line), 'null')",
    "JV-12": "contains(line, 'new Random()') AND sensitive",
    "GO-01": _rx(catalog.CREDENTIAL, True),
    "GO-02": _has("Exec(", "Query(") + " AND " + _has("+", "fmt.Sprintf"),
    "GO-03": _rx(catalog.GO_IGNORED_ERROR),
    "GO-04": _rx(catalog.GO_EMPTY_CHECK),
    "GO-05": "contains(line, 'for ') AND " + _has("+=", "= ") + " AND contains(line, '\"')",
    "GO-06": _TODO,
    "GO-07": _undocumented(catalog.GO_EXPORTED, "//"),
    "GO-08": _has('import "unsafe"', "import unsafe"),
    "RS-01": _rx(catalog.CREDENTIAL, True),
    "RS-02": _rx(catalog.RUST_UNSAFE),
    "RS-03": _has(".unwrap()"),
    "RS-04": _rx(catalog.RUST_EMPTY_EXPECT),
    "RS-05": "contains(line, 'for ') AND contains(line, '.clone()')",
    "RS-06": f"{_rx(catalog.RUST_STRING_PLUS)} AND contains(line, 'String')",
    "RS-07": _TODO,
    "RS-08": _undocumented(catalog.RUST_PUBLIC_FN, "///"),
    "RS-09": f"{_rx(catalog.RUST_INDEX)} AND NOT contains(lower(line), 'vec!')",
    "RS-10": "contains(line, 'println!') AND " + _has("input", "user", column="lower(line)"),
    "SQ-03": "contains(upper(line), 'CROSS JOIN') AND NOT limited",
    "SQ-04": _rx(catalog.SQL_WHERE_OR, column="upper(line)"),
}
PREFIX = {"PY": "python", "JS": "javascript", "RN": "javascript", "JV": "java", "GO": "go",
          "RS": "rust", "SQ": "sql"}


def _line_hits(rule_ids: list[str], first_lines: int | None = None) -> str:
    parts = []
    for rule_id in rule_ids:
        entry = LINE_RULES[rule_id]
        predicate, detail = entry if isinstance(entry, tuple) else (entry, "''")
        if first_lines and rule_id in ("PY-01", "PY-02", "JS-01", "JS-02"):
            predicate = f"line_no <= {first_lines} AND {predicate}"
        parts.append(
            f"SELECT scan_id, repo_path, file_path, '{rule_id}' AS rule_id, line_no AS line_start, "
            f"line_no AS line_end, {detail} AS d1, '' AS d2, line AS code_snippet FROM ctx "
            f"WHERE language = '{PREFIX[rule_id[:2]]}' AND {predicate}")
    return "line_hits AS (" + " UNION ALL ".join(parts) + ")"


SQL_HITS = f"""
statements AS (
  SELECT scan_id, repo_path, file_path, regexp_replace(s, '^[{SPACE}]+', '') AS s
  FROM (SELECT *, unnest(regexp_extract_all(content, '(?:[^;''"]|''[^'']*''|"[^"]*")+;?')) AS s
        FROM files WHERE language = 'sql')),
sql_hits AS (
  SELECT scan_id, repo_path, file_path, 'SQ-01' AS rule_id, 1 AS line_start, 1 AS line_end,
         '' AS d1, '' AS d2, s AS code_snippet
  FROM statements WHERE contains(upper(s), 'SELECT *') OR contains(upper(s), 'SELECT*')
  UNION ALL
  SELECT scan_id, repo_path, file_path, 'SQ-02', 1, 1, regexp_extract(upper(s), '^[A-Z;]+'), '', s
  FROM statements
  WHERE (starts_with(upper(s), 'DELETE') OR starts_with(upper(s), 'UPDATE')) AND NOT contains(upper(s), 'WHERE'))"""

# Block rules by definition: a block ends before the next statement line of at most its indent.
BLOCK_HITS = r"""
masked AS (
  SELECT scan_id, repo_path, file_path, line_no, line,
         regexp_replace(regexp_replace(line, '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''', '""', 'g'), '#.*', '') AS m
  FROM code WHERE language = 'python'),
stmts AS (
  SELECT *, row_number() OVER (PARTITION BY scan_id, file_path ORDER BY line_no) AS k,
         length(regexp_extract(m, '^ *')) AS indent
  FROM masked WHERE trim(m) <> ''),
headers AS (
  SELECT * FROM (
    SELECT *, CASE WHEN regexp_matches(m, '^\s*def\s') THEN 'def'
                   WHEN regexp_matches(m, '^\s*(for|while)\b') THEN 'loop'
                   WHEN regexp_matches(m, '^\s*except\s*:') THEN 'except' END AS kind FROM stmts)
  WHERE kind IS NOT NULL),
blocks AS (
  SELECT h.*, coalesce(
      (SELECT min(s.k) - 1 FROM stmts s
       WHERE s.scan_id = h.scan_id AND s.file_path = h.file_path AND s.k > h.k AND s.indent <= h.indent
         AND NOT (h.kind = 'loop' AND s.indent = h.indent AND regexp_matches(s.m, '^\s*else\s*:'))),
      (SELECT max(s.k) FROM stmts s WHERE s.scan_id = h.scan_id AND s.file_path = h.file_path)) AS end_k
  FROM headers h),
ended AS (
  SELECT b.*, s.line_no AS end_line FROM blocks b
  JOIN stmts s ON s.scan_id = b.scan_id AND s.file_path = b.file_path AND s.k = b.end_k),
defs AS (
  SELECT *, regexp_extract(m, 'def\s+(\w+)', 1) AS name, 
         regexp_replace(regexp_extract(m, '\((.*)\)', 1), 'lambda[^:]*:', 'lambda:', 'g') AS params
  FROM ended WHERE kind = 'def'),
block_hits AS (
  SELECT scan_id, repo_path, file_path, 'PY-03' AS rule_id, line_no AS line_start, line_no AS line_end,
         call AS d1, '' AS d2, line AS code_snippet
  FROM (SELECT *, unnest(regexp_extract_all(m, '(^|[^\p{L}\p{N}_.])(eval|exec)\s*\(', 2)) AS call FROM stmts)
  UNION ALL
  SELECT scan_id, repo_path, file_path, 'PY-04', line_no, end_line, '', '', line FROM ended WHERE kind = 'except'
  UNION ALL
  SELECT scan_id, repo_path, file_path, 'PY-05', line_no, line_no, name, '', line
  FROM (SELECT *, unnest(list_filter(regexp_extract_all(params, '=\s*(?:\[[^\[\]]*\]|\{[^{}]*\})'),
                                     lambda x: NOT contains(x, ' for '))) AS one FROM defs)
  UNION ALL
  SELECT scan_id, repo_path, file_path, 'PY-06', line_no, end_line, name, CAST(end_line - line_no AS VARCHAR), line
  FROM defs WHERE end_line - line_no > 50
  UNION ALL
  SELECT scan_id, repo_path, file_path, 'PY-07', line_no, line_no, name,
         CAST(len(string_split(params, ',')) AS VARCHAR), line
  FROM defs WHERE len(string_split(params, ',')) > 5
  UNION ALL
  SELECT a.scan_id, a.repo_path, a.file_path, 'PY-08', a.line_no, a.line_no, '', '', a.line
  FROM stmts a JOIN ended l ON l.kind = 'loop' AND l.scan_id = a.scan_id AND l.file_path = a.file_path
       AND a.k BETWEEN l.k AND l.end_k
  WHERE contains(a.m, '+='))"""

_CATALOG = "catalog(rule_id, category, severity, description, recommendation) AS (" + _values(
    [(r.rule_id, r.category, r.severity, r.description, r.recommendation)
     for r in RULES + BLOCK_RULES + OPTIONAL_RULES]) + ")"


def _issues(*sources: str) -> str:
    union = " UNION ALL ".join(f"SELECT * FROM {s}" for s in sources)
    return f"""{_CATALOG},
issues AS (
  SELECT h.scan_id, h.repo_path, h.file_path, h.rule_id, c.category, c.severity,
         CAST(h.line_start AS INTEGER) AS line_start, CAST(h.line_end AS INTEGER) AS line_end,
         CASE WHEN h.rule_id IN ('PY-06', 'PY-07')
              THEN replace(replace(c.description, '({{}}', '(' || h.d2), '{{}}', h.d1)
              ELSE replace(c.description, '{{}}', h.d1) END AS description,
         replace(c.recommendation, '{{}}', h.d1) AS recommendation, h.code_snippet
  FROM ({union}) h JOIN catalog c USING (rule_id))"""


ISSUE = ("repo_path, file_path, rule_id, category, severity, line_start, line_end, description, "
         "recommendation, code_snippet")


def _scan(prefixes: tuple[str, ...] = (), blocks: bool = False, lines: str = SCAN_LINES,
          first_lines: int | None = None) -> str:
    """WITH clause that ends in ``issues`` of the rules with one of the prefixes (all if none)."""
    ids = [r for r in LINE_RULES if not prefixes or r.startswith(prefixes)]
    statements = not prefixes or "SQ" in prefixes
    parts = ["WITH " + lines.strip(), CONTEXT]
    sources = []
    if ids:
        parts.append(_line_hits(ids, first_lines))
        sources.append("line_hits")
    if statements:
        parts.append(SQL_HITS)
        sources.append("sql_hits")
    if blocks:
        parts.append(BLOCK_HITS)
        sources.append("block_hits")
    parts.append(_issues(*sources))
    return ",\n".join(parts)


def _blocks_only() -> str:
    return ",\n".join(["WITH " + SCAN_LINES.strip(), BLOCK_HITS, _issues("block_hits")])


ORACLE: dict[str, str] = {
    "scan_issues_all": f"{_scan(blocks=True)} SELECT {ISSUE} FROM issues",
    "streaming_scan": f"{_scan(blocks=True)} SELECT {ISSUE} FROM issues",
    "rules_python_secrets": f"{_scan(('PY',))} SELECT {ISSUE} FROM issues",
    "rules_python_blocks": f"{_blocks_only()} SELECT {ISSUE} FROM issues",
    "rules_long_files": f"{_scan(blocks=True, lines=LONG_LINES)} SELECT {ISSUE} FROM issues",
    "rules_first_lines": f"{_scan(('PY', 'JS-0'), lines=LONG_LINES, first_lines=500)} SELECT {ISSUE} FROM issues",
    "rules_js": f"{_scan(('JS', 'RN'))} SELECT {ISSUE} FROM issues",
    "rules_java": f"{_scan(('JV',))} SELECT {ISSUE} FROM issues",
    "rules_go": f"{_scan(('GO',))} SELECT {ISSUE} FROM issues",
    "rules_rust": f"{_scan(('RS',))} SELECT {ISSUE} FROM issues",
    "rules_react_lookahead": f"{_scan(('JS-10', 'RN-01', 'RN-02'))} SELECT {ISSUE} FROM issues",
    "rules_doc_comment": f"{_scan(('JV-10', 'GO-07', 'RS-08'))} SELECT {ISSUE} FROM issues",
    "rules_sql_statements": f"{_scan(('SQ',))} SELECT {ISSUE} FROM issues",
}

_PY10 = next(r for r in OPTIONAL_RULES if r.rule_id == "PY-10")
ORACLE["rules_python_sql_format"] = f"""
WITH {SCAN_LINES.strip()},
last AS (SELECT file_path, max(line_no) AS last_no FROM code GROUP BY ALL),
changed AS (
  SELECT repo_path, file_path, line_no,
         replace(CASE WHEN ends_with(line, '= 1') AND line_no < last_no
                      THEN left(line, length(line) - 3) || '= db.execute("x" % 1)' ELSE line END,
                 '(src)', '.raw(f"{{src}}")') AS line
  FROM code JOIN last USING (file_path) WHERE language = 'python')
SELECT repo_path, file_path, 'PY-10' AS rule_id, '{_PY10.category}' AS category,
       '{_PY10.severity}' AS severity, line_no AS line_start, line_no AS line_end,
       {_q(_PY10.description)} AS description, {_q(_PY10.recommendation)} AS recommendation,
       line AS code_snippet
FROM changed
WHERE regexp_matches(line, '\\.(execute|executemany|raw)\\(([fF]["'']|["''][^"'']*["''] ?%)')"""

ORACLE["rules_custom"] = f"""
WITH {SCAN_LINES.strip()}
SELECT repo_path, file_path, 'X-01' AS rule_id, 'architecture' AS category, 'info' AS severity,
       line_no AS line_start, line_no AS line_end, 'Method with receiver' AS description,
       'Review the receiver.' AS recommendation, line AS code_snippet
FROM code WHERE language = 'go' AND line LIKE 'func (%'
UNION ALL
SELECT repo_path, file_path, 'X-02', 'bug', 'warning', line_no, line_no, 'Index zero', 'Use first().', line
FROM code WHERE language = 'rust' AND line LIKE '%[0]%' AND line_no > 1"""

# --- JSON ---------------------------------------------------------------------------

JSON_FILES = """
json_files AS (
  SELECT '/events' AS repo_path, '/events/e' || event_id || '.json' AS file_path,
    CASE event_id % 8
      WHEN 0 THEN props
      WHEN 1 THEN '{"k": ' || user_id || ', "n": ' || props || ', "list": [' || props || ', ' || props || ']}'
      WHEN 2 THEN props || ' x'
      WHEN 3 THEN left(props, length(props) - 1)
      WHEN 4 THEN repeat('{"d":', event_id % 14) || props || repeat('}', event_id % 14)
      WHEN 5 THEN repeat('[', event_id % 14) || repeat(']', event_id % 14)
      WHEN 6 THEN '{"a": 1, "a": ' || user_id || ', "b": {"a": [' || props || ']}}'
      ELSE '"' || event_type || '"' END AS content
  FROM events),
checked AS (SELECT *, json_valid(content) AS ok FROM json_files WHERE content <> '')"""


def _json(rule_id: str, rows: str, description: str, snippet: str = "CAST(NULL AS VARCHAR)") -> str:
    rule = next(r for r in RULES if r.rule_id == rule_id)
    return f"""WITH {JSON_FILES.strip()}
SELECT repo_path, file_path, '{rule_id}' AS rule_id, '{rule.category}' AS category,
       '{rule.severity}' AS severity, 1 AS line_start, 1 AS line_end, {description} AS description,
       {_q(rule.recommendation)} AS recommendation, {snippet} AS code_snippet
FROM ({rows})"""


ORACLE["rules_json_valid"] = _json("JN-01", "SELECT * FROM checked WHERE NOT ok", "'Invalid JSON'")
ORACLE["rules_json_keys"] = _json("JN-02", r"""
  SELECT *, unnest(range(n - 1)) FROM (
    SELECT repo_path, file_path, key, count(*) AS n FROM (
      SELECT *, unnest(regexp_extract_all(content, '"([^"]+)"\s*:', 1)) AS key FROM checked WHERE ok)
    GROUP BY ALL) WHERE n > 1""",
    "'Duplicate key ''' || key || ''' found in JSON'", "key")
ORACLE["rules_custom_units"] = rf"""WITH {SCAN_LINES.strip()}, {BLOCK_HITS.strip()}, {JSON_FILES.strip()}
SELECT file_path, 'X-03' AS rule_id, CAST(line_no AS INTEGER) AS line_start, CAST(end_line AS INTEGER) AS line_end,
       line AS code_snippet
FROM ended e WHERE kind = 'def' AND NOT EXISTS (
  FROM stmts s WHERE s.scan_id = e.scan_id AND s.file_path = e.file_path AND s.k BETWEEN e.k AND e.end_k
  AND regexp_matches(s.m, '(^|[^a-z])return([^a-z]|$)'))
UNION ALL
SELECT file_path, 'X-04', line_no, line_no, line FROM code c
WHERE language = 'go' AND contains(line, 'err != nil') AND NOT EXISTS (
  FROM code n WHERE n.file_path = c.file_path AND n.line_no BETWEEN c.line_no + 1 AND c.line_no + 7
  AND contains(n.line, 'return'))
UNION ALL
SELECT file_path, 'X-05', 1, 1, 'a' FROM (
  SELECT *, unnest(range(n - 1)) FROM (
    SELECT file_path, count(*) AS n FROM (
      SELECT *, unnest(regexp_extract_all(content, '"([^"]+)"\s*:', 1)) AS key FROM checked WHERE ok)
    WHERE key = 'a' GROUP BY ALL) WHERE n > 1)"""
ORACLE["rules_json_depth"] = _json("JN-04", r"""
  SELECT repo_path, file_path, max(CASE WHEN mark IN ('[', '{') THEN depth
                                        WHEN mark = 'v' THEN depth + 1 ELSE 0 END) AS deepest
  FROM (
    SELECT repo_path, file_path, mark, sum(CASE WHEN mark IN ('[', '{') THEN 1 WHEN mark IN (']', '}') THEN -1 ELSE 0 END)
             OVER (PARTITION BY file_path ORDER BY pos) AS depth
    FROM (
      SELECT repo_path, file_path, unnest(marks) AS mark, unnest(range(len(marks))) AS pos
      FROM (SELECT repo_path, file_path, string_split(regexp_replace(regexp_replace(
              regexp_replace(content, '"(?:[^"\\]|\\.)*"', '0', 'g'), '\s+', '', 'g'),
              '[^\[\]{}]+', 'v', 'g'), '') AS marks
            FROM checked WHERE ok)))
  GROUP BY ALL HAVING deepest > 10""",
    "'Deeply nested JSON structure (depth: ' || deepest || ')'")
ORACLE["rules_json_large"] = f"""
SELECT '/docs/' || source AS repo_path, '/docs/' || source || '/' || doc_id AS file_path, 'JN-03' AS rule_id,
       'performance' AS category, 'warning' AS severity, 1 AS line_start, 1 AS line_end,
       'Large JSON file (' || (chars // 1024) || 'KB)' AS description,
       {_q(next(r for r in RULES if r.rule_id == 'JN-03').recommendation)} AS recommendation
FROM (SELECT *, (length(CAST(to_json([text]) AS VARCHAR)) - 2) * 48 + 49 AS chars FROM documents)
WHERE chars > 1048576"""

# --- secrets, lines, functions --------------------------------------------------------


def _secret_lines(source: str, ids: str, text: str) -> str:
    return f"""
SELECT {ids}, CAST(line_no AS INTEGER) AS line_no, line FROM (
  SELECT {ids}, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS line_no
  FROM (SELECT {ids}, string_split({text}, chr(10)) AS parts FROM {source}))
WHERE {_rx(catalog.CREDENTIAL, True)}"""


ORACLE["secrets_in_documents"] = _secret_lines("documents", "doc_id", "text")
ORACLE["secrets_in_pages"] = _secret_lines("pages", "page_id", "replace(html, '&quot;', '\"')")
_RS01 = next(r for r in RULES if r.rule_id == "RS-01")
_RS07 = next(r for r in RULES if r.rule_id == "RS-07")
ORACLE["scan_distinct"] = f"""
WITH numbered AS (
  SELECT '/docs/' || source AS repo_path, '/docs/' || source || '/' || doc_id AS file_path,
         CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS line_start, unnest(parts) AS line
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents)),
hits AS (
  SELECT *, '{_RS01.rule_id}' AS rule_id, '{_RS01.category}' AS category, '{_RS01.severity}' AS severity,
         {_q(_RS01.description)} AS description, {_q(_RS01.recommendation)} AS recommendation
  FROM numbered WHERE {_rx(catalog.CREDENTIAL, True)}
  UNION ALL
  SELECT *, '{_RS07.rule_id}', '{_RS07.category}', '{_RS07.severity}',
         replace({_q(_RS07.description)}, '{{}}', {_TODO[1]}), {_q(_RS07.recommendation)}
  FROM numbered WHERE {_TODO[0]})
SELECT repo_path, file_path, rule_id, category, severity, line_start, line_start AS line_end,
       description, recommendation,
       line AS code_snippet
FROM hits"""
ORACLE["numbered_lines"] = """
SELECT doc_id, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS line_no, unnest(parts) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)"""
_AROUND = """
total AS (SELECT file_path, max(line_no) AS n FROM code GROUP BY ALL),
wanted AS (
  SELECT DISTINCT file_path, line_start, greatest(line_start - 2, 1) AS context_start,
         least(line_start + 2, n) AS context_end
  FROM issues JOIN total USING (file_path)),
around AS (
  SELECT w.file_path, w.line_start, w.context_start, w.context_end,
         string_agg(c.line, chr(10) ORDER BY c.line_no) AS context
  FROM wanted w JOIN code c ON c.file_path = w.file_path AND c.line_no BETWEEN w.context_start AND w.context_end
  GROUP BY ALL)
SELECT file_path, rule_id, line_start, context_start, context_end, context
FROM issues JOIN around USING (file_path, line_start)"""
ORACLE["context_snippet"] = f"{_scan(('JV',))},{_AROUND}"
ORACLE["context_of_blocks"] = f"{_blocks_only()},{_AROUND}"
ORACLE["text_helpers"] = r"""
SELECT doc_id, sha256(text) AS content_hash,
       CAST(len(string_split(text, chr(10))) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS line_count,
       length(text) // 4 AS tokens,
       lang = 'fr' AND strlen(text) < 1024 AS is_binary,
       CASE WHEN size < 1024 THEN printf('%.1f B', size)
            WHEN size < 1048576 THEN printf('%.1f KB', size / 1024)
            WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576)
            ELSE printf('%.1f GB', size / 1073741824) END AS size,
       upper(source[1]) || lower(source[2:] || upper(lang)) AS label,
       upper(source[1]) || source[2:] || upper(lang) AS tail_kept
FROM (SELECT * , CAST(strlen(text) * (doc_id + 1) * 997 AS DOUBLE) AS size FROM documents)"""
ORACLE["decoded_text"] = "SELECT doc_id, text FROM documents"
ORACLE["path_helpers"] = r"""
SELECT page_id, array_to_string(parts[greatest(len(parts) - 2, 1):], '/') AS tail,
       regexp_replace(url, '^https?://[^/]+/', '') AS inside, url AS outside,
       CASE WHEN contains(name, '.') THEN string_split(name, '.')[-1] ELSE '' END AS extension
FROM (SELECT *, regexp_split_to_array(url, '[\\/]') AS parts,
             regexp_extract(url, '^https?://([^/]+)', 1) AS name
      FROM pages)"""
ORACLE["severity_map"] = f"""{_scan()}
SELECT file_path, rule_id,
       CASE WHEN category IN ('security', 'bug') THEN 'error'
            WHEN category IN ('maintainability', 'architecture') THEN 'info' ELSE 'warning' END AS shown,
       greatest(line_start - 1, 0) AS first, greatest(line_end - 1, 0) AS last
FROM issues"""

# --- inventory ------------------------------------------------------------------------

TREE = SCAN_LINES.strip() + ",\n" + FILES.strip() + r""",
tree AS (
  SELECT repo_path, file_no, modified_at,
         repo_path || CASE file_no % 10 WHEN 7 THEN '/node_modules/pkg/' WHEN 8 THEN '/src/dist/'
                                        WHEN 9 THEN '/.git/' ELSE '/src/' END || name AS file_path,
         CAST(strlen(content) * CASE WHEN file_no % 10 = 4 THEN 1000 ELSE 1 END AS BIGINT) AS size_bytes
  FROM (SELECT *, unnest([regexp_extract(file_path, '[^/]+$'), 'note' || file_no || '.TXT',
                          CASE file_no % 10 WHEN 3 THEN 'package.json' WHEN 5 THEN 'pom.xml'
                                            WHEN 6 THEN 'dags/flow.PY' ELSE 'app.py' END]) AS name FROM files)),
ext_tree AS (SELECT *, lower(regexp_extract(file_path, '\.[^./]+$')) AS ext FROM tree)"""
_SUPPORTED = """('.py', '.pyw', '.js', '.jsx', '.ts', '.tsx', '.mjs', '.java', '.go', '.rs', '.sql', '.json')"""

ORACLE["scannable_files"] = f"""WITH {TREE}
SELECT file_path, size_bytes FROM ext_tree
WHERE ext IN {_SUPPORTED} AND size_bytes <= 1048576
  AND NOT regexp_matches(file_path, '/(\\.git|node_modules|__pycache__|venv|dist|build)/')"""
ORACLE["exclude_globs"] = f"""WITH {TREE}
SELECT file_path FROM tree
WHERE NOT (file_path GLOB '*/node_modules/*' OR file_path GLOB '*/dist/*.py' OR file_path GLOB '*.TXT'
           OR regexp_matches(file_path, '^/repo./.*/f[12].\\.js$'))"""
ORACLE["recent_files"] = f"""WITH {SCAN_LINES.strip()}, {FILES.strip()}
SELECT file_path FROM files WHERE modified_at >= TIMESTAMP '1998-01-01' - INTERVAL 365 DAY"""


def _inventory(profile: str) -> str:
    return f"""WITH {TREE},
names(ext, language) AS ({_values(list(LANGUAGE_PROFILES[profile]))}),
counted AS (
  SELECT repo_path, language, count(*) AS files
  FROM ext_tree JOIN names USING (ext)
  WHERE NOT regexp_matches(file_path, '/(\\.git|node_modules|__pycache__|venv)/') GROUP BY ALL)"""


ORACLE["language_inventory"] = f"{_inventory('inventory')} SELECT * FROM counted"
ORACLE["config_languages"] = f"{_inventory('config')} SELECT * FROM counted"
ORACLE["detected_languages"] = f"""{_inventory('inventory')}
SELECT repo_path, string_agg(language, ',' ORDER BY language) AS languages FROM counted GROUP BY ALL"""
ORACLE["supported_extensions"] = f"""WITH {TREE}
SELECT ext, CASE WHEN ext IN ('.py', '.pyw') THEN 'python' WHEN ext = '.java' THEN 'java'
                 WHEN ext = '.go' THEN 'go' WHEN ext = '.rs' THEN 'rust' WHEN ext = '.sql' THEN 'sql'
                 WHEN ext = '.json' THEN 'json' ELSE 'javascript' END AS language, count(*) AS files
FROM ext_tree WHERE ext IN {_SUPPORTED} GROUP BY ALL"""
ORACLE["first_names"] = f"""WITH {TREE}
SELECT file_path FROM (
  SELECT file_path, row_number() OVER (PARTITION BY regexp_extract(file_path, '^(.*)/', 1) ORDER BY file_path) AS n
  FROM tree) WHERE n <= 20"""
ORACLE["repo_size"] = f"""WITH {TREE}
SELECT repo_path, count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM tree
WHERE NOT regexp_matches(file_path, '/(node_modules|dist|build|\\.git|venv|__pycache__|target|bin|obj|\\.vscode|\\.idea)/')
GROUP BY ALL"""
_MARKERS = _values([(m.rstrip("/"), m.endswith("/"), name)
                    for name, group in FRAMEWORK_MARKERS.items() for m in group])
ORACLE["frameworks"] = f"""WITH {TREE}, markers(marker, folder, framework) AS ({_MARKERS})
SELECT DISTINCT repo_path, framework FROM tree JOIN markers
  ON CASE WHEN folder THEN contains(file_path, '/' || marker || '/') ELSE ends_with(file_path, '/' || marker) END"""
ORACLE["repo_totals"] = """
SELECT '/docs/' || source AS repo_path, count(*) AS total_files,
       CAST(sum(strlen(text)) AS BIGINT) AS total_bytes, count(*) > 5000 AS large
FROM documents GROUP BY ALL"""
ORACLE["large_repos"] = """
SELECT '/lines/' || CASE WHEN l_linenumber = 7 THEN 'rare' ELSE 'main' END AS repo_path, count(*) AS total_files,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_bytes, count(*) > 5000 AS large
FROM lineitem GROUP BY ALL"""
ORACLE["file_metrics"] = f"""WITH {SCAN_LINES.strip()}
SELECT file_path, language, count(*) AS line_count, count(*) FILTER (WHERE length(line) > 120) AS long_lines,
       count(*) FILTER (WHERE comment) AS comment_lines, count(*) FILTER (WHERE comment) < count(*) * 0.1 AS few_comments
FROM (SELECT *, CASE language WHEN 'python' THEN regexp_matches(line, '^\\s*#')
                              WHEN 'sql' THEN regexp_matches(line, '^\\s*--')
                              ELSE regexp_matches(line, '^\\s*(//|/\\*|\\*)') END AS comment FROM code)
GROUP BY ALL"""
ORACLE["long_document_lines"] = """
SELECT '/docs/' || source || '/' || doc_id AS file_path, CAST(len(parts) AS BIGINT) AS line_count,
       CAST(len(list_filter(parts, lambda x: length(x) > 120)) AS BIGINT) AS long_lines
FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents)"""

# --- summaries, diff, history -----------------------------------------------------------

ORACLE["issue_summary"] = f"""{_scan(blocks=True)}
SELECT CASE WHEN GROUPING(category) = 0 THEN 'category' WHEN GROUPING(severity) = 0 THEN 'severity'
            ELSE 'total' END AS kind,
       coalesce(category, severity, 'all') AS name, count(*) AS issues
FROM issues GROUP BY GROUPING SETS ((category), (severity), ())"""
ORACLE["issues_by_file"] = f"""{_scan(blocks=True)}
SELECT file_path, count(*) AS issues,
       string_agg(line_start || ':' || rule_id, ' '
                  ORDER BY line_start, line_end, rule_id, category, severity, description) AS found
FROM issues GROUP BY repo_path, file_path"""

_KEYED = f"""keyed AS (
  SELECT *, 'sha256:' || sha256(regexp_replace(coalesce(code_snippet, ''), '^[{SPACE}]+|[{SPACE}]+$', '', 'g')) AS snippet
  FROM issues),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY scan_id, file_path, rule_id, snippet
                               ORDER BY line_start, line_end, description) AS ordinal FROM keyed),
hashed AS (
  SELECT *, sha256(concat_ws(chr(31), rule_id, substr(file_path, length(repo_path) + 2), snippet,
                             CAST(ordinal AS VARCHAR))) AS issue_hash FROM ranked)"""
ORACLE["issue_fingerprints"] = f"""{_scan()}, {_KEYED}
SELECT file_path, rule_id, line_start, issue_hash FROM hashed"""

_COMPARED = f"""{_KEYED},
cur AS (SELECT * FROM hashed WHERE scan_id = 'current'),
prev AS (SELECT * FROM hashed WHERE scan_id = 'previous'),
diff AS (
  SELECT *, CASE WHEN EXISTS (FROM prev p WHERE p.issue_hash = c.issue_hash AND p.repo_path = c.repo_path)
                 THEN 'remaining' ELSE 'new' END AS status FROM cur c
  UNION ALL
  SELECT *, 'fixed' FROM prev p
  WHERE NOT EXISTS (FROM cur c WHERE c.issue_hash = p.issue_hash AND c.repo_path = p.repo_path))"""
_DIFF = f"{_scan(blocks=True, lines=SNAPSHOT_LINES)}, {_COMPARED}"
ORACLE["scan_diff_long_lines"] = f"""{_scan(('GO',), lines=PADDED_LINES)}, {_COMPARED}
SELECT file_path, rule_id, line_start, code_snippet, status, issue_hash FROM diff"""
ORACLE["scan_diff"] = f"""{_DIFF}
SELECT repo_path, file_path, rule_id, category, severity, line_start, line_end, description,
       code_snippet, status, issue_hash FROM diff"""
_TREES = f"""WITH {TREE_LINES.strip()}, {FILES.strip()},
changes AS (
  SELECT repo_path, file_path,
         CASE WHEN p.content IS NULL THEN 'added' WHEN c.content IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM (FROM files WHERE scan_id = 'current') c FULL JOIN (FROM files WHERE scan_id = 'previous') p
       USING (repo_path, file_path)
  WHERE c.content IS DISTINCT FROM p.content)"""
ORACLE["tree_changes"] = f"{_TREES} SELECT repo_path, file_path, change FROM changes"
ORACLE["tree_changed_folders"] = f"""{_TREES},
homes AS (
  SELECT repo_path, file_path, regexp_replace(substr(file_path, length(repo_path) + 2), '/?[^/]*$', '') AS home
  FROM (SELECT DISTINCT repo_path, file_path FROM files)),
above AS (
  SELECT repo_path, file_path, home, array_to_string(string_split(home, '/')[:n], '/') AS folder
  FROM homes, range(0, 4) t(n) WHERE n <= len(string_split(home, '/'))),
counted AS (
  SELECT repo_path, folder, count(*) FILTER (WHERE scan_id = 'current') AS files,
         count(*) FILTER (WHERE scan_id = 'previous') AS previous_files
  FROM above JOIN files USING (repo_path, file_path) GROUP BY ALL)
SELECT repo_path, folder, bool_or(home = folder) AS own_changed, any_value(files) AS files,
       any_value(previous_files) AS previous_files
FROM changes JOIN above USING (repo_path, file_path) JOIN counted USING (repo_path, folder)
GROUP BY repo_path, folder"""
ORACLE["scan_diff_of_trees"] = f"""{_scan(blocks=True, lines=TREE_LINES)}, {_COMPARED}
SELECT repo_path, file_path, rule_id, category, severity, line_start, line_end, description,
       code_snippet, status, issue_hash FROM diff"""
ORACLE["streaming_diff"] = f"""{ORACLE["scan_diff_of_trees"]}
UNION ALL
SELECT repo_path, file_path, rule_id, category, severity, line_start, line_end, description,
       code_snippet, 'new', issue_hash FROM prev"""
ORACLE["scan_diff_first"] = f"{_scan(('GO',))} SELECT file_path, rule_id, line_start, 'new' AS status FROM issues"
ORACLE["scan_diff_overview"] = f"""{_DIFF}
SELECT count(*) FILTER (WHERE status = 'new') AS new_issues, count(*) FILTER (WHERE status = 'fixed') AS fixed_issues,
       count(*) FILTER (WHERE status = 'remaining') AS remaining_issues, (SELECT count(*) FROM cur) AS total_issues FROM diff"""
ORACLE["issue_severity_tabs"] = f"""{_DIFF}
SELECT count(*) FILTER (WHERE lower(severity) = 'error') AS error_issues, count(*) FILTER (WHERE lower(severity) = 'warning') AS warning_issues,
       count(*) FILTER (WHERE lower(severity) = 'info') AS info_issues FROM diff WHERE status <> 'fixed'"""

_SCANS = """WITH scans AS (
  SELECT o_orderkey AS scan_id, '/repo' || (o_custkey % 20) AS repo_path, o_orderdate AS ts,
         o_orderstatus AS status, o_custkey AS total_issues FROM orders)"""
_DATE = "strftime(ts, '%Y-%m-%dT%H:%M:%S') AS scan_date"
ORACLE["scan_history_topk"] = f"""{_SCANS}
SELECT scan_id, repo_path, status, {_DATE}, total_issues FROM scans WHERE repo_path = '/repo7'
ORDER BY ts DESC, scan_id LIMIT 50"""
ORACLE["latest_scan_per_repo"] = f"""{_SCANS}
SELECT scan_id, repo_path, status, {_DATE}, total_issues FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_path ORDER BY ts DESC, scan_id DESC) AS n FROM scans) WHERE n = 1"""
ORACLE["trend"] = f"""{_SCANS}
SELECT scan_id, repo_path, total_issues, lag(total_issues) OVER w AS previous_issues,
       total_issues - lag(total_issues) OVER w AS change
FROM scans WINDOW w AS (PARTITION BY repo_path ORDER BY ts, scan_id)"""

ORACLE["trend_null_keys"] = f"""{_SCANS},
holes AS (SELECT scan_id, CASE WHEN scan_id % 5 <> 0 THEN repo_path END AS repo_path,
                CASE WHEN scan_id % 7 <> 0 THEN ts END AS ts, total_issues FROM scans)
SELECT scan_id, repo_path, total_issues, lag(total_issues) OVER w AS previous_issues,
       total_issues - lag(total_issues) OVER w AS change
FROM holes WINDOW w AS (PARTITION BY repo_path ORDER BY ts NULLS FIRST, scan_id)"""

# --- store --------------------------------------------------------------------------------

_STORED = f"""{_scan(lines=SNAPSHOT_LINES)},
kept AS (
  SELECT scan_id || replace(repo_path, '/', '-') AS scan, * FROM issues
  WHERE scan_id = 'previous' OR severity = 'error')"""


def _counts(column: str, values: tuple[str, ...]) -> str:
    parts = [f"CASE WHEN count(*) FILTER (WHERE {column} = '{v}') > 0 THEN '{v}=' || count(*) FILTER (WHERE {column} = '{v}') END"
             for v in sorted(values)]
    return f"concat_ws(' ', {', '.join(parts)})"


ORACLE["store_scans"] = f"""{_STORED},
per_scan AS (SELECT scan, count(*) AS total_issues, {_counts('category', ('bug', 'security', 'performance', 'maintainability'))} AS by_category,
                    {_counts('severity', ('error', 'warning', 'info'))} AS by_severity FROM kept GROUP BY ALL),
per_files AS (
  SELECT scan_id || replace(repo_path, '/', '-') AS scan, repo_path, count(*) AS total_files,
         string_agg(DISTINCT CASE WHEN language IN ('python', 'javascript', 'sql') THEN language END, ',' ORDER BY
                    CASE WHEN language IN ('python', 'javascript', 'sql') THEN language END) AS languages
  FROM files GROUP BY ALL)
SELECT scan AS scan_id, repo_path, 'completed' AS status, '2024-01-15T12:00:00' AS scan_date, total_files,
       coalesce(languages, 'unknown') AS languages, coalesce(total_issues, 0) AS total_issues,
       coalesce(by_category, '') AS by_category, coalesce(by_severity, '') AS by_severity
FROM per_files LEFT JOIN per_scan USING (scan)"""
ORACLE["store_issues"] = f"""{_STORED}
SELECT scan AS scan_id, repo_path, file_path, rule_id, category, severity, line_start, line_end, description, code_snippet FROM kept"""
ORACLE["store_get_scan"] = f"""{_STORED}
SELECT scan AS scan_id, 'completed' AS status, '2024-01-15T12:00:00' AS scan_date, file_path, rule_id,
       severity, line_start FROM kept WHERE scan = 'current-repo2'"""
ORACLE["knowledge_entries"] = f"""{_scan(('SQ', 'GO'))},
hashes AS (SELECT sha256(content) AS file_hash, min(file_path) AS file_path FROM files GROUP BY 1),
found AS (SELECT file_path, count(*) AS n FROM issues GROUP BY ALL)
SELECT file_hash, coalesce(n, 0) AS issues, 'rules' AS source FROM hashes LEFT JOIN found USING (file_path)"""

# --- reuse ----------------------------------------------------------------------------------

_KNOWN = """WITH docs AS (
  SELECT doc_id, '/docs/' || source || '/' || doc_id AS file_path, text, sha256(text) AS content_hash FROM documents),
saved AS (SELECT content_hash, max_by(doc_id, doc_id) AS last_id FROM docs JOIN labels USING (doc_id) GROUP BY ALL),
known AS (
  SELECT s.content_hash, l.quality, l.toxic, CAST(len(string_split(d.text, chr(10))) AS INTEGER) AS n
  FROM saved s JOIN labels l ON l.doc_id = s.last_id JOIN docs d ON d.doc_id = s.last_id)"""
ORACLE["knowledge_hits"] = f"""{_KNOWN}
SELECT file_path, content_hash, 'maintainability' AS category, 'info' AS severity, 1 AS line_start, n AS line_end,
       'Low quality' AS description, 'Review the text' AS recommendation
FROM docs JOIN known USING (content_hash) WHERE quality = 0
UNION ALL
SELECT file_path, content_hash, 'security', 'error', 1, n, 'Toxic', 'Review the text'
FROM docs JOIN known USING (content_hash) WHERE toxic = 1"""
ORACLE["knowledge_misses"] = f"""{_KNOWN}
SELECT file_path, content_hash FROM docs WHERE content_hash NOT IN (SELECT content_hash FROM known)"""
ORACLE["distinct_contents"] = f"""{_KNOWN}
SELECT min_by(file_path, rank) AS file_path, content_hash
FROM (SELECT *, row_number() OVER (ORDER BY regexp_extract(file_path, '^(.*)/', 1), file_path) AS rank FROM docs)
GROUP BY content_hash"""
_REQUESTS = """WITH requests AS (
  SELECT event_id AS entry_id, event_type AS provider, user_id || ':' || event_type AS cache_key, ts FROM events)"""
_DENSE = """WITH requests AS (
  SELECT event_id AS entry_id, event_type AS provider,
         make_timestamp(epoch_us(ts) // CASE WHEN event_type = 'click' THEN 400 ELSE 20 END) AS ts FROM events)"""
_NOW = "TIMESTAMP '2024-01-15 12:00:00'"
ORACLE["cache_ttl_lookup"] = f"""{_REQUESTS},
last AS (SELECT cache_key, max_by(entry_id, ts) AS entry_id, max(ts) AS ts FROM requests GROUP BY ALL)
SELECT r.entry_id AS request_id, cache_key, last.entry_id AS entry_id,
       {_NOW} - last.ts < INTERVAL 20 DAY AS hit
FROM requests r JOIN last USING (cache_key)"""
ORACLE["cache_stats"] = f"""{_REQUESTS}
SELECT count(*) AS total_entries, count(*) FILTER (WHERE {_NOW} - ts >= INTERVAL 1 HOUR) AS expired_entries,
       CAST(3600 AS BIGINT) AS ttl_seconds FROM requests"""
ORACLE["cache_cleanup"] = f"""{_REQUESTS}
SELECT entry_id, cache_key FROM requests WHERE {_NOW} - ts < INTERVAL 1 HOUR"""
ORACLE["rate_audit"] = f"""{_DENSE},
counted AS (
  SELECT entry_id, provider,
    count(*) OVER (PARTITION BY provider ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) - 1 AS last_minute,
    count(*) OVER (PARTITION BY provider ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) - 1 AS last_hour
  FROM requests)
SELECT *, last_hour < 100 AND last_minute < 10 AS allowed FROM counted"""

# A plain walk over the requests of all providers at once: the times let through are a list.
ORACLE["rate_admission"] = f"""{_DENSE.replace("WITH ", "WITH RECURSIVE ", 1)},
late AS (
  SELECT entry_id, provider, epoch_us(ts) + 7200000000 * (entry_id // 700) AS micros FROM requests),
turns AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY micros, entry_id) AS turn FROM late),
walk AS (
  SELECT provider, 0::BIGINT AS turn, 0::BIGINT AS entry_id, false AS admitted, []::BIGINT[] AS times
  FROM (SELECT DISTINCT provider FROM turns)
  UNION ALL
  SELECT provider, turn, entry_id, lets, CASE WHEN lets THEN list_append(recent, micros) ELSE recent END
  FROM (SELECT *, len(recent) < 100 AND len([x for x in recent if micros - x < 60000000]) < 10 AS lets
        FROM (SELECT t.provider, t.turn, t.entry_id, t.micros, [x for x in w.times if t.micros - x <= 3600000000] AS recent
              FROM walk w JOIN turns t ON t.provider = w.provider AND t.turn = w.turn + 1)))
SELECT entry_id, provider, admitted FROM walk WHERE turn > 0"""

# --- reviews ----------------------------------------------------------------------------------

_ANSWERS = r"""parts AS (
  SELECT o_orderkey AS key, '/repo/f' || o_orderkey AS file_path,
    '{"category": "Security", "severity": "' || CASE o_orderstatus WHEN 'F' THEN 'Error' WHEN 'O' THEN 'WARNING' ELSE 'fatal' END
      || '", "line_start": ' || (o_orderkey % 40) || ', "line_end": ' || (o_orderkey % 40)
      || ', "description": "Found by ' || o_orderstatus || '", "recommendation": "Fix ' || (o_orderkey % 40) || '"}' AS item
  FROM orders),
answers AS (
  SELECT key, file_path, CASE key % 14
    WHEN 0 THEN 'Here are the issues:' || chr(10) || '[' || item || ', {"category": "bug", "severity": "ERROR", "description": "Plain"}]' || chr(10) || 'Regards'
    WHEN 1 THEN '{"issues": [' || item || ']}'
    WHEN 2 THEN '[]' WHEN 3 THEN '[' || item WHEN 4 THEN '' WHEN 5 THEN 'No issues found.'
    WHEN 6 THEN '[{"category": "style", "severity": "fatal"}]'
    WHEN 7 THEN '[1, ' || item || ']'
    WHEN 8 THEN '[{''category'': ''bug'', ''description'': ''single quotes''}]'
    WHEN 9 THEN '[{"category": "bug", "line_start": "10", "line_end": "12"}]'
    WHEN 10 THEN '[{"category": "security", "line_start": 10.0, "line_end": 11.0}]'
    WHEN 11 THEN '[{"severity": "error", "line_start": "x", "line_end": null}]'
    WHEN 12 THEN '[{"line_start": 3, "extra": {"a": [1]}, "description": "a \"b\" ''c''"}]' ELSE item END AS response
  FROM parts),
lists AS (
  SELECT key, file_path, regexp_extract(response, '(?s)\[.*\]') AS list FROM answers),
objects AS (
  SELECT key, file_path, unnest(from_json(list, '["JSON"]')) AS o FROM lists WHERE list <> '' AND json_valid(list)),
parsed AS (
  SELECT key, file_path, o ->> '$.category' AS category, o ->> '$.severity' AS severity,
         CAST(TRY_CAST(o ->> '$.line_start' AS DOUBLE) AS INTEGER) AS line_start,
         CAST(TRY_CAST(o ->> '$.line_end' AS DOUBLE) AS INTEGER) AS line_end, o ->> '$.description' AS description, o ->> '$.recommendation' AS recommendation
  FROM objects WHERE json_type(o) = 'OBJECT')"""
_NORMAL = """normal AS (
  SELECT key, file_path,
         CASE WHEN lower(category) IN ('bug', 'security', 'performance', 'maintainability', 'architecture')
              THEN lower(category) ELSE 'maintainability' END AS category,
         CASE WHEN lower(severity) IN ('error', 'warning', 'info') THEN lower(severity) ELSE 'info' END AS severity,
         coalesce(line_start, 1) AS line_start, coalesce(line_end, 1) AS line_end,
         coalesce(description, 'Issue detected by LLM') AS description,
         coalesce(recommendation, '') AS recommendation
  FROM parsed)"""
ORACLE["answers_parsed"] = f"WITH {_ANSWERS} SELECT * EXCLUDE (key) FROM parsed"
ORACLE["answers_normalised"] = f"WITH {_ANSWERS}, {_NORMAL} SELECT * EXCLUDE (key) FROM normal"
ORACLE["review_overlay"] = f"""{_scan(('GO', 'RS', 'JS-01'))}, {_ANSWERS}, {_NORMAL},
reviewed AS (
  SELECT f.file_path, n.category, n.severity, n.line_start, n.description
  FROM files f JOIN normal n ON n.key // 150 * 3 = f.file_no)
SELECT file_path, CAST(NULL AS VARCHAR) AS rule_id, category, severity, line_start, description FROM reviewed
UNION ALL
SELECT file_path, rule_id, category, severity, line_start, description FROM issues
WHERE file_path NOT IN (SELECT file_path FROM reviewed)"""
ORACLE["scan_with_reuse"] = f"""{_scan(blocks=True)}, {_ANSWERS}, {_NORMAL},
reviewed AS (
  SELECT f.file_path, n.category, n.severity, n.line_start, n.description
  FROM files f JOIN normal n ON n.key // 150 * 3 = f.file_no WHERE f.repo_path <> '/repo0')
SELECT file_path, CAST(NULL AS VARCHAR) AS rule_id, category, severity, line_start, description FROM reviewed
UNION ALL
SELECT file_path, NULL, category, severity, line_start, description FROM issues
WHERE repo_path = '/repo0' AND (rule_id LIKE 'GO-%' OR rule_id LIKE 'SQ-%')
UNION ALL
SELECT file_path, rule_id, category, severity, line_start, description FROM issues
WHERE repo_path <> '/repo0' AND file_path NOT IN (SELECT file_path FROM reviewed)"""
ORACLE["files_without_review"] = f"""WITH {SCAN_LINES.strip()}, {FILES.strip()}, {_ANSWERS}
SELECT file_path FROM files WHERE file_no NOT IN (SELECT key // 150 * 3 FROM parsed)"""


def _greedy(source: str, group: str, order: str) -> str:
    """Recursive CTE ``walk``: the greedy walk, one file at a time."""
    return f"""sized AS ({source}),
ordered AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS n FROM sized),
walk AS (
  SELECT {group}, {order}, tokens, n, CAST(1 AS BIGINT) AS batch, 1 AS files, tokens AS used FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.{group}, o.{order}, o.tokens, o.n,
         CASE WHEN w.files >= 5 OR w.used + o.tokens > 6000 THEN w.batch + 1 ELSE w.batch END,
         CASE WHEN w.files >= 5 OR w.used + o.tokens > 6000 THEN 1 ELSE w.files + 1 END,
         CASE WHEN w.files >= 5 OR w.used + o.tokens > 6000 THEN o.tokens ELSE w.used + o.tokens END
  FROM walk w JOIN ordered o ON o.{group} = w.{group} AND o.n = w.n + 1)"""


ORACLE["review_batches"] = f"""WITH RECURSIVE
{_greedy("SELECT source, doc_id, length(text) // 4 AS tokens FROM documents", "source", "doc_id")}
SELECT source, doc_id, tokens, batch FROM walk"""

_BATCHED = f"""WITH RECURSIVE {SCAN_LINES.strip()}, {FILES.strip()},
{_greedy("SELECT repo_path, file_no, length(content) // 4 AS tokens FROM files", "repo_path", "file_no")},
batched AS (
  SELECT w.repo_path, w.batch, f.file_no, f.file_path, f.content,
         CASE WHEN language IN ('python', 'javascript', 'sql') THEN language ELSE 'unknown' END AS language
  FROM walk w JOIN files f USING (repo_path, file_no))"""
ORACLE["batch_prompts"] = f"""{_BATCHED},
numbered_files AS (SELECT *, row_number() OVER (PARTITION BY repo_path, batch ORDER BY file_no) AS i FROM batched)
SELECT repo_path, batch, count(*) AS files, sha256({_q(BATCH_HEAD)} || string_agg(
    chr(10) || '--- File ' || i || ': ' || file_path || ' (' || language || ') ---' || chr(10)
    || '```' || language || chr(10) || content || chr(10) || '```' || chr(10), '' ORDER BY i) || {_q(BATCH_TAIL)}) AS prompt_hash
FROM numbered_files GROUP BY ALL"""
_SINGLE = _q(SINGLE_PROMPT.replace("{{", "{").replace("}}", "}"))
ORACLE["single_prompts"] = f"""
SELECT doc_id, sha256(replace(replace(replace({_SINGLE}, '{{language}}', lang),
                              '{{file_path}}', CAST(doc_id AS VARCHAR)), '{{content}}', text)) AS prompt_hash
FROM documents"""
ORACLE["batch_answers"] = f"""{_BATCHED}
SELECT file_path, batch,
       CASE WHEN language = 'sql' OR repo_path = '/repo1' THEN CAST(0 AS BIGINT) ELSE 1 END AS issues,
       CASE WHEN language = 'sql' OR repo_path = '/repo1' THEN NULL ELSE CAST(file_no % 50 AS INTEGER) END AS line_start
FROM batched"""

# --- exports ----------------------------------------------------------------------------------

_EXPORT = """SELECT category, severity, file_path AS file, CAST(line_start AS VARCHAR) AS line_start,
       CAST(line_end AS VARCHAR) AS line_end, description, recommendation FROM issues"""
ORACLE["export_table"] = f"{_scan()} {_EXPORT}"
ORACLE["export_csv"] = f"{_scan(('JV', 'PY'))} {_EXPORT}"
_REPORT = """
firsts AS (
  SELECT category, count(*) AS n, min(file_path || chr(31) || printf('%010d', line_start) || chr(31) || rule_id)
         || chr(31) || category AS section
  FROM issues GROUP BY category),
report(section, slot, file_path, line_start, rule_id, text, rest, body) AS (
  SELECT '', 0, '', 0, '', '', '', ['Code Scan Report', '================', 'Total Issues: ' || count(*),
                                'Scan Date: 2024-01-15T12:00:00', ''] FROM issues
  UNION ALL
  SELECT section, 1, '', 0, '', '', '', ['Category: ' || upper(category), repeat('-', length(category) + 10)] FROM firsts
  UNION ALL
  SELECT section, 2, file_path, line_start, rule_id, description,
         severity || chr(31) || recommendation,
         ['[' || upper(severity) || '] ' || file_path || ':' || line_start, 'Description: ' || description,
          'Recommendation: ' || recommendation, ''] FROM issues JOIN firsts USING (category)
  UNION ALL
  SELECT section, 3, '', 0, '', '', '', [''] FROM firsts)
"""
_REPORT_LINES = """SELECT section, slot, file_path, line_start, rule_id, text, rest,
       unnest(range(len(body))) AS line_no, unnest(body) AS line FROM report"""
ORACLE["text_report"] = f"{_scan()},{_REPORT}{_REPORT_LINES}"
ORACLE["report_in_order"] = f"""{_scan(('SQ',), blocks=True)},
chosen AS (SELECT * FROM issues WHERE rule_id LIKE 'SQ%' OR rule_id = 'PY-08'),{
    _REPORT.replace("FROM issues", "FROM chosen").replace("2024-01-15T12:00:00", "Unknown")}, placed AS (SELECT *, row_number() OVER (ORDER BY section, slot, file_path, line_start, rule_id, text, rest) AS block FROM report),
printed AS (SELECT block, unnest(range(len(body))) AS line_no, unnest(body) AS line FROM placed)
SELECT row_number() OVER (ORDER BY block, line_no) AS number, line FROM printed"""
ORACLE["text_report_reviews"] = f"""{_scan(('GO', 'RS', 'JS-01'))}, {_ANSWERS}, {_NORMAL},
reviewed AS (
  SELECT f.file_path, '' AS rule_id, CASE WHEN n.severity <> 'error' THEN n.category END AS category, n.severity,
         n.line_start, n.description, n.recommendation
  FROM files f JOIN normal n ON n.key // 150 * 3 = f.file_no),
every AS (
  SELECT * REPLACE (coalesce(category, 'Other') AS category) FROM reviewed
  UNION ALL
  SELECT file_path, rule_id, CASE WHEN severity <> 'error' THEN category ELSE 'Other' END, severity, line_start,
         description, recommendation
  FROM issues WHERE file_path NOT IN (SELECT file_path FROM reviewed)),
firsts AS (
  SELECT category, count(*) AS n, min(file_path || chr(31) || printf('%010d', line_start) || chr(31) || rule_id)
         || chr(31) || category AS section
  FROM every GROUP BY category),
report(section, slot, file_path, line_start, rule_id, text, rest, body) AS (
  SELECT '', 0, '', 0, '', '', '', ['Code Scan Report', '================', 'Total Issues: ' || count(*),
                                'Scan Date: Unknown', ''] FROM every
  UNION ALL
  SELECT section, 1, '', 0, '', '', '', ['Category: ' || upper(category), repeat('-', length(category) + 10)] FROM firsts
  UNION ALL
  SELECT section, 2, file_path, line_start, rule_id, description,
         severity || chr(31) || recommendation,
         list_filter(['[' || upper(severity) || '] ' || file_path || ':' || line_start, 'Description: ' || description,
          CASE WHEN recommendation <> '' THEN 'Recommendation: ' || recommendation END, ''], lambda x: x IS NOT NULL)
  FROM every JOIN firsts USING (category)
  UNION ALL
  SELECT section, 3, '', 0, '', '', '', [''] FROM firsts)
SELECT section, slot, file_path, line_start, rule_id, text, rest,
       unnest(range(len(body))) AS line_no, unnest(body) AS line FROM report"""
