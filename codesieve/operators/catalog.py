"""The rule catalog: texts, patterns and predicates.

A rule is a row (id, language, category, severity, description, recommendation) and a
predicate over one *unit* of a file. Units come from ``file_units``:

* ``line``       one physical line; ``prev_line`` and the ``ahead_*`` flags describe its neighbours
* ``statement``  one SQL statement
* ``key``        one repeated JSON key
* ``file``       the whole file

``{}`` in a description is replaced by the rule's ``detail``. Predicates and details are SQL
expressions, so the whole catalog reaches Spark as one expression and a rule can come from a
table as well as from code.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions.regex import SPACE, portable, sql_text
from codesieve.settings import (
    CATEGORIES,
    MAX_JSON_CHARS,
    MAX_JSON_DEPTH,
    SECRET_LINE_LIMIT,
    SEVERITIES,
)

# Patterns, in plain form. ``portable`` spells them for the engine.
PY_PASSWORD = r"""password\s*=\s*["']([^"']{8,})["']"""
PY_API_KEY = r"""api[_-]?key\s*=\s*["']([^"']{20,})["']"""
JS_API_KEY = r"""(api[_-]?key|apikey)\s*[:=]\s*["']([^"']{20,})["']"""
JS_SECRET = r"""(secret|password|token)\s*[:=]\s*["']([^"']{8,})["']"""
JS_EVAL = r"eval\s*\("
JS_INNER_HTML = r"innerHTML\s*="
JS_LOOSE_EQUAL = r"[^=!<>]==[^=]"
JS_CONSOLE = r"console\.(log|debug|info)"
JS_ARRAY_CALL = r"\.(map|filter|forEach)\("
JS_INLINE_HANDLER = r"(onClick|onPress|onChange|onSubmit)\s*=\s*\{.*=>"
JS_STATE_OBJECT = r"useState\s*\(\s*\{"
RN_TOUCHABLE = r"<(TouchableOpacity|Button|Pressable)"
CREDENTIAL_EQUALS = r"""(password|secret|token|api[_-]?key)\s*=\s*["'][\w\-]{8,}["']"""
CREDENTIAL = r"""(password|secret|token|api[_-]?key)\s*[:=]\s*["'][\w\-]{8,}["']"""
JAVA_EMPTY_CATCH = r"catch\s*\([^)]+\)\s*{\s*}"
JAVA_CATCH_ALL = r"catch\s*\(\s*Exception\s+\w+\s*\)"
JAVA_STRING_EQUAL = r"(String|str)\s+\w+\s*=="
JAVA_LITERAL_EQUAL = r"""==\s*["']"""
JAVA_PUBLIC_METHOD = r"^\s*public\s+\w+\s+\w+\s*\("
JAVA_BARE_CALL = r"\.\w+\(\)"
TODO_COMMENT = r"//\s*(TODO|FIXME|HACK|XXX)"
TODO_MARKER = r"(TODO|FIXME|HACK|XXX)"
GO_IGNORED_ERROR = r"^\s*[a-zA-Z_]\w*\s*,\s*_\s*:?="
GO_EMPTY_CHECK = r"if\s+err\s*!=\s*nil\s*{\s*}"
GO_EXPORTED = r"^func\s+[A-Z]\w+"
RUST_UNSAFE = r"^\s*unsafe\s*{"
RUST_EMPTY_EXPECT = r"""\.expect\(["']["']"""
RUST_STRING_PLUS = r"\+\s*&"
RUST_PUBLIC_FN = r"^\s*pub\s+fn\s+\w+"
RUST_INDEX = r"\[\d+\]"
SQL_WHERE_OR = r"WHERE.*[^\w]OR([^\w]|$)"


# A word each credential pattern needs, and letters outside ASCII that are equal
# to an ASCII letter when case is ignored and do not lower-case to it.
CREDENTIAL_WORDS = ("password", "secret", "token", "api")
FOLDED_LETTERS = ("ſ", "ı", "İ")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    language: str
    category: str
    severity: str
    description: str
    recommendation: str
    predicate: str | Callable[[], Column]
    scope: str = "line"
    detail: str | None = None
    #: Lines that follow a line and its predicate may read as ``ahead``.
    ahead: int = 0
    #: The predicate of a JSON rule fails for files of no more characters. Where that goes for all JSON rules of a scan,
    #: such files are not parsed and their ``json_valid`` is null.
    more_chars_than: int = 0

    def __post_init__(self) -> None:
        if self.category not in CATEGORIES or self.severity not in SEVERITIES:
            raise ValueError(f"unknown category or severity in rule {self.rule_id}")

    def described(self) -> str:
        """SQL expression of the description."""
        if self.detail is None:
            return sql_text(self.description)
        before, after = self.description.split("{}")
        return f"concat({sql_text(before)}, {self.detail}, {sql_text(after)})"

    def finding(self) -> str:
        """SQL expression of what an issue of this rule says."""
        texts = {"rule_id": self.rule_id, "category": self.category, "severity": self.severity}
        fields = [f"{sql_text(v)} AS {k}" for k, v in texts.items()]
        fields += [f"{self.described()} AS description",
                   f"{sql_text(self.recommendation)} AS recommendation"]
        return f"struct({', '.join(fields)})"

    def hit(self) -> Column:
        """The finding where the predicate holds, else null."""
        if callable(self.predicate):
            return F.when(self.predicate(), F.expr(self.finding()))
        return F.expr(f"CASE WHEN {self.predicate} THEN {self.finding()} END")


# --- conditions ---------------------------------------------------------------------
# A literal test before a regular expression is implied by it; it is there because a
# byte search is far cheaper than the regular expression and most lines fail it.

def all_of(*conditions: str) -> str:
    return "(" + " AND ".join(conditions) + ")"


def one_of(*conditions: str) -> str:
    return "(" + " OR ".join(conditions) + ")"


def has(*texts: str, of: str = "text") -> str:
    """True if any of the texts occurs."""
    return one_of(*[f"contains({of}, {sql_text(t)})" for t in texts])


def found(pattern: str, ignore_case: bool = False, of: str = "text") -> str:
    return f"({of} RLIKE {sql_text(portable(pattern, ignore_case))})"


def quoted(pattern: str, *words: str, of: str = "text") -> str:
    """A quoted value after one of the words, in any case. The word test is a byte search over
    the lower-cased text; letters that only case folding makes equal to one of ours go on to
    the regular expression."""
    words_there = one_of(has(*words, of=f"lower({of})"), has(*FOLDED_LETTERS, of=of))
    return all_of(has('"', "'", of=of), words_there, found(pattern, ignore_case=True, of=of))


def credential(of: str = "text") -> str:
    return quoted(CREDENTIAL, *CREDENTIAL_WORDS, of=of)


def starts(of: str, *texts: str) -> str:
    return one_of(*[f"startswith({of}, {sql_text(t)})" for t in texts])


def undocumented(pattern: str, literal: str, doc_start: str) -> str:
    stripped = f"regexp_replace(prev_line, {sql_text(f'^[{SPACE}]+')}, '')"
    return all_of(has(literal), found(pattern), "prev_line IS NOT NULL",
                  "NOT " + starts(stripped, doc_start))


LOWER, UPPER = "lower(text)", "upper(text)"
TODO = all_of(has("//"), found(TODO_COMMENT, ignore_case=True))
FIRST_TODO = f"regexp_extract(text, {sql_text(portable(TODO_MARKER, ignore_case=True))}, 1)"
FIRST_WORD = f"regexp_extract({UPPER}, {sql_text(f'[^{SPACE}]+')}, 0)"
CONSOLE_CALL = all_of(has("console."), found(JS_CONSOLE), "NOT " + found(r"^\s*//"))
LOOSE_EQUAL = all_of(has("=="), found(JS_LOOSE_EQUAL),
                     "NOT " + has("//", of="substring_index(text, '==', 1)"))
REPEATED_ITERATION = all_of(has(".map(", ".filter(", ".forEach("),
                            f"regexp_count(text, {sql_text(JS_ARRAY_CALL)}) > 1")


# --- built-in rules -----------------------------------------------------------------

def _todo_rule(rule_id: str, language: str) -> Rule:
    return Rule(rule_id, language, "maintainability", "info", "Found {} comment",
                "Address or document these items for better code maintainability.",
                TODO, detail=FIRST_TODO)


def _credential_rule(rule_id: str, language: str, pattern: str) -> Rule:
    return Rule(rule_id, language, "security", "error", "Potential hardcoded credential detected",
                "Use environment variables or secure configuration management for credentials.",
                quoted(pattern, *CREDENTIAL_WORDS))


def _dangerous_rule(rule_id: str, description: str, predicate: str) -> Rule:
    return Rule(rule_id, "javascript", "security", "warning", description,
                "Use safer alternatives or sanitize input", predicate)


# Rule texts, next to the predicate that raises them.
RULES: tuple[Rule, ...] = (
    Rule("PY-01", "python", "security", "error", "Hardcoded password detected in source code",
         "Move sensitive credentials to environment variables.",
         quoted(PY_PASSWORD, "password")),
    Rule("PY-02", "python", "security", "error", "Hardcoded API key detected in source code",
         "Move sensitive credentials to environment variables.",
         all_of(quoted(PY_API_KEY, "api"), "NOT " + quoted(PY_PASSWORD, "password"))),

    Rule("JS-01", "javascript", "security", "error", "Hardcoded API key detected",
         "Move secrets to environment variables (.env file)",
         quoted(JS_API_KEY, "api")),
    Rule("JS-02", "javascript", "security", "error", "Hardcoded secret detected",
         "Move secrets to environment variables (.env file)",
         all_of(quoted(JS_SECRET, "secret", "password", "token"), "NOT " + quoted(JS_API_KEY, "api"))),
    _dangerous_rule("JS-03", "Use of eval() is dangerous", all_of(has("eval"), found(JS_EVAL))),
    _dangerous_rule("JS-04", "Use of dangerouslySetInnerHTML can lead to XSS",
                    has("dangerouslySetInnerHTML")),
    _dangerous_rule("JS-05", "Direct innerHTML assignment can lead to XSS",
                    all_of(has("innerHTML"), found(JS_INNER_HTML))),
    Rule("JS-06", "javascript", "bug", "warning", "Use === instead of == for comparison",
         "Use strict equality (===) to avoid type coercion bugs", LOOSE_EQUAL),
    Rule("JS-07", "javascript", "maintainability", "info", "Console statement found",
         "Remove console statements before production deployment", CONSOLE_CALL),
    Rule("JS-08", "javascript", "performance", "info", "Multiple array iterations on same line",
         "Consider combining operations or using a single loop", REPEATED_ITERATION),
    Rule("JS-10", "javascript", "bug", "warning", "Missing 'key' prop in list rendering",
         "Add a unique 'key' prop to elements in a list",
         all_of("react", has(".map("), has("return"), "NOT " + has("key="), "NOT ahead_key")),
    Rule("JS-11", "javascript", "performance", "info", "Inline function in JSX prop",
         "Define function outside render or use useCallback to avoid re-renders",
         all_of("react", has("=>"), found(JS_INLINE_HANDLER))),
    Rule("JS-13", "javascript", "maintainability", "info", "useState with object",
         "Consider splitting into multiple useState calls for better performance",
         all_of("react", has("useState"), found(JS_STATE_OBJECT))),
    Rule("RN-01", "javascript", "maintainability", "info", "Missing accessibility props",
         "Add accessibilityLabel and accessibilityRole for better accessibility",
         all_of("react_native", has("<"), found(RN_TOUCHABLE), "NOT ahead_accessible")),
    Rule("RN-02", "javascript", "performance", "warning", "FlatList without keyExtractor",
         "Add keyExtractor prop for better performance",
         all_of("react_native", has("<FlatList"), "NOT ahead_extractor")),

    _credential_rule("JV-01", "java", CREDENTIAL_EQUALS),
    Rule("JV-02", "java", "security", "error", "Potential SQL injection vulnerability",
         "Use PreparedStatement with parameterized queries instead of string concatenation.",
         all_of(has("executeQuery(", "executeUpdate("), has("+", "String.format"))),
    Rule("JV-03", "java", "security", "warning", "Unsafe deserialization detected",
         "Validate and sanitize deserialized objects to prevent remote code execution.",
         all_of(has("ObjectInputStream"), has("readObject"))),
    Rule("JV-04", "java", "bug", "warning", "Empty catch block",
         "Handle exceptions appropriately or at least log them.",
         all_of(has("catch"), found(JAVA_EMPTY_CATCH))),
    Rule("JV-05", "java", "bug", "info", "Catching generic Exception",
         "Catch specific exception types instead of generic Exception.",
         all_of(has("catch"), found(JAVA_CATCH_ALL))),
    Rule("JV-06", "java", "bug", "warning", "String comparison using == instead of .equals()",
         "Use .equals() method for string comparison instead of == operator.",
         all_of(has("=="), one_of(found(JAVA_STRING_EQUAL), found(JAVA_LITERAL_EQUAL)))),
    Rule("JV-07", "java", "performance", "warning", "String concatenation in loop",
         "Use StringBuilder for efficient string concatenation in loops.",
         all_of(has("for(", "for (", "while(", "while ("), has("+="), has('"'))),
    Rule("JV-08", "java", "performance", "info", "Use of legacy Vector class",
         "Use ArrayList instead of Vector for better performance in non-threaded contexts.",
         has("new Vector")),
    _todo_rule("JV-09", "java"),
    Rule("JV-10", "java", "maintainability", "info", "Public method without Javadoc comment",
         "Add Javadoc comments for public methods to improve code documentation.",
         undocumented(JAVA_PUBLIC_METHOD, "public", "/**")),
    Rule("JV-11", "java", "bug", "info", "Potential NullPointerException",
         "Add null checks before method calls or use Optional.",
         all_of(has("()"), has("null", of=LOWER), found(JAVA_BARE_CALL))),
    Rule("JV-12", "java", "security", "warning", "Use of Random for security-sensitive operations",
         "Use SecureRandom instead of Random for cryptographic operations.",
         all_of(has("new Random()"), "sensitive")),

    _credential_rule("GO-01", "go", CREDENTIAL),
    Rule("GO-02", "go", "security", "error", "Potential SQL injection vulnerability",
         "Use parameterized queries instead of string concatenation.",
         all_of(has("Exec(", "Query("), has("+", "fmt.Sprintf"))),
    Rule("GO-03", "go", "bug", "warning", "Error value ignored",
         "Always check error return values in Go.",
         all_of(has("_"), found(GO_IGNORED_ERROR))),
    Rule("GO-04", "go", "bug", "error", "Empty error check block",
         "Handle errors appropriately instead of ignoring them.",
         all_of(has("err"), found(GO_EMPTY_CHECK))),
    Rule("GO-05", "go", "performance", "warning", "String concatenation in loop",
         "Use strings.Builder for efficient string concatenation in loops.",
         all_of(has("for "), has("+=", "= "), has('"'))),
    _todo_rule("GO-06", "go"),
    Rule("GO-07", "go", "maintainability", "info", "Exported function without documentation comment",
         "Add a comment describing what this exported function does.",
         undocumented(GO_EXPORTED, "func", "//")),
    Rule("GO-08", "go", "security", "warning", "Use of unsafe package",
         "Avoid using the unsafe package unless absolutely necessary.",
         has('import "unsafe"', "import unsafe")),

    _credential_rule("RS-01", "rust", CREDENTIAL),
    Rule("RS-02", "rust", "security", "warning", "Use of unsafe block",
         "Ensure unsafe code is necessary and well-documented. Consider safe alternatives.",
         all_of(has("unsafe"), found(RUST_UNSAFE))),
    Rule("RS-03", "rust", "bug", "warning", "Use of unwrap() can cause panic",
         "Use pattern matching, if let, or expect() with a descriptive message instead.",
         has(".unwrap()")),
    Rule("RS-04", "rust", "bug", "info", "expect() called with empty message",
         "Provide a meaningful error message to expect().",
         all_of(has(".expect("), found(RUST_EMPTY_EXPECT))),
    Rule("RS-05", "rust", "performance", "warning", "Cloning in loop may impact performance",
         "Consider using references or restructuring to avoid unnecessary clones.",
         all_of(has("for "), has(".clone()"))),
    Rule("RS-06", "rust", "performance", "info", "String concatenation with + operator",
         "Use format!() macro or String::push_str() for better performance.",
         all_of(has("String"), has("+"), found(RUST_STRING_PLUS))),
    _todo_rule("RS-07", "rust"),
    Rule("RS-08", "rust", "maintainability", "info", "Public function without documentation comment",
         "Add /// documentation comments for public APIs.",
         undocumented(RUST_PUBLIC_FN, "pub", "///")),
    Rule("RS-09", "rust", "bug", "info", "Direct indexing can panic if out of bounds",
         "Consider using .get() method which returns Option instead.",
         all_of(has("["), found(RUST_INDEX), "NOT " + has("vec!", of=LOWER))),
    Rule("RS-10", "rust", "security", "info", "Printing user input directly",
         "Ensure user input is sanitized before printing to prevent injection attacks.",
         all_of(has("println!"), has("input", "user", of=LOWER))),

    Rule("SQ-01", "sql", "performance", "warning", "SELECT * is inefficient and can cause issues",
         "Explicitly list the columns you need instead of using SELECT *.",
         has("SELECT *", "SELECT*", of=UPPER), scope="statement"),
    Rule("SQ-02", "sql", "bug", "error", "{} statement without WHERE clause",
         "Add a WHERE clause to avoid affecting all rows unintentionally.",
         all_of(starts(UPPER, "DELETE", "UPDATE"), "NOT " + has("WHERE", of=UPPER)),
         scope="statement", detail=FIRST_WORD),
    Rule("SQ-03", "sql", "performance", "warning",
         "CROSS JOIN without LIMIT can produce huge result sets",
         "Add a LIMIT clause or reconsider if CROSS JOIN is necessary.",
         all_of(has("CROSS JOIN", of=UPPER), "NOT limited")),
    Rule("SQ-04", "sql", "performance", "info", "OR in WHERE clause may prevent index usage",
         "Consider using UNION or restructuring the query for better performance.",
         all_of(has("WHERE", of=UPPER), found(SQL_WHERE_OR, of=UPPER))),

    Rule("JN-01", "json", "bug", "error", "Invalid JSON", "Fix the JSON syntax error.",
         "NOT json_valid", scope="file"),
    Rule("JN-02", "json", "bug", "warning", "Duplicate key '{}' found in JSON",
         "Remove duplicate keys. The last occurrence will override previous ones.",
         "json_valid", scope="key", detail="text"),
    Rule("JN-03", "json", "performance", "warning", "Large JSON file ({}KB)",
         "Consider splitting into smaller files or using a more efficient format.",
         f"json_valid AND json_chars > {MAX_JSON_CHARS}",
         scope="file", detail="CAST(json_chars div 1024 AS STRING)", more_chars_than=MAX_JSON_CHARS),
    Rule("JN-04", "json", "maintainability", "info", "Deeply nested JSON structure (depth: {})",
         "Consider flattening the structure for better readability and performance.",
         f"json_valid AND json_depth > {MAX_JSON_DEPTH}",
         scope="file", detail="CAST(json_depth AS STRING)"),
)

# Rules over blocks of Python code; ``python_blocks`` raises them.
BLOCK_RULES: tuple[Rule, ...] = (
    Rule("PY-03", "python", "security", "warning", "Use of '{}' function can be dangerous",
         "Avoid using {}().", "true", scope="block"),
    Rule("PY-04", "python", "bug", "warning", "Bare except clause catches all exceptions",
         "Specify the exception type(s) to catch. Use 'except Exception:' at minimum.",
         "true", scope="block"),
    Rule("PY-05", "python", "bug", "warning", "Function '{}' has mutable default argument",
         "Use None as default and create the mutable object inside the function.",
         "true", scope="block"),
    Rule("PY-06", "python", "maintainability", "info", "Function '{}' is too long ({} lines)",
         "Consider breaking this function into smaller, more focused functions.",
         "true", scope="block"),
    Rule("PY-07", "python", "maintainability", "info", "Function '{}' has too many parameters ({})",
         "Consider using a configuration object or reducing the number of parameters.",
         "true", scope="block"),
    Rule("PY-08", "python", "performance", "warning", "String concatenation in loop is inefficient",
         "Use ''.join() or a list to collect strings, then join them.", "true", scope="block"),
)

# Off unless asked for: the check exists without a caller in the original behaviour.
PY_SQL_FORMAT = r"""\.(execute|executemany|raw)\(\s*([fF]["']|["'][^"']*["']\s*(%|\.format\())"""
OPTIONAL_RULES: tuple[Rule, ...] = (
    Rule("PY-10", "python", "security", "error", "Potential SQL injection vulnerability",
         "Use parameterized queries instead of string formatting.",
         all_of(has(".execute", ".raw("), found(PY_SQL_FORMAT))),
)


SCOPES = ("line", "statement", "key", "file", "block")


def register_rule(
    rule_id: str,
    language: str,
    category: str,
    severity: str,
    description: str,
    recommendation: str,
    predicate: str | Callable[[], Column],
    scope: str = "line",
    rules: tuple[Rule, ...] = RULES,
    ahead: int = 0,
) -> tuple[Rule, ...]:
    """``rules`` with one more rule. The predicate is an SQL expression, or a function that makes a
    column, over ``text``, ``line_no``, ``prev_line`` and the file flags.

    Scopes are ``line``, ``statement`` (SQL), ``key`` (repeated keys of JSON, as ``text``), ``file`` and
    ``block`` (Python; ``kind``, ``name``, ``body`` and more, see ``python_blocks.block_units``). A line
    rule with ``ahead`` reads that many following lines, joined by newlines, as ``ahead``; a function that
    makes a column finds at least as many in the array ``ahead``.
    """
    if ahead and (scope != "line" or ahead < 0):
        raise ValueError("only a line rule looks ahead")
    if ahead and isinstance(predicate, str):
        predicate = re.sub(r"\bahead\b", f"array_join(slice(ahead, 1, {int(ahead)}), '\\\\n')", predicate)
    if any(r.rule_id == rule_id for r in rules + BLOCK_RULES):
        raise ValueError(f"rule {rule_id} exists")
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope}")
    only = {"statement": "sql", "key": "json", "block": "python"}.get(scope, language)
    if language != only:
        raise ValueError(f"scope {scope} is of {only} files")
    return rules + (
        Rule(rule_id, language, category, severity, description, recommendation, predicate, scope, ahead=ahead),
    )


MOST_TABLE_RULES = 1000


def rules_from_table(table: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """``rules`` with the rows of a configuration table; its predicates are SQL expressions. A column
    ``ahead`` gives the lines a rule looks ahead.

    A rule becomes part of the plan, so the table is read when the plan is made. It is a
    configuration table of at most MOST_TABLE_RULES rows, which is checked.
    """
    columns = ("rule_id", "language", "category", "severity", "description", "recommendation",
               "predicate", "scope")
    ahead = F.col("ahead") if "ahead" in table.columns else F.lit(0)
    rows = table.select(*columns, F.coalesce(ahead, F.lit(0)).alias("ahead")).orderBy("rule_id").limit(MOST_TABLE_RULES + 1).collect()
    if len(rows) > MOST_TABLE_RULES:
        raise ValueError(f"more than {MOST_TABLE_RULES} rules")
    for row in rows:
        rules = register_rule(*row[:-1], rules=rules, ahead=row["ahead"])
    return rules


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES + BLOCK_RULES) -> DataFrame:
    """The catalog as a relation. Its size is the number of rules."""
    rows = [(r.rule_id, r.language, r.category, r.severity, r.description, r.recommendation)
            for r in rules]
    return spark.createDataFrame(
        rows, "rule_id string, language string, category string, severity string, "
              "description string, recommendation string")


#: Rules on credentials, which may be limited to the head of a file.
SECRET_RULES = ("PY-01", "PY-02", "JS-01", "JS-02")


def within_first_lines(rules: tuple[Rule, ...], limit: int = SECRET_LINE_LIMIT,
                       rule_ids: tuple[str, ...] = SECRET_RULES) -> tuple[Rule, ...]:
    """The rules with those of ``rule_ids`` limited to the first ``limit`` lines of a file."""
    return tuple(replace(r, predicate=all_of(f"line_no <= {limit}", r.predicate)) if r.rule_id in rule_ids else r
                 for r in rules)
