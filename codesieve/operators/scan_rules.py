"""Files to issues in one pass over the units of each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.paths import any_of
from codesieve.operators.catalog import RULES, Rule
from codesieve.operators.python_blocks import block_units
from codesieve.operators.units import file_keys, file_units
from codesieve.schemas import ISSUE_COLUMNS
from codesieve.session import configure


def _scopes(rules: tuple[Rule, ...]) -> dict[str, set[str]]:
    scopes: dict[str, set[str]] = {}
    for rule in rules:
        scopes.setdefault(rule.language, set()).add(rule.scope)
    return scopes


def _parse_from(rules: tuple[Rule, ...]) -> int:
    """Characters that a JSON file must exceed for any of the rules to hold."""
    return min((r.more_chars_than for r in rules if r.language == "json"), default=0)


def _hits(rules: list[Rule]) -> Column:
    """Findings of the rules that hold for a unit, in catalog order."""
    if any(callable(r.predicate) for r in rules):
        return F.array_compact(F.array(*[r.hit() for r in rules]))
    cases = [f"CASE WHEN {r.predicate} THEN {r.finding()} END" for r in rules]
    return F.expr(f"array_compact(array({', '.join(cases)}))")


def _any(rules: list[Rule]) -> Column:
    """True if one of the rules holds."""
    written = [r.predicate for r in rules if isinstance(r.predicate, str)]
    made = [r.predicate() for r in rules if callable(r.predicate)]
    return any_of(([F.expr(" OR ".join(f"({p})" for p in written))] if written else []) + made)


def unit_findings(units: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Units with findings: the text once, and ``found``, an array of them. Every unit meets the rules
    of its own language and scope only.

    Most units meet none of them. They are dropped by a plain condition, before findings are
    built for the rest.
    """
    groups: dict[tuple[str, str], list[Rule]] = {}
    for rule in rules:
        groups.setdefault((rule.language, rule.scope), []).append(rule)
    some, hits = None, None
    for (language, scope), members in groups.items():
        test = (F.col("language") == language) & (F.col("scope") == scope)
        one, found = _any(members), _hits(members)
        some = F.when(test, one) if some is None else some.when(test, one)
        hits = F.when(test, found) if hits is None else hits.when(test, found)
    line = F.col("line_no")
    end = F.col("line_end") if "line_end" in units.columns else line
    return units.where(some).select(*file_keys(units), line.alias("line_start"), end.alias("line_end"),
                                    F.col("text").alias("code_snippet"), hits.alias("found"),
                                    *[c for c in units.columns if c == "around"])


def issues_of(rows: DataFrame, *texts: str) -> DataFrame:
    """One row per finding; ``texts`` are the columns that stand for the text.

    Rows have one finding at least, so the outer form gives no others. For the plain one Spark adds a filter
    on the size of ``found`` and moves it below all the rows are made from, which is then all done twice.
    """
    keys = file_keys(rows)
    issues = rows.select(*keys, "line_start", "line_end", *texts, F.inline_outer("found"))
    return issues.select(*keys, *[c for c in ISSUE_COLUMNS if c not in (*keys, "code_snippet")], *texts)


def scan_units(units: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Issues of units, each with the whole text of its unit."""
    return issues_of(unit_findings(units, rules), "code_snippet")


def scan_rules(files: DataFrame, rules: tuple[Rule, ...] = RULES, strict_start: bool = False) -> DataFrame:
    """Issues of all line, statement, key and file rules."""
    return issues_of(rule_findings(files, rules, strict_start), "code_snippet")


def scan_with_context(files: DataFrame, rules: tuple[Rule, ...] = RULES, context: int = 2) -> DataFrame:
    """Issues of the rules with the lines up to ``context`` before and after their first line, taken in
    the pass over the lines: no file is read or moved a second time."""
    configure(files.sparkSession)
    rows = unit_findings(file_units(files, _scopes(rules), context=context, parse_from=_parse_from(rules)), rules)
    first, lines = F.col("around.first"), F.col("around.lines")
    return issues_of(rows.withColumns({
        "context_start": first, "context_end": first + F.size(lines) - 1, "context": F.array_join(lines, "\n"),
    }), "code_snippet", "context_start", "context_end", "context")


def rule_findings(files: DataFrame, rules: tuple[Rule, ...] = RULES, strict_start: bool = False) -> DataFrame:
    """Units with findings. Rules of scope ``block`` read the relation of Python blocks, and only if
    there are such rules it is made."""
    configure(files.sparkSession)
    plain, blocks = [tuple(r for r in rules if (r.scope == "block") == b) for b in (False, True)]
    if not blocks:
        width = max((r.ahead for r in plain), default=0)
        return unit_findings(file_units(
            files, _scopes(plain), strict_start, width=width, parse_from=_parse_from(plain)), plain)
    found = unit_findings(block_units(files), blocks)
    return rule_findings(files, plain, strict_start).unionByName(found) if plain else found
