"""Files to units: lines with their neighbours, SQL statements, JSON keys, whole files.

A file is one row, so neighbours are looked up in the array of its lines before the
array is exploded. Nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.paths import any_of
from codesieve.functions.regex import lstrip
from codesieve.functions.text import lines_of
from codesieve.operators.json_files import json_depth, json_is_valid, repeated_keys

# Tokens of SQL text that may hide a semicolon. The repeats are possessive:
# a plain repeat of an alternation overflows the stack on long texts.
SQL_TOKENS = (
    r"--[^\n]*+",
    r"/\*(?:[^*]++|\*(?!/))*+\*/",
    r"'(?:[^'\\]++|\\'|\\|'')*+'",
    r'"[^"]*+"',
    r"[^;'\"/\-]++",
    r"[/\-'\"]",
)
SQL_STATEMENT = "(?:" + "|".join(SQL_TOKENS) + ")++;?"

# How many following lines each look-ahead reads.
AHEAD = (("ahead_key", "key=", 3), ("ahead_accessible", "accessible", 5),
         ("ahead_extractor", "keyExtractor", 10))

UNIT_COLUMNS = ("scope", "line_no", "text", "prev_line", *(name for name, _, _ in AHEAD))
FLAG_COLUMNS = ("react", "react_native", "sensitive", "limited",
                "json_valid", "json_chars", "json_depth")
FILE_KEYS = ("scan_id", "repo_path", "file_path")


def file_keys(files: DataFrame) -> list[str]:
    """Columns that name a file; ``scan_id`` too where several scans are read together."""
    return [c for c in FILE_KEYS if c in files.columns]


def sql_statements(content: Column) -> Column:
    """Statements in order, each with its semicolon; blank ones are left out."""
    found = F.regexp_extract_all(content, F.lit(SQL_STATEMENT), F.lit(0))
    return F.filter(found, lambda s: lstrip(s) != "")


def with_file_flags(files: DataFrame, parse_from: int = 0) -> DataFrame:
    """Conditions over the whole text, each computed only for the language that asks. JSON files of
    ``parse_from`` characters or fewer are not checked for validity."""
    content, language = F.col("content"), F.col("language")

    def flag(name: str, *texts: str, of: Column = content) -> Column:
        present = any_of(F.contains(of, F.lit(t)) for t in texts)
        return F.when(language == name, present).otherwise(F.lit(False))

    json = language == "json"
    return files.withColumns({
        "react_native": flag("javascript", "react-native"),
        "react": flag("javascript", "import React", "from 'react'", 'from "react"', "react-native"),
        "sensitive": F.when(
            (language == "java") & F.contains(content, F.lit("new Random()")),
            flag("java", "password", "token", of=F.lower(content)),
        ).otherwise(F.lit(False)),
        "limited": flag("sql", "LIMIT", of=F.upper(content)),
        "json_valid": F.when(json & (F.length(content) > parse_from), json_is_valid(content)),
        "json_chars": F.when(json, F.length(content).cast("long")),
        "json_depth": F.when(json, json_depth(content)),
    })


def _around(lines: Column, line_no: Column, context: int) -> Column:
    """The lines up to ``context`` before and after one, and the number of the first."""
    first = F.greatest(F.lit(1), line_no - context).cast("int")
    return F.struct(first.alias("first"), F.slice(lines, first, (line_no + context - first + 1).cast("int")).alias("lines"))


def _unit(scope: str, line_no: Column, text: Column, prev: Column | None = None,
          ahead: Iterable[Column] = (), around: Column | None = None,
          following: Column | None = None) -> Column:
    blank = F.lit(None).cast("boolean")
    ahead = list(ahead) or [blank for _ in AHEAD]
    return F.struct(
        F.lit(scope).alias("scope"), line_no.cast("int").alias("line_no"), text.alias("text"),
        (F.lit(None).cast("string") if prev is None else prev).alias("prev_line"),
        *[a.alias(name) for a, (name, _, _) in zip(ahead, AHEAD)],
        *([] if around is None else [around.alias("around")]),
        *([] if following is None else [following.alias("ahead")]),
    )


def _lines(lines: Column, look_ahead: bool, context: int | None, width: int) -> Column:
    def follows(i: Column, marker: str, count: int) -> Column:
        return any_of(
            F.coalesce(F.contains(F.get(lines, i + step), F.lit(marker)), F.lit(False))
            for step in range(1, count + 1)
        )

    def unit(line: Column, i: Column) -> Column:
        ahead: list[Column] = []
        if look_ahead:
            wanted = {"ahead_key": ".map(", "ahead_accessible": "<", "ahead_extractor": "<FlatList"}
            ahead = [
                F.when(F.contains(line, F.lit(wanted[name])), follows(i, marker, count))
                for name, marker, count in AHEAD
            ]
        return _unit("line", i + 1, line, F.when(i > 0, F.get(lines, i - 1)), ahead,
                     None if context is None else _around(lines, i + 1, context),
                     F.slice(lines, i + 2, width) if width else None)

    return F.transform(lines, unit)


def file_units(files: DataFrame, scopes: dict[str, set[str]], strict_start: bool = False,
               context: int | None = None, width: int = 0, parse_from: int = 0) -> DataFrame:
    """One row per unit. ``scopes`` names the unit kinds each language needs. ``context`` adds
    ``around``: the lines up to so many before and after the unit's first, from the array at hand.
    ``width`` adds ``ahead``, as many of the lines that follow a line; other units have none.
    ``parse_from`` is that of ``with_file_flags``.

    Statements lose the white space before them, so that all of them can be told by their first
    word; ``strict_start`` keeps it, and then only a statement that follows the semicolon of
    the one before directly starts with its word.
    """
    content, language, lines = F.col("content"), F.col("language"), F.col("lines")
    plain = _lines(lines, False, context, width)
    none = F.array().cast("array<string>") if width else None
    top = None if context is None else _around(lines, F.lit(1), context)
    parts = {
        "line": plain,
        "statement": F.transform(sql_statements(content), lambda s: _unit(
            "statement", F.lit(1), s if strict_start else lstrip(s), around=top, following=none)),
        "key": F.transform(repeated_keys(content), lambda k: _unit("key", F.lit(1), k, around=top, following=none)),
        "file": F.array(_unit("file", F.lit(1), F.lit(None).cast("string"), around=top, following=none)),
    }
    units = F.when(F.lit(False), plain)
    for name, kinds in scopes.items():
        wanted_parts = [parts[kind] for kind in parts if kind in kinds]
        if name == "javascript" and "line" in kinds:
            wanted_parts[0] = F.when(F.col("react"), _lines(lines, True, context, width)).otherwise(plain)
        units = units.when(
            language == name, F.concat(*wanted_parts) if len(wanted_parts) > 1 else wanted_parts[0])
    wanted = files.where((content != "") & language.isin(*scopes))
    return (
        with_file_flags(wanted, parse_from)
        .withColumn("lines", lines_of(content))
        .select(*file_keys(files), "language", *FLAG_COLUMNS, F.inline(units))
    )


def code_lines(files: DataFrame) -> DataFrame:
    """Numbered lines of every file."""
    return files.select(
        *file_keys(files), "language",
        F.posexplode(lines_of(F.col("content"))).alias("pos", "line"),
    ).select(*file_keys(files), "language", (F.col("pos") + 1).alias("line_no"), "line")
