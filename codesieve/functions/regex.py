"""Regular expressions that mean the same as Python's ``re`` on text columns.

Spark's engine reads ``\\w``, ``\\s`` and ``\\d`` as ASCII and rejects a bare brace. The
patterns of the rule catalog are kept in their plain form and spelled out here for the
engine at hand. Only the constructs the catalog uses are covered.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
_CLASSES = {"s": SPACE, "w": WORD, "d": DIGIT}

_PIECE = re.compile(
    r"(?P<set>\[(?:\\.|[^\]\\])+\])"      # character set
    r"|(?P<escape>\\.)"                   # escape
    r"|(?P<count>\{\d+(?:,\d*)?\})"       # repeat count
    r"|(?P<brace>[{}])"                   # literal brace
    r"|(?P<other>.)",
    re.S,
)


def portable(pattern: str, ignore_case: bool = False, engine: str = "java") -> str:
    """Spell ``pattern`` for ``engine`` ("java" or "re2") with Unicode classes."""

    def spell(match: re.Match) -> str:
        text = match.group()
        if match["set"]:
            return re.sub(r"\\([swd])", lambda m: _CLASSES[m[1]], text)
        if match["escape"] and text[1] in _CLASSES:
            return f"[{_CLASSES[text[1]]}]"
        return "\\" + text if match["brace"] else text

    flags = "s" + ("i" if ignore_case else "") + ("u" if ignore_case and engine == "java" else "")
    return f"(?{flags})" + _PIECE.sub(spell, pattern)


def sql_text(text: str) -> str:
    """``text`` as an SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def matches(column: Column, pattern: str, ignore_case: bool = False) -> Column:
    return column.rlike(portable(pattern, ignore_case))


def strip(column: Column) -> Column:
    """Trim all Unicode white space from both ends."""
    return F.regexp_replace(column, f"^[{SPACE}]+|[{SPACE}]+$", "")


def lstrip(column: Column) -> Column:
    return F.regexp_replace(column, f"^[{SPACE}]+", "")
