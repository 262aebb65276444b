"""Checks over JSON text that need no parser of our own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON strings and numbers. Repeats are possessive, see ``units``.
JSON_STRING = r'"(?:[^"\\\x00-\x1f]++|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+"'
LOOSE_STRING = r'"(?:[^"\\]++|\\.)*+"'
JSON_NUMBER = r"-?Infinity|NaN|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
JSON_KEY = r'"([^"]+)"\s*:'


def _brackets(content: Column) -> Column:
    """Brackets in order, with ``v`` for a run of anything else between them."""
    bare = F.regexp_replace(content, "(?s)" + LOOSE_STRING, "0")
    bare = F.regexp_replace(bare, r"[ \t\r\n]+", "")
    return F.regexp_replace(bare, r"[^\[\]{}]+", "v")


def _walk(content: Column) -> Column:
    """(depth, deepest, closed): bracket depth at the end, the greatest depth reached by an
    empty container or a value, and the marks from the one that closes the root on: 1 if
    nothing follows it."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"), F.lit(0).alias("closed"))

    def step(state: Column, mark: Column) -> Column:
        opens, closes = mark.isin("[", "{"), mark.isin("]", "}")
        depth = state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        reached = F.when(opens, depth).when(closes, 0).otherwise(state["depth"] + 1)
        return F.struct(
            depth.alias("depth"),
            F.greatest(state["deepest"], reached).alias("deepest"),
            (state["closed"] + F.when((state["closed"] > 0) | (~opens & (depth <= 0)), 1).otherwise(0))
            .alias("closed"),
        )

    return F.aggregate(F.split(_brackets(content), ""), start, step)


def json_depth(content: Column) -> Column:
    """Nesting depth: a scalar root is 1, an empty container at depth d is d, a value in it d+1."""
    return _walk(F.trim(content))["deepest"]


def json_is_valid(content: Column) -> Column:
    """One JSON value and nothing after it.

    Strings and numbers are checked by their patterns and replaced before the parse: the
    built-in parser accepts less in numbers (no NaN) and ignores text after the value.
    """
    masked = F.regexp_replace(content, JSON_STRING, '""')
    masked = F.regexp_replace(masked, JSON_NUMBER, "0")
    scalar = masked.rlike(r'^[ \t\r\n]*(?:""|0|true|false|null)[ \t\r\n]*$')
    container = masked.rlike(r"^[ \t\r\n]*[\[{]") & (_walk(content)["closed"] == 1) & masked.rlike(
        r"[\]}][ \t\r\n]*$")
    return scalar | (container & F.try_parse_json(masked).isNotNull())


def repeated_keys(content: Column) -> Column:
    """Each key that occurred before, once per further occurrence, anywhere in the file."""
    keys = F.array_sort(F.regexp_extract_all(content, F.lit(JSON_KEY), F.lit(1)))
    shifted = F.concat(F.array(F.lit(None).cast("string")), keys)
    return F.array_compact(F.zip_with(keys, shifted, lambda key, prev: F.when(key == prev, key)))
