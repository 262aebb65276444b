"""Path functions. Paths use ``/``; those from other systems may use a backslash."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Last suffix without the dot; a leading dot starts no suffix."""
    return F.regexp_extract(file_name(path), r"(?<=.)\.([^.]+)$", 1)


def dotted_extension(path: Column) -> Column:
    """Lower-cased last suffix with its dot, empty if there is none."""
    suffix = F.lower(extension(path))
    return F.when(suffix == "", "").otherwise(F.concat(F.lit("."), suffix))


def relative_path(path: Column, base: Column) -> Column:
    prefix = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))
    inside = F.startswith(path, prefix)
    return F.when(inside, F.substr(path, F.length(prefix) + 1)).otherwise(path)


def tail_parts(path: Column, count: int = 3) -> Column:
    parts = F.split(path, r"[\\/]")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - (count - 1), F.lit(1)), count), "/")


def under_directory(rel_path: Column, names: Iterable[str]) -> Column:
    """True if any directory part of a path relative to the scanned root is in ``names``."""
    parts = F.split(rel_path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(n) for n in names]))


def glob_regex(pattern: str) -> str:
    """Regular expression of a file-name glob in which ``*`` crosses ``/``."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        close = pattern.find("]", i + 2) if char == "[" else -1
        if char == "*":
            if out[-1:] != [".*"]:
                out.append(".*")
        elif char == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1:close].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]")
            i = close
        else:
            out.append(re.sub(r"([^\w/ -])", r"\\\1", char))
        i += 1
    return "".join(out)


def matches_any_glob(path: Column, patterns: Iterable[str]) -> Column:
    """One regular expression for all globs, built when the plan is made."""
    parts = [glob_regex(p) for p in patterns]
    if not parts:
        return F.lit(False)
    return path.rlike("(?s)^(?:" + "|".join(parts) + ")$")


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
