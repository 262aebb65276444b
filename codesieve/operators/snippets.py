"""Lines around an issue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import context_end, context_start, lines_of
from codesieve.operators.units import file_keys


def context_snippets(files: DataFrame, issues: DataFrame, context: int = 2) -> DataFrame:
    """Issues of any origin with the lines up to ``context`` before and after their first line. The
    rules' own issues have them without a shuffle by ``scan_rules.scan_with_context``.

    The issues of a file are gathered next to its text, so a text is shuffled once and no line
    is joined with a line. A file is capped in size; so are its issues.
    """
    keys = file_keys(issues)
    fields = [c for c in issues.columns if c not in keys]
    found = issues.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("found"))
    joined = files.select(*keys, lines_of(F.col("content")).alias("lines")).join(found, keys)
    total = F.size("lines")

    def around(issue):
        start = context_start(issue["line_start"], context)
        end = context_end(issue["line_start"], total, context)
        text = F.array_join(F.slice("lines", start, end - start + 1), "\n")
        return F.struct(*[issue[f].alias(f) for f in fields], start.alias("context_start"),
                        end.alias("context_end"), text.alias("context"))

    return joined.select(*keys, F.inline(F.transform("found", around)))
