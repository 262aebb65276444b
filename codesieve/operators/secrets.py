"""Credential lines in any table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import lines_of
from codesieve.operators.catalog import credential


def secret_lines(texts: DataFrame, text: str, *ids: str) -> DataFrame:
    """Lines with a hardcoded credential. A text without one anywhere is dropped whole: a line
    that matches makes its text match, so only few texts are split into lines."""
    kept = texts.where(credential(text))
    lines = kept.select(*ids, F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    return lines.where(credential("line")).select(
        *ids, (F.col("pos") + 1).alias("line_no"), "line")
