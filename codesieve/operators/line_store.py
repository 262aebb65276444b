"""Texts of issues kept once and joined late.

A line may be long and have many issues; a minified file is one line. Where issues are written,
shuffled or compared they carry two hashes instead of their text: ``text_key`` of the text itself, and
``snippet_key`` of the trimmed text, which is what scans are compared by. A text is one row of a table of
its own and comes back by a join when it is shown. All lengths take this way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import text_name
from codesieve.operators.reuse import spread_key

KEYS = ("text_key", "snippet_key")


def text_key(text: Column) -> Column:
    """Null for an issue without text, as one from a review."""
    return F.sha2(text, 256)


def snippet_key(text: Column) -> Column:
    return text_name(F.coalesce(text, F.lit("")))


def with_keys(rows: DataFrame, text: str = "code_snippet") -> DataFrame:
    return rows.withColumns({"text_key": text_key(F.col(text)), "snippet_key": snippet_key(F.col(text))})


def distinct_texts(rows: DataFrame) -> DataFrame:
    """One row (text_key, code_snippet) per text. Equal texts meet once per task before the shuffle."""
    return rows.where("text_key IS NOT NULL").groupBy("text_key").agg(F.first("code_snippet").alias("code_snippet"))


def with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``code_snippet`` in place of the keys. A text that a third of the issues have is spread."""
    found = rows.where("text_key IS NOT NULL").join(spread_key(texts, "text_key"), "text_key", "left")
    none = rows.where("text_key IS NULL").withColumn("code_snippet", F.lit(None).cast("string"))
    return found.unionByName(none).drop(*KEYS)
