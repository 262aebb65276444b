"""Scalar functions over file contents, sizes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesieve.functions.regex import strip
from codesieve.settings import DISPLAY_SEVERITY


def normalize_newlines(content: Column) -> Column:
    return F.regexp_replace(content, "\r\n?", "\n")


def decode_text(data: Column) -> Column:
    """UTF-8 text of a binary column: undecodable bytes dropped, newlines unified.

    An invalid sequence becomes U+FFFD and is then removed. A file that really holds
    U+FFFD loses it, so the file source decodes in its reader instead; this form is for
    tables that already hold bytes.
    """
    valid = F.make_valid_utf8(data.cast("string"))
    return normalize_newlines(F.replace(valid, F.lit("�"), F.lit("")))


def lines_of(content: Column) -> Column:
    """Lines in order; empty lines and the empty line after a final newline are kept."""
    return F.split(content, "\n")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def count_lines(content: Column) -> Column:
    """Number of lines as a reader iterates them: a final newline adds none."""
    total = F.size(lines_of(content))
    return F.when((content == "") | F.endswith(content, F.lit("\n")), total - 1).otherwise(total)


def is_binary(data: Column) -> Column:
    return F.contains(F.substring(data, 1, 1024), F.lit(b"\x00"))


def estimate_tokens(content: Column) -> Column:
    return F.floor(F.length(content) / 4).cast("long")


def human_size(size_bytes: Column) -> Column:
    """Size with one decimal in steps of 1024; ties round to even."""

    def shown(power: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", F.bround(size_bytes / F.lit(1024.0 ** power), 1))

    label = shown(4, "TB")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        label = F.when(size_bytes < F.lit(1024 ** (power + 1)), shown(power, unit)).otherwise(label)
    return label


def capitalize(text: Column, lower_tail: bool = True) -> Column:
    tail = F.substring(text, 2, 2147483647)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(tail) if lower_tail else tail)


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def display_severity(category: Column) -> Column:
    """Severity shown for a category; the stored severity stays the rule's own."""
    pairs = [F.lit(part) for pair in DISPLAY_SEVERITY.items() for part in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), category), F.lit("warning"))


def zero_based(line: Column) -> Column:
    return F.greatest(F.lit(0), line - 1)


def text_name(text: Column) -> Column:
    """Name of a text by the hash of what is left without white space around it."""
    return F.concat(F.lit("sha256:"), F.sha2(strip(text), 256))


def context_start(line: Column, context: int = 2) -> Column:
    return F.greatest(F.lit(1), line - context)


def context_end(line: Column, total: Column, context: int = 2) -> Column:
    return F.least(total, line + context)
