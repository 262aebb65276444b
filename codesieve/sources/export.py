"""Issue exports: table rows, CSV files, text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.session import written
from codesieve.settings import EXPORT_COLUMNS

REPORT_FORMATS = ("text", "markdown")


def export_rows(issues: DataFrame) -> DataFrame:
    """Issues under their export names, absent values replaced by the defaults."""
    return issues.select(*[
        F.coalesce(F.col(column).cast("string"), F.lit(default)).alias(label)
        for label, column, default in EXPORT_COLUMNS])


def write_csv(issues: DataFrame, path: str) -> None:
    """CSV files with a header; a single line says so if there are no issues.

    Quotes inside a value are doubled, as spreadsheet readers expect.
    """
    rows = export_rows(issues)
    if rows.isEmpty():
        message = rows.sparkSession.range(1).select(F.lit("No issues found").alias("value"))
        message.write.mode("overwrite").text(path)
        return
    (rows.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("emptyValue", "").csv(path))


def report_lines(issues: DataFrame, scan_date: str | None = None,
                 title: str = "Code Scan Report") -> DataFrame:
    """Lines of the text report with the columns that order them.

    Categories stand in the order of their first issue by file, line, rule and name; issues
    without one are "Other". ``ordinal``, the number an issue is written with, keeps the lines of equal
    issues together. The report is a sorted table of lines: sorting splits a category of
    any size over tasks, where collecting its text would not. Issues are written to the shared
    folder first, so that the rules run once for counts and lines.
    """
    blank = F.lit("")
    issues = written(issues.select(
        F.coalesce("category", F.lit("Other")).alias("category"), "severity", "file_path", "line_start",
        F.coalesce("rule_id", blank).alias("rule_id"), "description", "recommendation",
        F.monotonically_increasing_id().alias("ordinal")), "report")
    place = F.struct(F.coalesce("file_path", blank).alias("file_path"),
                     F.coalesce("line_start", F.lit(0)).alias("line_start"), "rule_id")
    totals = issues.groupBy("category").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("issues"),
    ).withColumn("section", F.concat_ws(
        "\x1f", "first.file_path", F.format_string("%010d", "first.line_start"), "first.rule_id", "category"))
    name = F.col("category")

    def rows(df: DataFrame, slot: int, lines: Column, section: Column = blank,
             file_path: Column = blank, line_start: Column = F.lit(0),
             rule_id: Column = blank, text: Column = blank, rest: Column = blank,
             ordinal: Column = F.lit(0)) -> DataFrame:
        places = {"section": section, "slot": F.lit(slot), "file_path": file_path,
                  "line_start": line_start.cast("int"), "rule_id": rule_id, "text": text, "rest": rest,
                  "ordinal": ordinal.cast("long")}
        return df.select(*[c.alias(n) for n, c in places.items()],
                         F.posexplode(lines).alias("line_no", "line"))

    head = totals.agg(F.coalesce(F.sum("issues"), F.lit(0)).alias("total"))
    head_lines = F.array_compact(F.array(
        F.lit(title), F.lit("=" * len(title)),
        F.concat(F.lit("Total Issues: "), F.col("total").cast("string")),
        F.lit(f"Scan Date: {scan_date or 'Unknown'}"), blank,
        F.when(F.col("total") == 0, F.lit("No issues found."))))
    section_lines = F.array(
        F.concat(F.lit("Category: "), F.upper(name)), F.repeat(F.lit("-"), F.length(name) + 10))
    issue_lines = F.array_compact(F.array(
        F.concat(F.lit("["), F.upper(F.coalesce("severity", F.lit("INFO"))), F.lit("] "),
                 F.coalesce("file_path", blank), F.lit(":"),
                 F.coalesce(F.col("line_start").cast("string"), F.lit("?"))),
        F.concat(F.lit("Description: "), F.coalesce("description", blank)),
        F.when(F.coalesce("recommendation", blank) != "",
               F.concat(F.lit("Recommendation: "), F.col("recommendation"))),
        blank))
    placed = issues.join(totals.select("category", "section"), "category")
    section = F.col("section")
    return (
        rows(head, 0, head_lines)
        .unionByName(rows(totals, 1, section_lines, section))
        .unionByName(rows(placed, 2, issue_lines, section, F.coalesce("file_path", blank),
                          F.coalesce("line_start", F.lit(0)), F.col("rule_id"), F.coalesce("description", blank),
                          F.concat_ws("\x1f", "severity", "recommendation"), F.col("ordinal")))
        .unionByName(rows(totals, 3, F.array(blank), section))
    )


REPORT_ORDER = ("section", "slot", "file_path", "line_start", "rule_id", "text", "rest", "ordinal", "line_no")


def text_report(issues: DataFrame, scan_date: str | None = None,
                title: str = "Code Scan Report") -> DataFrame:
    """The report in order, one line per row."""
    return report_lines(issues, scan_date, title).orderBy(*REPORT_ORDER).select("line")


def numbered_report(issues: DataFrame, scan_date: str | None = None,
                    title: str = "Code Scan Report") -> DataFrame:
    """The report's lines with their numbers from 1. Sorted parts are counted, one row for each, and
    the counts of the parts before are added to the places within a part."""
    ordered = written(text_report(issues, scan_date, title).withColumn("at", F.monotonically_increasing_id()), "report-lines")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ordered.withColumn("part", part).join(F.broadcast(starts), "part").select(
        (F.col("start") + place + 1).alias("number"), "line")


def write_report(issues: DataFrame, path: str, report_format: str = "text",
                 scan_date: str | None = None, title: str = "Code Scan Report") -> None:
    """Part files that read in name order are the report. Both formats have the same text."""
    if report_format not in REPORT_FORMATS:
        raise ValueError(f"unsupported format: {report_format}")
    text_report(issues, scan_date, title).write.mode("overwrite").text(path)
