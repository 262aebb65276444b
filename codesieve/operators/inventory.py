"""What a repository holds: which files are scanned, languages, frameworks, sizes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codesieve.functions.paths import (
    dotted_extension,
    file_name,
    matches_any_glob,
    relative_path,
    under_directory,
)
from codesieve.settings import (
    ANALYZED_EXTENSIONS,
    DEFAULT_EXCLUDES,
    FRAMEWORK_MARKERS,
    INVENTORY_PRUNED_DIRECTORIES,
    LANGUAGE_PROFILES,
    MAX_FILE_BYTES,
    PRUNED_DIRECTORIES,
)


def supported_extensions() -> list[str]:
    return sorted({ext for group in ANALYZED_EXTENSIONS.values() for ext in group})


def rule_language(ext: Column) -> Column:
    """Language whose rules read files with this extension, null if none does."""
    pairs = [F.lit(part) for language, group in ANALYZED_EXTENSIONS.items()
             for e in group for part in (e, language)]
    return F.element_at(F.create_map(*pairs), ext)


def languages_of(ext: Column, profile: str = "inventory") -> Column:
    """Array of the languages an extension stands for; one may have several."""
    table: dict[str, list[str]] = {}
    for e, language in LANGUAGE_PROFILES[profile]:
        table.setdefault(e, []).append(language)
    pairs = [part for e, names in table.items()
             for part in (F.lit(e), F.array(*[F.lit(n) for n in names]))]
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.array().cast("array<string>"))


def review_language(ext: Column) -> Column:
    return F.coalesce(F.get(languages_of(ext, "review"), F.lit(0)), F.lit("unknown"))


# --- which files are scanned --------------------------------------------------------

def relative(files: DataFrame) -> Column:
    return relative_path(F.col("file_path"), F.col("repo_path"))


def filter_size(files: DataFrame, cap: int = MAX_FILE_BYTES) -> DataFrame:
    """Files up to the cap; unknown sizes are left out."""
    return files.where(F.col("size_bytes") <= cap)


def filter_supported(files: DataFrame) -> DataFrame:
    return files.where(dotted_extension(F.col("file_path")).isin(supported_extensions()))


def prune_dirs(files: DataFrame, names: Iterable[str] = PRUNED_DIRECTORIES) -> DataFrame:
    return files.where(~under_directory(relative(files), names))


def exclude_globs(files: DataFrame, patterns: Iterable[str] = DEFAULT_EXCLUDES) -> DataFrame:
    return files.where(~matches_any_glob(F.col("file_path"), patterns))


def recent_only(files: DataFrame, days: int, now: Column) -> DataFrame:
    return files.where(F.col("modified_at") >= now - F.make_interval(days=F.lit(days)))


def scannable(files: DataFrame, excludes: Iterable[str] = DEFAULT_EXCLUDES,
              cap: int = MAX_FILE_BYTES) -> DataFrame:
    """Files a scan reads. Only names and sizes are looked at, before any content is read."""
    kept = prune_dirs(filter_supported(filter_size(files, cap)))
    return exclude_globs(kept, excludes) if excludes else kept


# --- what a repository holds --------------------------------------------------------

def language_inventory(files: DataFrame, profile: str = "inventory") -> DataFrame:
    """Files per repository and language; a repository without a known one has ``unknown``."""
    ext = dotted_extension(F.col("file_path"))
    names = languages_of(ext, profile)
    kept = prune_dirs(files, INVENTORY_PRUNED_DIRECTORIES)
    rows = kept.select("repo_path", F.explode_outer(names).alias("language"))
    counted = rows.groupBy("repo_path", "language").agg(F.count(F.lit(1)).alias("files"))
    known = F.count("language").over(Window.partitionBy("repo_path"))
    # The window sees one row per repository and language.
    return (counted.withColumn("known", known)
            .where(F.col("language").isNotNull() | (F.col("known") == 0))
            .select("repo_path", F.coalesce("language", F.lit("unknown")).alias("language"), "files"))


def detected_languages(files: DataFrame, profile: str = "inventory") -> DataFrame:
    """One row per repository with the sorted list of its languages."""
    names = F.array_sort(F.collect_set("language")).alias("languages")
    return language_inventory(files, profile).groupBy("repo_path").agg(names)


def first_names(files: DataFrame, count: int = 100) -> DataFrame:
    """The first ``count`` names of each directory. The sampling of directories is the feature;
    Spark keeps ``count`` rows per directory in each task before the shuffle."""
    folder = F.regexp_extract("file_path", "(?s)^(.*)/[^/]*$", 1)
    order = Window.partitionBy("folder").orderBy("file_path")
    return (files.withColumn("folder", folder)
            .withColumn("position", F.row_number().over(order))
            .where(F.col("position") <= count).drop("folder", "position"))


def repo_size(files: DataFrame, excludes: Iterable[str] = DEFAULT_EXCLUDES) -> DataFrame:
    return exclude_globs(files, excludes).groupBy("repo_path").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_bytes"))


def framework_markers(spark: SparkSession) -> DataFrame:
    """Marker names and their frameworks; the table is fixed."""
    rows = [(marker.rstrip("/"), marker.endswith("/"), name)
            for name, markers in FRAMEWORK_MARKERS.items() for marker in markers]
    values = ", ".join(f"('{m}', {str(d).lower()}, '{n}')" for m, d, n in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS m(marker, is_directory, framework)")


def frameworks(files: DataFrame) -> DataFrame:
    """Frameworks of each repository whose marker file or directory is present."""
    parts = F.split(relative(files), "/")
    names = F.concat(
        F.transform(F.slice(parts, 1, F.size(parts) - 1),
                    lambda p: F.struct(p.alias("marker"), F.lit(True).alias("is_directory"))),
        F.array(F.struct(file_name(F.col("file_path")).alias("marker"),
                         F.lit(False).alias("is_directory"))))
    found = files.select("repo_path", F.inline(F.array_distinct(names)))
    return found.join(framework_markers(files.sparkSession), ["marker", "is_directory"]).select(
        "repo_path", "framework").distinct()
