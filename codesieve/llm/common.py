"""Helpers the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path nobody uses yet, in the folder all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again.

    Cuts the lineage: a lost executor costs its running tasks only.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def hash60(column: Column) -> Column:
    """60 even bits of a value's text form. SQL engines with md5 give the same number."""
    text = F.coalesce(column.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def pieces(raw: bytes, gap: re.Pattern[bytes], size: int = 1 << 20) -> Iterator[bytes]:
    """raw in pieces of about ``size`` bytes that end before a match of ``gap``, so no word is cut.
    A text of one endless word is one piece."""
    first = 0
    while first < len(raw):
        cut = gap.search(raw, first + size) if len(raw) - first > size else None
        end = cut.start() if cut else len(raw)
        yield raw[first:end]
        first = end


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per session, for functions that run there."""
    context = spark.sparkContext
    if getattr(context, "_codesieve_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="codesieve-package-")) / "codesieve.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(path))
    context._codesieve_shipped = True
