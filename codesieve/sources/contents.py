"""Files split into a table of keys and a table of contents.

Decisions about files, as which are known or reviewed, need their keys and hashes only. The keys are
written once without contents. Contents are written once, bucketed by ``content_key``, so what was
decided meets them without moving them: the decided keys are shuffled to the buckets, and the block
rules find each content in one bucket already. A task writes a content it has seen once only, so
copies of a content that a third of all files share are few.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.operators.reuse import spread_key
from codesieve.session import shared_folder, written

#: Contents a task remembers having written.
REMEMBERED = 1 << 18


@dataclass(frozen=True)
class SplitFiles:
    """keys: the files' other columns and ``content_key``; contents: content_key, language, content,
    with a few rows for a content at most."""

    keys: DataFrame
    contents: DataFrame

    def with_contents(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` with their content, fetched last."""
        return self._once().drop("language").join(spread_key(keys, "content_key"), "content_key").drop("content_key")

    def of_keys(self, keys: DataFrame) -> DataFrame:
        """(content_key, language, content) of the contents that ``keys`` name, each once."""
        wanted = keys.select("content_key").distinct()
        return self.contents.join(wanted, "content_key", "left_semi").dropDuplicates(["content_key"])

    def _once(self) -> DataFrame:
        return self.contents.dropDuplicates(["content_key"])


def split_files(files: DataFrame, buckets: int | None = None) -> SplitFiles:
    """Writes both tables below the shared folder. Files without content have keys only. ``buckets``
    is the number of shuffle partitions unless given."""
    spark = files.sparkSession
    key = F.concat_ws(":", "content_hash", F.coalesce("language", F.lit("")))
    keyed = files.withColumn("content_key", key)
    keys = written(keyed.drop("content"), "file-keys")

    def first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            new = []
            for k in batch.column("content_key").to_pylist():
                new.append(k not in seen)
                seen.add(k)
            if len(seen) > REMEMBERED:
                seen.clear()
            yield batch.filter(pa.array(new, pa.bool_()))

    rows = keyed.where(F.col("content").isNotNull()).select("content_key", "language", "content")
    rows = rows.mapInArrow(first_seen, rows.schema)
    name = f"contents_{uuid.uuid4().hex}"
    number = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (rows.write.bucketBy(number, "content_key").sortBy("content_key")
     .option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name))
    contents = spark.table(name)
    # The rows stay in their folder; the name was needed to write buckets and to read them as such.
    spark.sql(f"DROP TABLE {name}")
    return SplitFiles(keys, contents)
