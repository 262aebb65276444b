"""The operators as pipeline stages: documents in, documents out.

Every stage takes rows with doc_id, text, lang and source (other columns come through, also if
their names clash with an operator's own) and works on all of them. A row is known by its id and
text, so rows without an id are kept apart and repeated rows share their fate. Null and empty
texts have no language and go in the first stage; the other stages take them like any text. An
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm import decontam, langid, mixing, sharding, simhash

SHARDS, OLD_SHARDS = 16, 12
KEY = "__key"


def _key() -> Column:
    """Known rows in the order of their ids, rows without an id last."""
    return F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"),
                    F.xxhash64("text").alias("hash"))


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_known(docs: DataFrame) -> DataFrame:
    """Documents of which the model names a language. It is trained on the rows outside the held-out
    fold; texts that are null or have no letter are rejected, and all texts if no row has a language."""
    model = langid.train(docs.where(langid.fold() != 1))
    return langid.identified(docs, model).where(F.col("__lang") != langid.UNKNOWN).select(_own(docs))


def one_of_near_duplicates(docs: DataFrame) -> DataFrame:
    """The document of least id of each group linked by near-equal fingerprints."""
    keyed = docs.withColumn(KEY, _key())
    kept = simhash.near_duplicates(keyed.select(KEY, "text"), KEY).where(F.col("id") == F.col("component_id"))
    return keyed.join(kept.select(F.col("id").alias("__kept")).distinct(), F.col(KEY) == F.col("__kept"),
                      "left_semi").select(_own(docs))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a benchmark window."""
    keyed = docs.withColumn(KEY, _key())
    hit = decontam.contamination(keyed.select(KEY, "text"), benchmark, KEY).where("n_hit > 0")
    return keyed.join(hit.select(F.col("id").alias("__hit")).distinct(), F.col(KEY) == F.col("__hit"),
                      "left_anti").select(_own(docs))


def mixed(docs: DataFrame) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def sharded(docs: DataFrame) -> DataFrame:
    """Rows with their shard and slot, read from the shards' files."""
    rows = sharding.reshard(docs, SHARDS, OLD_SHARDS)
    return rows.select(*_own(docs), F.col("__shard").alias("shard"), F.col("__slot").cast("long").alias("slot"))
