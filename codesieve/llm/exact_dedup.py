"""Exact duplicates: binary-fuse filters over immutable snapshots, then exact buckets.

A snapshot is a table with one row per distinct text and, per digest bucket, a static filter.
Digests of a new batch meet the filter of their bucket; what passes is joined with the bucket's
exact digests, and the texts behind every shared digest are compared byte by byte. Duplicates
inside the batch are grouped on their own, before they meet the snapshot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import GAP, staged

KEYS_PER_BUCKET = 100_000
SALTS = 32


# --- binary fuse filter, three segments, 8-bit fingerprints ---------------------------

@dataclass(frozen=True)
class FuseFilter:
    seed: int
    segment: int
    segments: int
    cells: bytes


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three cells of each key, in three neighbouring segments."""
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> FuseFilter:
    """The filter of distinct 64-bit keys. Peels all cells that hold one key, round by round."""
    n = len(keys)
    segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    segments = max(1, -(-int(n * factor) // segment) - 2)
    length = (segments + 2) * segment
    for seed in range(1, 1000):
        h = _mixed(keys, seed * 0x9E3779B97F4A7C15 % 2**64)
        at = _places(h, segment, segments)
        held = np.bincount(at.ravel(), minlength=length)
        total = np.bincount(at.ravel(), np.tile(np.arange(n, dtype=float), 3), minlength=length)
        rounds, left = [], n
        while len(cells := np.flatnonzero(held == 1)):
            peeled, first = np.unique(total[cells].astype(np.int64), return_index=True)
            rounds.append((peeled, cells[first]))
            left -= len(peeled)
            gone = at[:, peeled].ravel()
            held -= np.bincount(gone, minlength=length)
            total -= np.bincount(gone, np.tile(peeled.astype(float), 3), minlength=length)
        if not left:
            break
        # Small sets fail now and then; more room ends it.
        segments += 1
        length = (segments + 2) * segment
    else:
        raise ValueError("keys repeat")
    cells = np.zeros(length, np.uint8)
    prints = _prints(h)
    for peeled, own in reversed(rounds):
        a, b, c = at[:, peeled]
        cells[own] = 0
        cells[own] = prints[peeled] ^ cells[a] ^ cells[b] ^ cells[c]
    return FuseFilter(seed * 0x9E3779B97F4A7C15 % 2**64, segment, segments, cells.tobytes())


def may_hold(f: FuseFilter, keys: np.ndarray) -> np.ndarray:
    """False where a key is surely absent; true for all keys of the filter and 1 in 256 others."""
    h = _mixed(keys, f.seed)
    a, b, c = _places(h, f.segment, f.segments)
    cells = np.frombuffer(f.cells, np.uint8)
    return _prints(h) == cells[a] ^ cells[b] ^ cells[c]


# --- tables ---------------------------------------------------------------------------

def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " ")


def _key(digest: str = "digest") -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _groups(digests: DataFrame, buckets: int) -> DataFrame:
    """One row per distinct digest. Counted before the shuffle, so a hot text is a few rows."""
    return digests.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).select(
        "*", _key().alias("key"), F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"))


@dataclass(frozen=True)
class Snapshot:
    """Immutable: groups (digest, keep_id, n, key, bucket) and filters, one row per bucket."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def build_snapshot(digests: DataFrame, rows: int) -> Snapshot:
    """Writes the distinct digests and a filter for each bucket of about KEYS_PER_BUCKET keys."""
    buckets = max(1, -(-rows // KEYS_PER_BUCKET))
    groups = staged(_groups(digests, buckets), "dedup-snapshot")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = build_filter(np.unique(pdf["key"].to_numpy().astype(np.uint64)))
        return pd.DataFrame([(pdf["bucket"].iloc[0], str(f.seed), f.segment, f.segments, f.cells)],
                            columns=["bucket", "seed", "segment", "segments", "cells"])

    filters = groups.select("bucket", "key").groupBy("bucket").applyInPandas(
        build, "bucket int, seed string, segment long, segments long, cells binary")
    return Snapshot(groups, staged(filters, "dedup-filters"), buckets)


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Groups whose digest the snapshot may hold."""

    def pick(pdf: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or filters.empty:
            return pdf.iloc[:0]
        f = filters.iloc[0]
        own = FuseFilter(int(f["seed"]), int(f["segment"]), int(f["segments"]), f["cells"])
        return pdf[may_hold(own, pdf["key"].to_numpy().astype(np.uint64))]

    return groups.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInPandas(pick, groups.schema)


def _checked(docs: DataFrame, shared: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digests of which all texts are the same bytes; stops the job at any other.

    The salt spreads the copies of a hot text; each part sends its least and greatest text on.
    """
    salted = shared.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    texts = docs.select(
        normal_text(F.col(text_col)).alias("normal"),
        F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int").alias("salt"))
    texts = texts.withColumn("digest", F.sha2("normal", 256))
    ends = texts.join(salted, ["digest", "salt"], "left_semi").groupBy("digest", "salt").agg(
        F.min("normal").alias("least"), F.max("normal").alias("most"))
    ends = ends.groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    return ends.select("digest", F.when(F.col("least") != F.col("most"), F.raise_error(
        F.concat(F.lit("different texts share the digest "), "digest")).cast("boolean")).isNull().alias("same"))


def dedup_against(docs: DataFrame, in_snapshot: Column, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Every row with the row that stands for its text.

    Rows where ``in_snapshot`` is true (null counts as false) form the stored snapshot, the others
    the new batch. Returns id, digest, keep_id, group_size, kept, from both.

    Null text counts as empty. Rows are known by id: rows with the same id and text get the same
    answer, and a null id stands for a text only if all its ids are null. Other columns are not
    read, so their names do not matter. An empty table gives an empty result.
    """
    stored = F.coalesce(in_snapshot, F.lit(False))
    # One pass over the texts; what follows works on digests.
    digests = staged(docs.select(
        F.col(id_col).alias("id"), F.sha2(normal_text(F.col(text_col)), 256).alias("digest"),
        stored.alias("stored")), "dedup-digests")
    rows = digests.count()
    snapshot = build_snapshot(digests.where("stored"), rows)
    batch = staged(_groups(digests.where("NOT stored"), snapshot.buckets), "dedup-batch")
    known = screen(batch, snapshot).alias("b").join(snapshot.groups.alias("s"), ["bucket", "digest"]).select(
        "digest", F.least("b.keep_id", "s.keep_id").alias("keep_id"), (F.col("b.n") + F.col("s.n")).alias("n"))
    known = staged(known, "dedup-known")
    alone = snapshot.groups.select("digest", "keep_id", "n").unionByName(
        batch.select("digest", "keep_id", "n")).join(known, "digest", "left_anti")
    groups = alone.unionByName(known)
    checked = _checked(docs, groups.where("n > 1").select("digest"), id_col, text_col)
    # Written, so that the join below shuffles both sides itself and a hot text can be split.
    groups = staged(groups.join(checked, "digest", "left").where("n = 1 OR same").drop("same"), "dedup-groups")
    return digests.join(groups, "digest").select(
        "id", "digest", "keep_id", F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))
