"""Resampling a corpus towards a target by hashed features, with exact ranks.

Features of corpus and target are counted in an array of buckets; the log ratio of a bucket's shares
is its gain, and a text weighs the sum of its features' gains. With Gumbel noise from the id added,
the highest scores are a weighted sample without replacement.

Ranks come from parallel sorting by regular sampling: every task sorts its rows into a run; keys at
regular places of the runs give splitters; rows go to the segment between two splitters, are merged
there, and the counts of the segments before give the rank of a segment's first row.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import pieces, staged

# Whole characters: letters of A-Z are lower case by then, and every byte from 0x80 is in a word.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Features a task remembers the buckets of.
REMEMBERED = 1 << 18
#: Keys that reach the driver from all runs together, besides one per run.
SAMPLES = 1 << 15
MOST_SEGMENTS = 1 << 12
SEGMENT_ROWS = 1 << 20
LARGEST = (1 << 63) - 1


def features(raw: bytes | None, most_words: int) -> Iterator[list[bytes]]:
    """Runs of 1 to most_words consecutive words of a UTF-8 text, repeats included, piece by piece."""
    tail: list[bytes] = []
    for piece in pieces(raw or b"", _GAP):
        words = _WORD.findall(piece.lower())
        both = tail + words
        out = list(words)
        for n in range(2, most_words + 1):
            first = max(0, len(tail) - n + 1)
            out += [b" ".join(both[i:i + n]) for i in range(first, len(both) - n + 1)]
        tail = both[len(both) - most_words + 1:] if most_words > 1 else []
        yield out


def bucket_counts(texts: DataFrame, buckets: int, most_words: int) -> np.ndarray:
    """Features of all texts by bucket. The only column is read; null has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros(buckets, np.int64), Counter()

        def settle() -> None:
            if seen:
                at = np.fromiter((zlib.crc32(f) % buckets for f in seen), np.int64, len(seen))
                np.add.at(sums, at, np.fromiter(seen.values(), np.int64, len(seen)))
                seen.clear()

        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()):
                for found in features(raw.as_py(), most_words):
                    seen.update(found)
                    if len(seen) > REMEMBERED:
                        settle()
        settle()
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at])], ["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:  # one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln) of the ratio of a bucket's smoothed shares in target and source."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return [math.floor(1000 * math.log(float((t + 1) * (s_all + k)) / float((s + 1) * (t_all + k))))
            for s, t in zip(source.tolist(), target.tolist())]


def noise(id_: object, seed: str) -> int:
    digest = hashlib.sha256(f"{seed}:{'null' if id_ is None else id_}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], most_words: int, seed: str, id_col: str, text_col: str) -> DataFrame:
    """id, n_features, weight, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value

        class Gains(dict):
            def __missing__(self, feature: bytes) -> int:
                value = self[feature] = gain[zlib.crc32(feature) % len(gain)]
                return value

        known = Gains()
        for batch in batches:
            counts, weights = [], []
            for raw in batch.column("text").cast(pa.binary()):
                n = weight = 0
                for found in features(raw.as_py(), most_words):
                    n += len(found)
                    weight += sum(map(known.__getitem__, found))
                    if len(known) > REMEMBERED:
                        known.clear()
                counts.append(n)
                weights.append(weight)
            scores = [w + noise(i, seed) for w, i in zip(weights, batch.column("id").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(weights, pa.int64()), pa.array(scores, pa.int64())],
                ["id", "n_features", "weight", "score"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(score, f"id {kind}, n_features long, weight long, score long")


# --- Sorting by regular sampling ------------------------------------------------------------

def top_ranks(rows: DataFrame, keys: list[str], n_rows: int, top: int) -> DataFrame:
    """rows with ``rank``: 1 to ``top`` in ascending order of the long columns ``keys``, else null.

    ``keys`` must be without nulls and differ from row to row; then no key, however often its first
    parts repeat, is too hot to split. Only segments that begin within the top are exchanged.
    """
    spark = rows.sparkSession
    # The run of each task, in order.
    runs = staged(rows.sortWithinPartitions(*keys), "runs")
    segments = min(MOST_SEGMENTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // SEGMENT_ROWS)))
    step = max(1, n_rows // SAMPLES)
    key_type = ", ".join(f"{k} long" for k in keys)

    def regular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            first = -seen % step
            seen += batch.num_rows
            if first < batch.num_rows:
                yield batch.take(pa.array(range(first, batch.num_rows, step)))

    sample = sorted(tuple(r) for r in runs.select(*keys).mapInArrow(regular, key_type).collect())
    splitters = [sample[len(sample) * s // segments] for s in range(1, segments)] if sample else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = zip(*(batch.column(k).to_pylist() for k in keys))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([bisect_left(splitters, key) for key in own], pa.int32())],
                [*batch.schema.names, "segment"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema)
    dealt = staged(runs.mapInArrow(place, f"{types}, segment int"), "segments")
    counts = {r["segment"]: r["n"] for r in dealt.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, before = {}, 0
    for s in range(segments):
        starts[s], before = before, before + counts.get(s, 0)
    begun = sum(1 for s in range(segments) if starts[s] < top)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, int] = {}
        for batch in batches:
            at = []
            for s in batch.column("segment").to_pylist():
                done[s] = done.get(s, starts[s]) + 1
                at.append(done[s] if done[s] <= top else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "rank"])

    inside = dealt.where(F.col("segment") < begun)
    if begun:
        inside = inside.repartitionById(begun, "segment").sortWithinPartitions("segment", *keys)
    merged = inside.mapInArrow(rank, f"{types}, segment int, rank long")
    rest = dealt.where(F.col("segment") >= begun).withColumn("rank", F.lit(None).cast("long"))
    return merged.unionByName(rest).drop("segment")


def resampled(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), buckets: int = 10_000,
              most_words: int = 1, least_features: int = 20, seed: str = "2024", id_col: str = "doc_id",
              text_col: str = "text", target_col: str = "text") -> DataFrame:
    """id, n_features, weight, score, rank of every row of docs.

    Drawn are floor(n * share) of the n rows with at least ``least_features`` words, those of the
    highest score, ties to the smaller id, a null id last, then as the rows lie. ``id_col`` is a
    whole number; a null id has the noise of ``null``. Null and empty texts have no features and weight 0; repeated rows are
    drawn each for itself; an empty target leaves all gains to the corpus; an empty corpus gives no
    row. Other columns are left alone. All of both tables are counted.
    """
    source = bucket_counts(docs.select(F.col(text_col).cast("string")), buckets, most_words)
    wanted = bucket_counts(target.select(F.col(target_col).cast("string")), buckets, most_words)
    rows = scored(docs.withColumn(id_col, F.col(id_col).cast("long")), gains(source, wanted), most_words, seed, id_col, text_col)
    # Keys in ascending order; the number a row is written with tells equal rows apart.
    rows = rows.withColumns({
        "__score": -F.col("score"), "__id": F.coalesce("id", F.lit(LARGEST)), "__null": F.col("id").isNull().cast("long"),
        "__row": F.monotonically_increasing_id(), "__words": _words_at_least(least_features, most_words)})
    rows = staged(rows, "scored")
    n = rows.where("__words").count()
    ranked = top_ranks(rows.where("__words").drop("__words"), ["__score", "__id", "__null", "__row"], n,
                       n * share[0] // share[1])
    few = rows.where("NOT __words").drop("__words").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(few).select("id", "n_features", "weight", "score", "rank")


def _words_at_least(words: int, most_words: int):
    """Whether a text of n_features features has so many words; the count grows with the words."""
    return F.col("n_features") >= sum(max(0, words - n + 1) for n in range(1, most_words + 1))
