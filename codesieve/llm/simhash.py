"""SimHash near duplicates over a byte-position inverted index with count filtering.

A fingerprint has 8 bytes. Two fingerprints that differ in at most 4 bits agree in at least 4 byte
positions, the guaranteed minimum. The index therefore has a posting list for every choice of 4
positions and their bytes; fingerprints that meet in a list have reached that tally, and their bits
are compared. A list that many distinct fingerprints share is split by the same index over the 8
nibbles of its 4 open bytes, which leaves lists of at most 2^16 entries, and those are linked
through a table of all 16-bit values: work grows with the entries, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import staged
from codesieve.llm.components import connected_components

SEED = 42
DISTANCE = 4
SHINGLE = 4
PAIRWISE = 1024
CHUNK = 1 << 16

QUADS = list(combinations(range(8), 4))
#: 16-bit masks of at most two bits: two values within four bits share a value within two of both.
HALF = np.array([0] + [1 << a for a in range(16)] + [1 << a | 1 << b for a, b in combinations(range(16), 2)], np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash, signed, of UTF-8 text; words between ASCII white space, A-Z lower-cased.

    Fewer words than a shingle make one shingle; no words, as in null text, make 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    last = min(shingle, len(words)) - 1
    starts = [0, *(e + 1 for e in ends[:len(ends) - last - 1])]
    digest = xxhash.xxh64_intdigest
    count, total = np.zeros(64, np.int64), len(starts)
    for at in range(0, total, CHUNK):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(
            starts[at:at + CHUNK], ends[at + last:at + last + CHUNK])), np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) for every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = pa.array((fingerprint(t.as_py(), shingle) for t in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["id", "fp"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(compute, f"id {slim.schema['id'].dataType.simpleString()}, fp long")


# --- the index -------------------------------------------------------------------------

def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(quad, bytes, fp): each fingerprint under every choice of four positions."""
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        by = fps.view(np.uint8).reshape(-1, 8)
        for number, quad in enumerate(QUADS):
            four = np.ascontiguousarray(by[:, quad]).view(np.uint32)[:, 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array((np.int64(number) << 32) | four.astype(np.int64)), pa.array(fps)], ["key", "fp"])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # Unsigned: of a negative number the bits of its absolute value would be counted.
    return np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE


def _close(values: np.ndarray) -> np.ndarray:
    """Pairwise: the least index each value reaches over steps of at most DISTANCE bits."""
    near = _near(values[:, None], values[None, :])
    label = np.full(len(values), -1)
    for i in range(len(values)):
        if label[i] < 0:
            label[i], front = i, [i]
            while len(front):
                front = np.flatnonzero(near[front].any(0) & (label < 0))
                label[front] = i
    return label


def _close16(values: np.ndarray) -> np.ndarray:
    """The same for distinct 16-bit values, over a table of them all."""
    index, far = np.arange(len(values)), len(values)
    label = index.copy()
    while True:
        low = np.full(1 << 16, far)
        for mask in HALF:
            np.minimum.at(low, values ^ mask, label)
        new = np.min([low[values ^ mask] for mask in HALF], axis=0)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(fps: np.ndarray, quad: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fingerprints, roots) for the distinct fingerprints of one posting list."""
    if len(fps) <= PAIRWISE:
        yield fps, fps[_close(fps)]
        return
    open_bytes = [b for b in range(8) if b not in QUADS[quad]]
    rest = np.ascontiguousarray(fps.view(np.uint8).reshape(-1, 8)[:, open_bytes]).view(np.uint32)[:, 0].astype(np.int64)
    nibbles = [(rest >> (4 * n)) & 15 for n in range(8)]
    for four in QUADS:
        key = sum(nibbles[n] << (4 * i) for i, n in enumerate(four))
        free = sum(nibbles[n] << (4 * i) for i, n in enumerate(n for n in range(8) if n not in four))
        order = np.argsort(key, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(part) > 1:
                label = _close(free[part]) if len(part) <= PAIRWISE else _close16(free[part])
                yield fps[part], fps[part][label]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each posting list of rows sorted by (key, fp); a list may span batches."""
    held_key, held = None, []

    def made(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        other = u != v
        if other.any():
            yield pa.RecordBatch.from_arrays([pa.array(u[other]), pa.array(v[other])], ["u", "v"])

    def closed() -> Iterator[pa.RecordBatch]:
        fps = np.concatenate(held)
        if len(fps) > 1:
            for u, v in _linked(fps, int(held_key) >> 32):
                yield from made(u, v)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        fps = batch.column(1).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        if held_key is not None and keys[0] != held_key:
            yield from closed()
            held = []
        last = cuts[-2]
        if last:  # all but the last list end in this batch
            if held:
                held.append(fps[:cuts[1]])
                yield from closed()
                held, cuts = [], cuts[1:]
            sizes = np.diff(cuts[:-1])
            two = cuts[:-2][sizes == 2]
            near = two[_near(fps[two], fps[two + 1])]
            yield from made(fps[near + 1], fps[near])
            for at in np.flatnonzero(sizes > 2):
                own = fps[cuts[at]:cuts[at + 1]]
                for u, v in _linked(own, int(keys[cuts[at]]) >> 32):
                    yield from made(u, v)
        held_key = keys[-1]
        held.append(fps[last:].copy())
    if held:
        yield from closed()


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(u, v) pairs that join all distinct fingerprints (column fp) within DISTANCE bits of each other.

    Not every pair of a list is listed, but every pair within the distance is joined by a path.
    """
    index = fps.mapInArrow(_postings, "key long, fp long")
    return index.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the least id reachable by links.

    Null and blank texts have fingerprint 0 and are linked like any other. Equal fingerprints are
    one entry of the index, however many rows share them. Repeated rows get the same answer; a null
    id is never the least one unless the component has no other. Other columns are not read. An
    empty table gives an empty result.
    """
    marked = staged(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = staged(marked.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    roots = connected_components(fingerprint_links(distinct.select("fp")))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("id", "fp", "component_id")


def fingerprint_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
