"""Benchmark passages in training text, over a distributed positional inverted index.

The index is a table of segments, written once for a corpus and searched by any number of test sets.
A segment belongs to a run of documents and holds, for each of their words, the ascending positions
of its occurrences. A search takes each window of test words, starts from the list of its rarest
term in the segment and intersects it with the lists of the other terms, shifted by their offsets,
rarest first; all windows go through a step together. Segments are searched where they lie; nothing
of a document is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import staged

WINDOW = 10
#: Bytes of test text that one search may hold on every executor; a larger test set goes in parts.
#: A window of ten words takes 40 bytes, so a part is 0.1 to 0.4 GB.
MOST_TEST_BYTES = 16 << 20
#: Words of a segment, but for the last document's.
SEGMENT_WORDS = 1 << 22
#: Windows looked up, and starts held, at a time.
BLOCK_WINDOWS, BLOCK_STARTS = 1 << 15, 1 << 20

#: A-Z become a-z, other ASCII that is neither letter nor digit becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all non-ASCII characters of UTF-8 text."""
    return (text or b"").translate(_FOLD).split()


@dataclass(frozen=True)
class TestSet:
    """terms: number of each word. windows: by length, one row of term numbers per distinct window.
    items: by length, the item numbers of all windows and where each window's begin. names: of items."""

    terms: dict[bytes, int]
    windows: dict[int, np.ndarray]
    items: dict[int, tuple[np.ndarray, np.ndarray]]
    names: list[str]

    @classmethod
    def of(cls, rows, window: int = WINDOW) -> TestSet:
        """From (item, text) pairs. An item shorter than a window is one window; without words none."""
        terms: dict[bytes, int] = {}
        names: dict[str, int] = {}
        shown, whose = defaultdict(list), defaultdict(list)
        for item, text in rows:
            own = np.array([terms.setdefault(w, len(terms)) for w in words_of(text.encode() if text is not None else None)], np.int32)
            if len(own):
                n = min(window, len(own))
                shown[n].append(sliding_window_view(own, n))
                whose[n].append(np.full(len(own) - n + 1, names.setdefault(str(item), len(names))))
        windows, items = {}, {}
        for n in sorted(shown):
            windows[n], at = np.unique(np.concatenate(shown[n]), axis=0, return_inverse=True)
            pairs = np.unique(at.ravel() * len(names) + np.concatenate(whose[n]))
            items[n] = pairs % len(names), np.searchsorted(pairs // len(names), np.arange(len(windows[n]) + 1))
        return cls(terms, windows, items, list(names))

    def names_of(self, n: int, window: int) -> list[str]:
        numbers, starts = self.items[n]
        return [self.names[i] for i in numbers[starts[window]:starts[window + 1]]]


# --- index -----------------------------------------------------------------------------

SEGMENT = "ids array<{0}>, n_words array<long>, terms array<binary>, counts binary, positions binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of docs, written to the shared folder.

    Positions run through all documents of a segment, one number apart between two documents, so
    consecutive positions never cross a document. Every document is in one segment, also without
    words or with null text.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def new_numbers() -> defaultdict[bytes, int]:
        """Numbers words in the order they come."""
        return defaultdict(count().__next__)

    def segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, start, found, gaps, lengths, numbers = 0, 0, [], [], [], new_numbers()
            for k, text in enumerate(batch.column(1).cast(pa.binary())):
                words = words_of(text.as_py())
                found.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                gaps.append(np.arange(start, start + len(words), dtype=np.int32))
                lengths.append(len(words))
                start += len(words) + 1
                if start < most and k + 1 < batch.num_rows:
                    continue
                own, at = np.concatenate(found), np.concatenate(gaps)
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0).slice(first, k + 1 - first).to_pylist()], pa.list_(batch.column(0).type)),
                    pa.array([lengths], pa.list_(pa.int64())), pa.array([list(numbers)], pa.list_(pa.binary())),
                    pa.array([np.bincount(own, minlength=len(numbers)).astype(np.int32).tobytes()], pa.binary()),
                    pa.array([at[np.argsort(own, kind="stable")].tobytes()], pa.binary()),
                ], ["ids", "n_words", "terms", "counts", "positions"])
                first, start, found, gaps, lengths, numbers = k + 1, 0, [], [], [], new_numbers()

    most = SEGMENT_WORDS
    return staged(slim.mapInArrow(lambda batches: segments(batches, most),
                                  SEGMENT.format(slim.schema["id"].dataType.simpleString())), "postings")


class Postings:
    """The lists of a segment, and the numbers the terms of a test set have in it (-1 for none)."""

    def __init__(self, row: dict, terms: dict[bytes, int]):
        self.positions = np.frombuffer(row["positions"], np.int32).astype(np.int64)
        counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        #: Term number and position in one ascending key.
        self.keys = (np.repeat(np.arange(len(counts)), counts) << 32) + self.positions
        self.starts = np.cumsum(counts) - counts
        self.size = np.append(counts, 0)
        self.number = np.full(len(terms), -1)
        for own, word in enumerate(row["terms"]):
            if (wanted := terms.get(word)) is not None:
                self.number[wanted] = own
        self.begin = np.concatenate([[0], np.cumsum(np.array(row["n_words"], np.int64) + 1)])

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, places, "right") - 1

    def rarest(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(window numbers, their terms and offsets from the rarest on, window row and start per
        occurrence of its rarest term), a bounded number of occurrences at a time."""
        for first in range(0, len(windows), BLOCK_WINDOWS):
            terms = self.number[windows[first:first + BLOCK_WINDOWS]]
            # A window can only be here if all its terms are.
            here = np.flatnonzero(terms.min(1) >= 0)
            order = np.argsort(self.size[terms[here]], axis=1, kind="stable")
            terms = np.take_along_axis(terms[here], order, 1)
            length = self.size[terms[:, 0]]
            upto = np.cumsum(length)
            cuts = np.flatnonzero(np.diff((upto - length) // BLOCK_STARTS)) + 1
            for part in np.split(np.arange(len(here)), cuts):
                if len(part):
                    row, n = np.repeat(part, length[part]), length[part]
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.starts[terms[row, 0]]
                    yield first + here, terms, order, row, self.positions[at] - order[row, 0]

    def phrases(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Window numbers and the positions they start at."""
        for number, terms, order, row, start in self.rarest(windows):
            for k in range(1, windows.shape[1]):
                want = (terms[row, k] << 32) + start + order[row, k]
                at = np.searchsorted(self.keys, want)
                same = self.keys[np.minimum(at, len(self.keys) - 1)] == want
                row, start = row[same], start[same]
            yield number[row], start

    def near(self, windows: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Window numbers and the documents with a near match: some start of which each term has an
        occurrence in the document within ``slop`` words of where the window would have it.

        Occurrences of the rarest term propose the starts; the other terms look up their nearest
        occurrence between the document's ends. Which term is rarest does not change the result.
        """
        for number, terms, order, row, start in self.rarest(windows):
            doc = np.repeat(self.doc_of(start + order[row, 0]), 2 * slop + 1)
            start = (start[:, None] + np.arange(-slop, slop + 1)).ravel()
            row = np.repeat(row, 2 * slop + 1)
            for k in range(1, windows.shape[1]):
                base, want = terms[row, k] << 32, start + order[row, k]
                low, high = self.begin[doc], self.begin[doc + 1] - 1
                right = np.searchsorted(self.keys, base + np.clip(want, low, high))
                close = np.zeros(len(row), bool)
                for place in (right - 1, right):
                    at = self.keys[np.clip(place, 0, len(self.keys) - 1)] - base
                    close |= (at >= low) & (at < high) & (abs(at - want) <= slop)
                row, start, doc = row[close], start[close], doc[close]
            yield number[row], doc


MATCHES = ("id {0}, n_words long, spans array<struct<first:long,last:long>>, items array<string>, "
           "near_items array<string>")


def search(index: DataFrame, tests: TestSet, slop: int | None = None) -> DataFrame:
    """One row per document: spans of words (first to last) inside exact matches, disjoint and in
    order; the items that match exactly; with ``slop``, the items with a near match in the document,
    exact ones included."""
    sent = index.sparkSession.sparkContext.broadcast(tests)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                postings = Postings(row, own.terms)
                n_words, begin = row["n_words"], postings.begin
                depth = np.zeros(begin[-1] + 1, np.int32)
                items, close = defaultdict(set), defaultdict(set)
                for n, windows in own.windows.items():
                    for window, at in postings.phrases(windows):
                        np.add.at(depth, at, 1)
                        np.add.at(depth, at + n, -1)
                        for w, d in np.unique(np.stack([window, postings.doc_of(at)]), axis=1).T:
                            items[d].update(own.names_of(n, w))
                    for window, doc in postings.near(windows, slop) if slop is not None else ():
                        for w, d in np.unique(np.stack([window, doc]), axis=1).T:
                            close[d].update(own.names_of(n, w))
                edge = np.diff((np.cumsum(depth) > 0).astype(np.int8), prepend=0)
                first, last = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) - 1
                doc = np.searchsorted(begin, first, "right") - 1
                spans = defaultdict(list)
                for d, a, b in zip(doc, first - begin[doc], last - begin[doc]):
                    spans[d].append({"first": int(a), "last": int(b)})
                docs = range(len(n_words))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], batch.schema.field("ids").type.value_type), pa.array(n_words),
                    pa.array([spans[d] for d in docs], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                    pa.array([sorted(items[d]) for d in docs], pa.list_(pa.string())),
                    pa.array([sorted(close[d]) for d in docs], pa.list_(pa.string())),
                ], ["id", "n_words", "spans", "items", "near_items"])

    kind = index.schema["ids"].dataType.elementType.simpleString()
    return index.mapInArrow(look, MATCHES.format(kind))


def _joined_spans(spans):
    out = []
    for first, last in sorted((s["first"], s["last"]) for part in spans for s in part):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def contamination(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  slop: int | None = None) -> DataFrame:
    """(id, n_words, n_hit, spans, items, near_items), one row per row of docs.

    Null and empty texts have no words and no hits; a test item without words matches nothing.
    Repeated rows and rows without an id each get their row. Items come as strings in code-point
    order, a null item as ``None``. Other columns are not read.
    """
    tests = tests.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // MOST_TEST_BYTES) or 1
    if parts > 1:
        # The parts meet by a number each row is written with, as ids may repeat or be null.
        docs = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id")).alias("id"),
                           F.col(text_col).alias("text"))
        id_col, text_col = "id", "text"
    index = build_index(docs, id_col, text_col)
    found = []
    for part in range(parts):
        own = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        found.append(search(index, TestSet.of(own.toLocalIterator(), window), slop))
    rows = found[0]
    if parts > 1:
        for other in found[1:]:
            rows = rows.unionByName(other)
        joined = F.udf(_joined_spans, "array<struct<first:long,last:long>>")
        rows = rows.groupBy(F.col("id.row").alias("row")).agg(
            F.first("id.id").alias("id"), F.first("n_words").alias("n_words"),
            joined(F.collect_list("spans")).alias("spans"),
            *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return rows.withColumn("n_hit", hit).select("id", "n_words", "n_hit", "spans", "items", "near_items")
