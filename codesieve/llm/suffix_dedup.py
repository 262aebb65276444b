"""Repeated byte strings, by hashes of strings around sampled anchors, in place of prefix doubling.

The rank of a position at a length is a 64-bit hash of its string, composed by doubling inside a task;
equal strings share it. No rank pairs are sorted across the corpus. There positions are compared twice:

1. Every LENGTH-byte string has one anchor, the position in it of least rank at SHORT (the first of
   equals). Equal strings have the same anchor, so only anchors stand for positions here, about
   one in 16. Spark brings equal ranks together; an anchor of a rank that is unique leaves.
2. Spark brings the runs of strings around the anchors that stay together by class of their anchor's
   rank; a task ranks them at LENGTH, sorts by rank and document, and marks every position whose
   string starts in an earlier document. Bytes are compared behind every equal rank.

Both times a task first settles what repeats inside its own block of documents and sends one
position for it, so that a passage all documents share is one row per block. Equal strings of rows
of one id stand behind one of them as offsets and share its fate. A rank class too large for a task
is dealt out again by the rank of each whole string, once per string and block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import new_folder, staged

LENGTH = 50
SHORT = 20
BLOCK_BYTES = 4 << 20
#: Text behind one rank bucket of the first exchange; the second uses four times as many buckets.
BUCKET_BYTES = 32 << 20
CHUNK = 1 << 18
#: A rank class of more bytes than this is split by the strings in it.
MOST_CLASS_BYTES = 16 << 20
#: Strings compared at a time behind equal ranks.
VERIFY = 1 << 16

#: In place of a class: positions that are marked, and positions that share the fate of others, runs
#: and single strings.
MARKS, RUNS, STRINGS = -1, -2, -3

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit names of all strings of ``length`` bytes, by doubling; equal strings share a name."""
    name = (data.astype(np.uint64) + np.uint64(1)) * _A
    have = 1
    while have < length:
        step = min(have, length - have)
        name ^= name >> np.uint64(32)
        name = name[:-step] * _A + name[step:] * _B
        have += step
    return name ^ (name >> np.uint64(29))


def anchors(data: np.ndarray, length: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each position at ``short``, and for each string of ``length`` bytes its anchor, the
    first position of least rank in it."""
    rank = ranks(data, short)
    least, have, width = rank, 1, length - short + 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    # A string that starts at its anchor is settled, and one whose least rank the next string no
    # longer has is looked at; any other has the anchor of the next string.
    n = len(least)
    own = rank[:n] == least
    ends = np.append(least[1:] != least[:-1], True) & ~own
    anchor = np.arange(n)
    last = np.flatnonzero(ends)
    anchor[last] += np.lib.stride_tricks.sliding_window_view(rank, width)[last].argmin(1)
    at = np.where(own | ends, np.arange(n), n)
    return rank, anchor[np.minimum.accumulate(at[::-1])[::-1]]


def _strings(text: np.ndarray, ends: np.ndarray, length: int, short: int) -> tuple[np.ndarray, ...]:
    """(document, first start, end of starts, rank) of the runs of strings that share an anchor.

    Documents lie end to end; strings that cross an end are left out. Long blocks go in chunks, and
    a run cut by a chunk gives two.
    """
    begin = np.concatenate([[0], ends[:-1]])
    doc_of = np.repeat(np.arange(len(ends), dtype=np.int32), ends - begin)
    parts = [(np.empty(0, np.int64),) * 3]
    ranks_of = [np.empty(0, np.uint64)]
    for at in range(0, len(text) - length + 1, CHUNK):
        rank, anchor = anchors(text[at:at + CHUNK + length - 1], length, short)
        doc = doc_of[at:at + len(anchor)]
        whole = np.flatnonzero(doc == doc_of[at + length - 1:at + length - 1 + len(anchor)])
        if not len(whole):
            continue
        kept = anchor[whole]
        new = np.append(True, (kept[1:] != kept[:-1]) | (whole[1:] != whole[:-1] + 1))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(whole)) - 1
        parts.append((doc[whole[first]].astype(np.int64), at + whole[first], at + whole[last] + 1))
        ranks_of.append(rank[kept[first]])
    return (*(np.concatenate(c) for c in zip(*parts)), np.concatenate(ranks_of))


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(zstandard.decompress(row["text"]), np.uint8), np.array(row["ends"], np.int64))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, ids, ends, text): documents end to end, up to BLOCK_BYTES or one document."""
    number = TaskContext.get().partitionId() << 32
    packer = zstandard.ZstdCompressor(3)

    def made(ids, texts):
        return pa.RecordBatch.from_arrays([
            pa.array([number]), pa.array([ids], pa.list_(kind)),
            pa.array([np.cumsum([len(t) for t in texts])], pa.list_(pa.int64())),
            pa.array([packer.compress(b"".join(texts))]),
        ], ["block", "ids", "ends", "text"])

    ids, texts, size = [], [], 0
    for batch in batches:
        kind = batch.column(0).type
        for id_, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
            text = text.as_py() or b""
            if texts and size + len(text) > BLOCK_BYTES:
                yield made(ids, texts)
                ids, texts, size, number = [], [], 0, number + 1
            ids.append(id_.as_py())
            texts.append(text)
            size += len(text)
    if texts:
        yield made(ids, texts)


def _save_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks as a table bucketed by block, so that what comes back to them moves and they do not."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    rows = slim.mapInArrow(_blocks, f"block long, ids array<{kind}>, ends array<long>, text binary")
    name = f"suffix_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "block").option("path", new_folder(spark, "blocks")).saveAsTable(name)
    return spark.table(name)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH, short: int = SHORT) -> DataFrame:
    """(id, n_bytes, spans, kept) for every row.

    spans are the maximal runs (first, end) of bytes covered by a string of ``length`` bytes that
    also starts in a row with a smaller id, judged on the input; kept is the text without them, as
    bytes. Null text is empty. Rows of equal id are no smaller than each other, so repeated rows
    lose nothing to each other; a null id is greater than all. Texts under ``length`` bytes lose
    nothing. Other columns are not read. An empty table gives an empty result.
    """
    blocks = _save_blocks(docs, id_col, text_col)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    total = blocks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    buckets = np.uint64(max(1, -(-total // BUCKET_BYTES)))

    # 1. Ranks of anchors, once per block; those found in two blocks come back.
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rank = np.unique(_strings(*_unpacked(row), length, short)[3])
                own = rank % buckets
                order = np.argsort(own, kind="stable")
                cuts = np.searchsorted(own[order], np.arange(int(buckets) + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(full, pa.int32()), pa.array([row["block"]] * len(full), pa.int64()),
                    # 32 bits beside the bucket: a chance meeting only keeps an anchor for step 2.
                    pa.array([(rank[order[cuts[b]:cuts[b + 1]]] >> np.uint64(32)).astype(np.uint32).tobytes()
                              for b in full], pa.binary()),
                ], ["bucket", "block", "rank"])

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(r, np.uint32) for r in pdf["rank"]]
        row = np.repeat(np.arange(len(own)), [len(r) for r in own])
        rank = np.concatenate(own)
        order = np.argsort(rank, kind="stable")
        same = np.diff(rank[order]) == 0
        keep = order[np.append(same, False) | np.insert(same, 0, False)]
        keep = keep[np.argsort(row[keep], kind="stable")]
        rows, cuts = np.unique(row[keep], return_index=True)
        return pd.DataFrame({"block": pdf["block"].to_numpy()[rows], "bucket": pdf["bucket"].iloc[0],
                             "rank": [r.tobytes() for r in np.split(rank[keep], cuts[1:])] if len(rows) else []})

    alive = blocks.mapInArrow(sampled, "bucket int, block long, rank binary").groupBy("bucket").applyInPandas(
        shared, "block long, bucket int, rank binary")
    alive = alive.groupBy("block").agg(F.collect_list(F.struct("bucket", "rank")).alias("alive"))
    alive = staged(alive, "suffix-alive")
    candidates = blocks.join(alive.hint("shuffle_hash"), "block")

    def kept_strings(row: dict):
        """Runs of strings of the block whose anchor rank repeats, and for each its equal of least id."""
        text, ends = _unpacked(row)
        doc, first, last, rank = _strings(text, ends, length, short)
        low = (rank % buckets) << np.uint64(32) | rank >> np.uint64(32)
        held = [np.uint64(c["bucket"]) << np.uint64(32) | np.frombuffer(c["rank"], np.uint32).astype(np.uint64)
                for c in row["alive"] or []]
        by = np.argsort(low, kind="stable")
        same = np.diff(low[by]) == 0
        keep = np.zeros(len(low), bool)
        keep[by] = np.append(same, False) | np.insert(same, 0, False) if len(low) else False
        if held:
            keep |= np.isin(low, np.concatenate(held))
        doc, first, last, rank = (x[keep] for x in (doc, first, last, rank))
        order = _order(row["ids"])[doc]
        # Equal runs of this block are settled by the first of the least id, which speaks for all.
        runs, head = {}, np.arange(len(doc))
        raw = text.tobytes()
        for k in np.argsort(order, kind="stable"):
            head[k] = runs.setdefault(raw[first[k]:last[k] + length - 1], k)
        return text, doc, first, last, rank, order, head

    # 2. Runs of strings around the anchors that stay, by rank class.
    classes = buckets * np.uint64(4)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_kind = batch.schema.field("ids").type
            for row in batch.to_pylist():
                text, doc, first, last, rank, order, head = kept_strings(row)
                settled, stays = order[head] < order, head == np.arange(len(head))
                if settled.any():
                    yield _made(id_kind, MARKS, row["block"], first[settled], last[settled])
                follows = ~settled & ~stays
                if follows.any():
                    yield _made(id_kind, RUNS, row["block"], first[follows], last[follows], of=first[head[follows]])
                at = np.flatnonzero(stays)
                own = (rank[at] >> np.uint64(8)) % classes
                order = np.argsort(own, kind="stable")
                groups, cuts = np.unique(own[order], return_index=True)
                for group, part in zip(groups, np.split(at[order], cuts[1:]) if len(at) else []):
                    raw = b"".join(text[first[k]:last[k] + length - 1].tobytes() for k in part)
                    yield _made(id_kind, int(group), row["block"], first[part], last[part],
                                [row["ids"][d] for d in doc[part]], raw)

    kinds = (f"class long, block long, ids array<{kind}>, first binary, last binary, text binary, of binary, "
             "bytes long, strings long")
    sent = staged(candidates.mapInArrow(around, kinds), "suffix-runs")
    in_class = F.col("class") >= 0
    sizes = sent.where(in_class).groupBy("class").agg(F.sum("bytes").alias("bytes"), F.sum("strings").alias("strings"))
    hot, following = {}, int(classes)
    for r in sizes.where(F.col("bytes") > MOST_CLASS_BYTES).orderBy("class").collect():
        hot[r["class"]] = following, -(-r["strings"] * length // MOST_CLASS_BYTES)
        following += hot[r["class"]][1]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_kind = batch.schema.field("ids").type
            for row in batch.to_pylist():
                base, parts = hot[row["class"]]
                first, last = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("first", "last"))
                run, start, place, flat, name = _expanded(first, last, zstandard.decompress(row["text"]), length)
                order = _order(row["ids"])[run]
                head = _heads(name, order, flat, place, length)
                settled, stays = order > order[head], head == np.arange(len(head))
                if settled.any():
                    _, firsts, lasts = _runs(np.zeros(settled.sum(), np.int64), start[settled])
                    yield _made(id_kind, MARKS, row["block"], *(np.frombuffer(x[0], np.int32) for x in (firsts, lasts)))
                follows = np.flatnonzero(~settled & ~stays)
                if len(follows):
                    follows = follows[np.argsort(start[follows])]
                    yield _made(id_kind, STRINGS, row["block"], start[follows], start[follows] + 1, of=start[head[follows]])
                at = np.flatnonzero(stays)
                own = (name[at] >> np.uint64(8)) % np.uint64(parts)
                by = np.argsort(own, kind="stable")
                groups, cuts = np.unique(own[by], return_index=True)
                strings = np.lib.stride_tricks.sliding_window_view(flat, length)
                for group, part in zip(groups, np.split(at[by], cuts[1:])):
                    yield _made(id_kind, base + int(group), row["block"], start[part], start[part] + 1,
                                [row["ids"][k] for k in run[part]], strings[place[part]].tobytes())

    def marked(pdf: pd.DataFrame) -> pd.DataFrame:
        first = [np.frombuffer(f, np.int32) for f in pdf["first"]]
        row = np.repeat(np.arange(len(first)), [len(f) for f in first])
        last = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["last"]])
        raw = b"".join(zstandard.decompress(t) for t in pdf["text"])
        run, start, place, flat, name = _expanded(np.concatenate(first).astype(np.int64), last, raw, length)
        order = _order([i for ids in pdf["ids"] for i in ids]).astype(np.int32)[run]
        hit = order > order[_heads(name, order, flat, place, length)]
        blocks, firsts, lasts = _runs(row[run[hit]], start[hit])
        return pd.DataFrame({"block": pdf["block"].to_numpy()[blocks], "first": firsts, "last": lasts})

    held, known = sent.where(in_class), sent.where(~in_class)
    if hot:
        is_hot = F.col("class").isin(list(hot))
        dealt = staged(held.where(is_hot).mapInArrow(spread, kinds), "suffix-strings")
        held, known = held.where(~is_hot).unionByName(dealt.where(in_class)), known.unionByName(dealt.where(~in_class))
    hits = held.groupBy("class").applyInPandas(marked, "block long, first binary, last binary").withColumns(
        {"class": F.lit(MARKS).cast("long"), "of": F.lit(None).cast("binary")})
    hits = hits.unionByName(known.select("block", "first", "last", "class", "of"))
    hits = staged(hits.groupBy("block").agg(F.collect_list(F.struct("class", "first", "last", "of")).alias("hits")), "suffix-hits")

    # 3. Marks back at their blocks.
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text, ends = _unpacked(row)
                begins = _starts(len(text), row["hits"] or [])
                edge = np.diff(begins.astype(np.int8), prepend=np.int8(0))
                depth = np.zeros(len(text) + 1, np.int32)
                depth[np.flatnonzero(edge > 0)] += 1
                depth[np.flatnonzero(edge < 0) + (length - 1)] -= 1
                gone = np.cumsum(depth[:-1]) > 0
                out, begin = [], 0
                for end in ends:
                    own = gone[begin:end]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                    out.append((len(own), [{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])],
                                text[begin:end][~own].tobytes()))
                    begin = end
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], batch.schema.field("ids").type.value_type),
                    pa.array([o[0] for o in out], pa.int64()),
                    pa.array([o[1] for o in out], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                    pa.array([o[2] for o in out], pa.binary()),
                ], ["id", "n_bytes", "spans", "kept"])

    done = blocks.join(hits.hint("shuffle_hash"), "block", "left")
    return done.mapInArrow(cut, f"id {kind}, n_bytes long, spans array<struct<first:long,end:long>>, kept binary")


def _made(id_kind, group: int, block: int, first: np.ndarray, last: np.ndarray, ids=(), raw: bytes = b"",
          of: np.ndarray | None = None) -> pa.RecordBatch:
    """A row of runs: their class, block, ids, starts, ends of starts and bytes. Runs that share the
    fate of others have the starts of these in ``of``, and lie packed."""
    pack = zstandard.ZstdCompressor(3).compress
    strings = int((last - first).sum())
    first, last = (_packed(x) if of is not None else x.astype(np.int32).tobytes() for x in (first, last))
    return pa.RecordBatch.from_arrays([
        pa.array([group], pa.int64()), pa.array([block], pa.int64()), pa.array([list(ids)], id_kind),
        pa.array([first]), pa.array([last]), pa.array([pack(raw)]),
        pa.array([None if of is None else _packed(of)], pa.binary()), pa.array([len(raw)], pa.int64()),
        pa.array([strings], pa.int64()),
    ], ["class", "block", "ids", "first", "last", "text", "of", "bytes", "strings"])


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(3).compress(np.diff(numbers, prepend=0).astype(np.int32).tobytes())


def _unfolded(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(packed), np.int32), dtype=np.int64)


def _starts(size: int, hits: list[dict]) -> np.ndarray:
    """Whether a marked string starts at each position of a block, and at the one after it."""
    edge = np.zeros(size + 1, np.int32)
    for hit in hits:
        if hit["class"] == MARKS:
            np.add.at(edge, np.frombuffer(hit["first"], np.int32), 1)
            np.subtract.at(edge, np.frombuffer(hit["last"], np.int32), 1)
    begins = np.cumsum(edge) > 0
    # Strings first: a run may follow one whose strings follow others.
    for kind in (STRINGS, RUNS):
        for hit in hits:
            if hit["class"] == kind:
                first, last, of = (_unfolded(hit[c]) for c in ("first", "last", "of"))
                count = last - first
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                begins[np.repeat(first, count) + step] |= begins[np.repeat(of, count) + step]
    return begins


def _expanded(first: np.ndarray, last: np.ndarray, raw: bytes, length: int) -> tuple[np.ndarray, ...]:
    """For each string of the runs its run, start, place in the bytes, these bytes, and its rank."""
    count = last - first
    flat = np.frombuffer(raw, np.uint8)
    begin = np.concatenate([[0], np.cumsum(count + length - 1)[:-1]])
    run = np.repeat(np.arange(len(count), dtype=np.int32), count)
    step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    names = [ranks(flat[at:at + CHUNK + length - 1], length) for at in range(0, len(flat) - length + 1, CHUNK)]
    place = begin[run] + step
    return run, first[run] + step, place, flat, np.concatenate(names)[place]


def _heads(name: np.ndarray, order: np.ndarray, flat: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """For each string the first of least order among its equals."""
    by = np.lexsort((order, name))
    new = np.append(True, np.diff(name[by]) != 0)[:len(by)]
    head = np.empty(len(by), np.int64)
    head[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    strings, clashed = np.lib.stride_tricks.sliding_window_view(flat, length), []
    for at in range(0, len(by), VERIFY):
        part = slice(at, at + VERIFY)
        clashed.append(name[part][(strings[place[part]] != strings[place[head[part]]]).any(axis=1)])
    clashed = np.unique(np.concatenate(clashed)) if clashed else name[:0]
    if len(clashed):
        # Strings of a rank that others share are told apart by their bytes.
        first: dict[bytes, int] = {}
        for k in by[np.isin(name[by], clashed)]:
            head[k] = first.setdefault(strings[place[k]].tobytes(), k)
    return head


def _order(ids: list) -> np.ndarray:
    """Rank of each id among them; null last."""
    codes, values = pd.factorize(pd.Series(ids, dtype=object), sort=True)
    return np.where(codes < 0, len(values), codes)


def _runs(owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """Owners, and the first and end of each run of consecutive starts of an owner, as bytes."""
    by = np.lexsort((start, owner))
    owner, start = owner[by], start[by]
    new = np.append(True, (np.diff(owner) != 0) | (np.diff(start) > 1))[:len(owner)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner))[:len(first)] - 1
    owners, cuts = np.unique(owner[first], return_index=True)
    split = lambda x: [part.astype(np.int32).tobytes() for part in np.split(x, cuts[1:])] if len(owners) else []
    return owners, split(start[first]), split(start[last] + 1)
