import hashlib
import random

import numpy as np
import pytest

from codesieve.llm import suffix_dedup
from codesieve.llm.queries import LLM_QUERIES
from llm.conftest import ODD, SF


def plain(rows, length=50):
    """By a dictionary of all strings: [(id, n_bytes, [(first, end)], kept)]."""
    least = {}
    rank = lambda i: float("inf") if i is None else i
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for at in range(len(b) - length + 1):
            s = b[at:at + length]
            least[s] = min(least.get(s, rank(i)), rank(i))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for at in range(len(b) - length + 1):
            if least[b[at:at + length]] < rank(i):
                gone[at:at + length] = [True] * length
        spans = []
        for at, g in enumerate(gone):
            if g and at and gone[at - 1]:
                spans[-1] = (spans[-1][0], at + 1)
            elif g:
                spans.append((at, at + 1))
        out.append((i, len(b), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def test_anchors():
    """The first position of least rank of every string, in random and periodic bytes."""
    rng = np.random.default_rng(5)
    for data in (rng.integers(0, 256, 400), rng.integers(0, 2, 400), np.zeros(300), np.tile([1, 2, 3], 100), np.repeat([7, 8], 90)):
        rank, anchor = suffix_dedup.anchors(data.astype(np.uint8), 50, 20)
        assert [i + int(np.argmin(rank[i:i + 31])) for i in range(len(anchor))] == anchor.tolist()
        assert len(anchor) == len(data) - 49 and len(rank) == len(data) - 19


def found(df):
    return sorted(((r["id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,block,chunk", [(1, 400, 64), (2, 1 << 20, 1 << 20), (3, 150, 1 << 20)])
def test_random_texts(docs_of, monkeypatch, seed, block, chunk):
    """Passages copied around; blocks and chunks smaller than documents in some cases."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 2000)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    pool = [" ".join(word() for _ in range(rng.randint(3, 40))) for _ in range(8)]
    rows = [(i, "".join(rng.choice(pool) if rng.random() < 0.5 else word() for _ in range(rng.randint(0, 9))))
            for i in rng.sample(range(500), 60)]
    rows += [(501, "a" * 300), (502, "a" * 200), (503, "ab" * 120), (504, None), (505, "x" * 49), (506, "x" * 50), (7777, "x" * 50)]
    docs = docs_of([(i, t, None, None) for i, t in rows]).repartition(3)
    assert found(suffix_dedup.repeated_spans(docs)) == plain(rows)


def test_hot_classes(docs_of, monkeypatch):
    """A short string with other neighbours in every document, and long documents of one byte or
    period: no class is held above the limit, and equal strings of one document are sent once."""
    monkeypatch.setattr(suffix_dedup, "MOST_CLASS_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2500)
    tables = {}
    write = suffix_dedup.staged
    monkeypatch.setattr(suffix_dedup, "staged", lambda df, name: tables.setdefault(name, write(df, name)))
    rng = random.Random(4)
    few = lambda k: "".join(rng.choice("01") for _ in range(k))
    line = lambda: f"{few(14)}{few(3)}#twenty bytes of header#{few(3)}{few(14)}"
    rows = [(i, line() + few(rng.randint(0, 30))) for i in range(150)]
    rows += [(i, "".join(f"7{few(1)}" + "A header many lines of it have, but not all the rest:" + few(2) for _ in range(30)))
             for i in (200, 200, 201, None, None)]
    rows += [(300, "a" * 6000), (301, "a" * 3000), (302, "abc" * 1500), (303, "abc" * 800), (303, "bca" * 800)]
    rng.shuffle(rows)
    docs = docs_of([(i, t, None, None) for i, t in rows]).repartition(3)
    assert found(suffix_dedup.repeated_spans(docs)) == plain(rows)
    sizes = lambda df: {r["class"]: r["n"] for r in df.where("class >= 0").groupBy("class").agg({"bytes": "sum"}).toDF(
        "class", "n").collect()}
    whole, split = sizes(tables["suffix-runs"]), sizes(tables["suffix-strings"])
    hot = [n for n in whole.values() if n > 4000]
    assert hot and max(hot) < 25000 and max(split.values()) < max(hot) / 1.5 and not whole.keys() & split.keys()


def test_equal_runs_of_one_document(docs_of, monkeypatch):
    """A document of one byte is one string and offsets, not a string for each position."""
    tables = {}
    write = suffix_dedup.staged
    monkeypatch.setattr(suffix_dedup, "staged", lambda df, name: tables.setdefault(name, write(df, name)))
    rows = [(1, "a" * 30000), (2, "b" + "a" * 20000), (3, "a" * 49)]
    assert found(suffix_dedup.repeated_spans(docs_of([(i, t, None, None) for i, t in rows]))) == plain(rows)
    assert tables["suffix-runs"].where("class >= 0").agg({"bytes": "sum"}).first()[0] < 1000


def test_odd_rows(docs_of):
    rows = [*ODD, (20, "q" * 80, "en", None), (20, "q" * 80, "en", None), (None, "q" * 70, None, None)]
    small = [r for r in rows if r[0] != 7]
    assert found(suffix_dedup.repeated_spans(docs_of(small))) == plain([(r[0], r[1]) for r in small])
    assert suffix_dedup.repeated_spans(docs_of(rows)).count() == len(rows)
    assert suffix_dedup.repeated_spans(docs_of([])).count() == 0


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in plain(docs)]
    assert sorted(map(tuple, LLM_QUERIES["op8_suffix_dedup"](spark, SF).collect()), key=str) == sorted(want, key=str)


def test_strings_of_one_rank():
    """Strings that share a rank keep their own first of least order."""
    import numpy as np

    flat = np.frombuffer(b"aaaabbbbaaaaccccbbbbdddd", np.uint8)
    place, order = np.arange(0, 24, 4), np.array([3, 1, 2, 5, 1, 4])
    same = np.array([7, 7, 7, 7, 7, 9], np.uint64)
    assert suffix_dedup._heads(same, order, flat, place, 4).tolist() == [2, 1, 2, 3, 1, 5]
    true = np.array([1, 2, 1, 3, 2, 4], np.uint64)
    assert suffix_dedup._heads(true, order, flat, place, 4).tolist() == [2, 1, 2, 3, 1, 5]
    assert suffix_dedup._heads(same[:0], order[:0], flat, place[:0], 4).tolist() == []
