import numpy as np
import pytest
import xxhash

from codesieve.llm import simhash
from codesieve.llm.components import connected_components
from codesieve.llm.queries import LLM_QUERIES
from llm.conftest import LARGE, ODD


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace(
        "\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(fps):
    """{id: least id reachable} by comparing all pairs."""
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    label = np.arange(len(ids))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return {i: ids[k] for i, k in zip(ids, label)}
        label = new


def test_fingerprint():
    for text in ["", None, "a", "a b c", "A b C d", "the quick brown fox jumps over the lazy dog " * 9, "é Ü ß 🙂 x\x0by"]:
        assert simhash.fingerprint(None if text is None else text.encode()) % 2**64 == plain_fingerprint(text)


def test_query(spark):
    rows = {r["doc_id"]: r for r in LLM_QUERIES["op1_simhash_near_dedup"](spark, LARGE).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{LARGE}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in rows.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in rows.items()} == plain_components(fps)


def test_odd_rows(docs_of):
    rows = simhash.near_duplicates(docs_of(ODD)).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["id"], set()).add(r["component_id"])
    assert by[1] == by[2] == by[3] == {1} and by[4] == by[5] == {4}
    assert simhash.near_duplicates(docs_of([])).count() == 0


@pytest.mark.parametrize("bits,count", [(4, 30), (16, 1700), (9, 300)])
def test_dense_lists(spark, bits, count):
    """Clusters of fingerprints, larger than the pairwise limit in one case."""
    rng = np.random.default_rng(bits)
    centres = rng.integers(0, 2**63, 3, dtype=np.int64)
    values = set()
    while len(values) < count:
        flips = rng.choice(bits, rng.integers(0, 4), replace=False)
        values.add(int(centres[rng.integers(3)]) ^ sum(1 << int(b) for b in flips))
    values = sorted(values)
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long").repartition(4))
    found = {r["node"]: r["root"] for r in connected_components(links).collect()}
    want = plain_components({v: v % 2**64 for v in values})
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups({v: found.get(v, v) for v in values}) == groups(want)


def test_close16():
    rng = np.random.default_rng(1)
    values = rng.choice(1 << 16, 1500, replace=False)
    assert (simhash._close16(values) == simhash._close(values)).all()


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300)]
    roots = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert roots == {**{i: 0 for i in range(41)}, 100: 100, 200: 100}
