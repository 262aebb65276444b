"""Exact dedup, mixing and sharding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesieve.llm import exact_dedup, mixing, sharding
from codesieve.llm.queries import LLM_QUERIES
from llm.conftest import ODD, SF
from llm.test_pipeline import plain_mix, words
from oracle_check import compare


@pytest.mark.parametrize("name", ["op5_mixing", "op7_exact_dedup"])
def test_queries_with_sql(spark, name):
    ok, note = compare(spark, SF, name)
    assert ok, note


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**60, n, dtype=np.uint64))
    f = exact_dedup.build_filter(keys)
    assert exact_dedup.may_hold(f, keys).all()
    other = rng.integers(2**60, 2**63, 20_000, dtype=np.uint64)
    assert exact_dedup.may_hold(f, other).mean() < 0.02
    assert len(f.cells) < max(64, 1.35 * n + 64)


@pytest.mark.parametrize("stored", ["false", "true", "doc_id % 2 = 0", "doc_id > 5"])
def test_dedup_odd_rows(docs_of, monkeypatch, stored):
    monkeypatch.setattr(exact_dedup, "KEYS_PER_BUCKET", 3)
    rows = [*ODD, (20, "one  two", None, None), (21, "one\ttwo", None, None), (22, " one two", None, None), (0, "x", None, None)]
    groups = defaultdict(list)
    norm = lambda t: __import__("re").sub("[ \t-\r]+", " ", t or "")
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    got = exact_dedup.dedup_against(docs_of(rows), F.expr(stored)).collect()
    want = sorted((str(i), str(min((x for x in groups[norm(t)] if x is not None), default=None)), len(groups[norm(t)]))
                  for i, t, *_ in rows)
    assert sorted((str(r["id"]), str(r["keep_id"]), r["group_size"]) for r in got) == want
    assert all(r["kept"] == (r["id"] == r["keep_id"]) for r in got)
    assert exact_dedup.dedup_against(docs_of([]), F.expr(stored)).count() == 0


def test_mix_odd_rows(docs_of):
    rows = [*ODD, *((100 + i, "w " * (i % 7 + 1), None, f"s{i % 4}") for i in range(200))]
    docs = docs_of(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    plain, target = plain_mix([{"doc_id": r[0], "text": r[1], "source": r[3]} for r in rows if r[0] not in (5, None)])
    for r in got:
        assert 0 <= r["__copies"] <= 3 and r["__size"] == words(r["text"])
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += r["__size"] * r["__copies"]
    targets = {r["source"]: r["__target"] for r in got}
    largest = defaultdict(int)
    for r in got:
        largest[r["source"]] = max(largest[r["source"]], r["__size"])
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in targets)
    assert mixing.mixed_rows(docs).count() == sum(r["__copies"] for r in got)
    assert mixing.mix(docs_of([])).count() == 0
    assert mixing.mixed_rows(docs_of([(1, None, None, None), (2, "", None, "a")])).count() == 0


def test_flow_is_cheapest():
    """Against the closed form: what does not fit where it lies has to move, and nothing else."""
    rng = random.Random(2)
    for _ in range(30):
        n, m = rng.randint(1, 7), rng.randint(1, 7)
        supply = [rng.randint(0, 50) for _ in range(n)]
        room = sharding.even_capacities(sum(supply), m)
        flows = sharding.minimum_cost_flow(supply, room, lambda i, j: int(i != j))
        assert [sum(v for (i, _), v in flows.items() if i == k) for k in range(n)] == supply
        assert [sum(v for (_, j), v in flows.items() if j == k) for k in range(m)] == room
        moved = sum(v for (i, j), v in flows.items() if i != j)
        assert moved == sum(max(0, s - (room[i] if i < m else 0)) for i, s in enumerate(supply))
    with pytest.raises(ValueError):
        sharding.minimum_cost_flow([5], [4], lambda i, j: 0)


def test_sharding_query(spark):
    rows = LLM_QUERIES["op2_sharding"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    size, slots, largest = defaultdict(int), defaultdict(list), 0
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes"
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        largest = max(largest, r["size"])
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 16
    # A shard is filled from at most a few old ones, each cut within a row.
    assert all(abs(s - mean) <= 4 * largest for s in size.values())


def test_only_the_flow_moves(spark, docs_of):
    docs = docs_of([(i, "x" * (i % 50), None, None) for i in range(2000)])
    plan = sharding.plan_resharding(docs, 6, 4, old_shard=F.expr("CAST(doc_id % 4 AS int)"))
    rows = plan.rows.collect()
    moved = sum(r["__size"] for r in rows if r["__old"] != r["__shard"])
    want = sum(v for (i, j), v in plan.flows.items() if i != j)
    assert len(rows) == 2000 and abs(moved - want) <= 51 * 8


def test_sharding_odd_rows(docs_of):
    rows = sharding.reshard(docs_of(ODD), 3, 2).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ODD)
    assert {r["key"] for r in rows} == {"x"}
    slots = defaultdict(list)
    for r in rows:
        slots[r["__shard"]].append(r["__slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.reshard(docs_of([]), 3, 2).count() == 0
