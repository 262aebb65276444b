from hashlib import sha256
from math import floor, inf, isfinite, nan

import numpy as np
import pytest

from codesieve.llm import centroids
from llm.conftest import LARGE, SF
from oracle_check import compare


@pytest.mark.parametrize("sf", [SF, LARGE])
def test_query_with_sql(spark, sf):
    ok, note = compare(spark, sf, "op13_centroid_clustering")
    assert ok, note


@pytest.mark.parametrize("k", [1, 2, 3, 17, 60])
def test_orchard_is_exact(k):
    rng = np.random.default_rng(k)
    vectors = rng.integers(-6, 6, (4000, 3))
    centres = rng.integers(-6, 6, (k, 3))  # some are equal, and many distances tie
    held, distance = centroids.orchard(vectors, centroids.neighbours(centres))
    every = ((vectors[:, None] - centres[None]) ** 2).sum(2)
    assert (distance == every.min(1)).all() and (held == every.argmin(1)).all()


def plain(rows, k, rounds, dims):
    kept = [(i, [floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((apart(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centres = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centres)]
    found = [(i, near(v)) for i, v in kept]
    per = [sum(d for _, (d, n) in found if n == c) for c in range(len(centres))]
    return [(i, n, d, per[n], sum(per), sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, (d, n) in found]


def build(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                                 "vec_id long, embedding array<double>, id string, v int").repartition(3)


@pytest.mark.parametrize("k", [1, 4, 100])
def test_odd_rows(spark, k):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=3) + i % 5).tolist()) for i in range(60)]
    rows += [(7, [0.5, -0.5, 0.0])] * 20 + [(None, [1.0, 1.0, 1.0])] * 2 + [(80 + i, v) for i, v in enumerate((
        None, [], [1.0, 2.0], [1.0, None, 3.0], [nan, 1.0, 1.0], [inf, 0.0, 0.0], [1.0, 2.0, 3.0, 4.0], [-0.0001, 0.0, -0.0]))]
    got = centroids.cluster(build(spark, rows), k, 4, dims=3).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows, k, 4, 3), key=str)


def test_empty_and_huge(spark):
    assert centroids.cluster(build(spark, []), 3, 2, dims=3).count() == 0
    assert centroids.cluster(build(spark, [(1, None)]), 3, 2, dims=3).count() == 0
    rows = [(1, [1e300, 0.0, 0.0]), (2, [-1e30, 0.0, 0.0]), (3, [1.0, 2.0, 3.0])]
    got = {r["vec_id"] if "vec_id" in r else r["id"]: r for r in centroids.cluster(build(spark, rows), 3, 2, dims=3).collect()}
    assert got[1]["cluster"] is None and got[2]["distance"] is None and (got[3]["cluster"], got[3]["inertia"]) == (0, 0)
    big = [(i, [131072.0 * (-1) ** i, 0.0, 131072.0]) for i in range(4)]
    got = sorted(map(tuple, centroids.cluster(build(spark, big), 2, 2, dims=3).collect()))
    assert got == sorted(plain(big, 2, 2, 3))
