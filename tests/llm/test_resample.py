import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest

from codesieve.llm import resample
from llm.conftest import ODD, SF
from oracle_check import compare


def test_query_with_sql(spark):
    ok, note = compare(spark, SF, "op12_importance_resampling")
    assert ok, note


def plain(docs, target, buckets, most_words, least, share):
    def runs(text):
        w = re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())
        return len(w), [b" ".join(w[i:i + n]) for n in range(1, most_words + 1) for i in range(len(w) - n + 1)]

    place = lambda f: zlib.crc32(f) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(place, runs(text)[1]))
    for text in target:
        t.update(map(place, runs(text)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n, f = runs(text)
        h = int(sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[place(x)] for x in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[:len(fit) * share[0] // share[1]]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("most_words, share, samples", [(1, (10, 100), 1 << 15), (3, (1, 2), 5), (2, (1, 1), 40), (1, (0, 1), 40)])
def test_against_plain_code(spark, docs_of, monkeypatch, most_words, share, samples):
    """Many repeated rows, a null id among them, with few samples and small segments."""
    monkeypatch.setattr(resample, "SAMPLES", samples)
    monkeypatch.setattr(resample, "SEGMENT_ROWS", 9)
    monkeypatch.setattr(resample, "REMEMBERED", 10)
    rows = [*ODD, *((100 + i, f"alpha beta w{i % 9} " * (i % 5), None, None) for i in range(150)),
            *[(None, "the same text again", None, None)] * 70, *[(3, "gamma delta alpha", None, None)] * 30]
    target = ["alpha beta alpha", None, "", "w3 été"]
    bench = spark.createDataFrame([(k, x, "id") for k, x in enumerate(target)], "item_id long, text string, id string")
    got = resample.resampled(docs_of(rows).repartition(5), bench, share, 97, most_words, 2)
    want = plain([(r[0], r[1]) for r in rows], target, 97, most_words, 2, share)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_pieces(monkeypatch):
    """A long text is read in pieces and its runs pass from one to the next."""
    text = ("one two, three " * 400_000).encode()
    got = [f for found in resample.features(text, 3) for f in found]
    assert len(got) == 3 * 1_200_000 - 3 and Counter(got)[b"three one two"] == 399_999


def test_empty(spark, docs_of):
    none = spark.createDataFrame([], "text string")
    assert resample.resampled(docs_of([]), none).count() == 0
    rows = resample.resampled(docs_of(ODD), none).collect()
    assert len(rows) == len(ODD) and {r["weight"] for r in rows if r["n_features"] == 0} == {0}
