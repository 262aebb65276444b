import random
import re

import numpy as np
import pytest

from codesieve.llm import decontam
from codesieve.llm.queries import LLM_ORACLE, LLM_QUERIES
from llm.conftest import ODD, SF
from oracle_check import compare


def plain(docs, tests, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in tests:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[i:i + size]))):
                    hit.update(range(i, i + size))
                    items |= own
        out.append((doc, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in df.collect()), key=str)


def test_words():
    assert decontam.words_of("Ab-c_D9 é’x Y".encode()) == "ab c d9 é’x y".encode().split(b" ")


@pytest.mark.parametrize("parts", [1, 3])
def test_random_texts(spark, docs_of, monkeypatch, parts):
    """Few distinct words, so that windows overlap, repeat and share items."""
    rng = random.Random(parts)
    text = lambda k: " ".join(rng.choice("abc") for _ in range(k))
    tests = [(i, text(rng.choice([0, 1, 3, 4, 6]))) for i in range(12)] + [(50, None), (None, "b b b b")]
    docs = [(i, text(rng.choice([0, 2, 9, 40])), None, None) for i in range(60)] + [(90, None, None, None)]
    if parts > 1:
        monkeypatch.setattr(decontam, "MOST_TEST_BYTES", 20)
    items = spark.createDataFrame(tests, "item_id long, text string")
    got = found(decontam.contamination(docs_of(docs), items, window=4))
    assert got == plain([(d[0], d[1]) for d in docs], tests, 4)


def test_odd_rows(spark, docs_of):
    items = spark.createDataFrame([(1, "One"), (2, "!!"), (3, None)], "item_id long, text string")
    got = found(decontam.contamination(docs_of(ODD), items))
    assert got == plain([(d[0], d[1]) for d in ODD], [(1, "One")])
    assert decontam.contamination(docs_of([]), items).count() == 0
    assert {r[2] for r in found(decontam.contamination(docs_of(ODD), items.limit(0)))} == {0}


def test_odd_rows_in_parts(spark, docs_of, monkeypatch):
    """Rows that share an id, or have none, and their number of words stay apart."""
    monkeypatch.setattr(decontam, "MOST_TEST_BYTES", 4)
    tests = [(1, "One"), (2, "!!"), (3, None), (4, "two three"), (5, "four five"), (6, "one two")]
    docs = [*ODD, (5, "two three one", "en", "b"), (5, "x four five", "en", "b"), (None, "one two", "en", "c"),
            (None, "three four", "en", "c"), (None, None, None, None), (None, "", None, None)]
    items = spark.createDataFrame(tests, "item_id long, text string")
    got = found(decontam.contamination(docs_of(docs).repartition(3), items))
    assert got == plain([(d[0], d[1]) for d in docs], tests) and len(got) == len(docs)
    assert decontam.contamination(docs_of([]), items).count() == 0


def test_near_matches(spark, docs_of):
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    docs = docs_of([(1, "red green blue", None, None), (2, "red very green blue", None, None),
                    (3, "red", None, None), (4, "green blue", None, None), (5, "red a b c d green blue", None, None)])
    rows = {r["id"]: r for r in decontam.contamination(docs, items, slop=1).collect()}
    assert {i for i, r in rows.items() if r["near_items"]} == {1, 2}
    assert {i for i, r in rows.items() if r["items"]} == {1}


def plain_near(docs, tests, n, slop):
    """Every start of every document, each term anywhere within slop words."""
    out = {}
    for doc, text in docs:
        w, items = (text or "").split(), set()
        for item, own in tests:
            t = (own or "").split()
            for window in [t[i:i + n] for i in range(max(1, len(t) - n + 1))] if t else []:
                if any(all(any(w[q] == term for q in range(max(0, s + o - slop), min(len(w), s + o + slop + 1)))
                           for o, term in enumerate(window)) for s in range(-n - slop, len(w) + slop)):
                    items.add(str(item))
        out[doc] = sorted(items)
    return out


@pytest.mark.parametrize("slop", [0, 1, 4])
def test_near_matches_beside_other_documents(spark, docs_of, slop):
    """Terms at the edge of a neighbouring document neither make a match nor hide one."""
    rng = random.Random(slop)
    text = lambda k: " ".join(rng.choice("abcdefgh") for _ in range(k))
    tests = [(i, text(rng.choice([0, 1, 2, 4, 6]))) for i in range(25)]
    docs = [(i, text(rng.choice([0, 1, 3, 7, 15])), None, None) for i in range(80)]
    docs += [(90, "beta alpha", None, None), (91, "gamma x y z alpha", None, None), (92, None, None, None)]
    tests.append((30, "gamma alpha"))
    want = plain_near([d[:2] for d in docs], tests, 4, slop)
    items = spark.createDataFrame(tests, "item_id long, text string")
    for parts in (1, 4):
        rows = decontam.contamination(docs_of(docs).coalesce(1).repartition(parts), items, window=4, slop=slop).collect()
        assert {r["id"]: r["near_items"] for r in rows} == want
        assert slop or all(r["near_items"] == r["items"] for r in rows)


def test_one_index_for_several_test_sets(spark, docs_of, monkeypatch):
    """Segments are cut by words, and hold what any test set asks for."""
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 30)
    rng = random.Random(7)
    text = lambda k: " ".join(rng.choice("abcde") for _ in range(k))
    docs = [(i, text(rng.choice([0, 5, 12, 80])), None, None) for i in range(50)]
    index = decontam.build_index(docs_of(docs).coalesce(1))
    places = [[n + 1 for n in r["n_words"]] for r in index.select("n_words").collect()]
    assert len(places) > 10 and all(sum(p[:-1]) < 30 for p in places)
    assert sum(map(len, places)) == 50 and sum(sum(p) < 30 for p in places) <= 1
    for k in range(2):
        tests = [(i, text(4 + k)) for i in range(10)]
        rows = decontam.search(index, decontam.TestSet.of(tests, 4)).collect()
        got = sorted(((r["id"], r["n_words"], sum(x["last"] - x["first"] + 1 for x in r["spans"]), r["items"]) for r in rows), key=str)
        assert got == plain([d[:2] for d in docs], tests, 4)


@pytest.mark.parametrize("windows, starts", [(1, 1), (3, 20)])
def test_blocks_of_windows(monkeypatch, windows, starts):
    """The same matches however few windows and starts are held at a time."""
    rng = random.Random(windows)
    words = [rng.choice("abcd") for _ in range(300)]
    tests = decontam.TestSet.of([(1, " ".join(rng.choice("abcde") for _ in range(40)))], 3)
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    lists = [[i for i, x in enumerate(words) if x == w] for w in numbers]
    row = {"terms": [w.encode() for w in numbers], "n_words": [300],
           "counts": np.array([len(x) for x in lists], np.int32).tobytes(),
           "positions": np.array(sum(lists, []), np.int32).tobytes()}
    postings = decontam.Postings(row, tests.terms)
    pairs = lambda found: sorted((int(a), int(b)) for x, y in found for a, b in zip(x, y))
    want = pairs(postings.phrases(tests.windows[3])), sorted(set(pairs(postings.near(tests.windows[3], 1))))
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", windows)
    monkeypatch.setattr(decontam, "BLOCK_STARTS", starts)
    assert want[0] and want == (pairs(postings.phrases(tests.windows[3])),
                                sorted(set(pairs(postings.near(tests.windows[3], 1)))))


def test_query(spark):
    assert "op4_decontamination" in LLM_QUERIES and "op4_decontamination" in LLM_ORACLE
    ok, note = compare(spark, SF, "op4_decontamination")
    assert ok, note
