from collections import Counter, defaultdict
from zlib import crc32

from codesieve.llm import langid
from codesieve.llm.queries import LLM_QUERIES
from llm.conftest import LARGE, ODD


def test_held_out_accuracy(spark):
    rows = LLM_QUERIES["op10_language_id"](spark, LARGE).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{LARGE}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = sum(r["lang_pred"] == lang[r["doc_id"]] for r in held)
    assert len(held) > 250 and right / len(held) > 0.97, Counter(
        (lang[r["doc_id"]], r["lang_pred"]) for r in held if r["lang_pred"] != lang[r["doc_id"]])


def test_counts_by_hand(spark, docs_of):
    rows = [(1, "ab", "x", None), (2, "AB 1b", "x", None), (3, "cd", "y", None), (4, "cd", None, None), (5, None, "y", None)]
    model = langid.train(docs_of(rows))
    assert model.languages == ["x", "y"]
    want = defaultdict(Counter)
    for _, text, lang, _ in rows:
        if lang:
            want[lang].update(langid.trigrams(text).tolist())
    for lang, row in zip(model.languages, model.probability):
        total = sum(want[lang].values()) + langid.SMOOTHING * langid.BUCKETS
        for bucket, n in want[lang].items():
            assert abs(row[bucket] - (n + langid.SMOOTHING) / total) < 1e-12
        assert abs(row.sum() - 1) < 1e-9


def test_mixture(spark, docs_of):
    en, fr, de = "the house and the garden with this ", "les maisons dans la rue avec des ", "der garten und die strasse mit dem "
    rows = [(i, t * 40, lang, None) for i, (t, lang) in enumerate([(en, "en"), (fr, "fr"), (de, "de")] * 3)]
    model = langid.train(docs_of(rows))
    langs, score = langid.identify(model, en * 20 + fr * 10)
    assert [x for x, _ in langs] == ["en", "fr"] and 0.5 < langs[0][1] < 0.8
    assert [x for x, _ in langid.identify(model, de * 10)[0]] == ["de"]


def test_odd_rows(docs_of):
    docs = docs_of(ODD)
    model = langid.train(docs)
    rows = langid.identified(docs, model).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["__lang"] == "und" and by[i]["__score"] == 0 for i in (1, 2, 3, 6))
    assert by[8]["__lang"] == "fr" and by[7]["__lang"] == "en"
    empty = docs_of([])
    none = langid.train(empty)
    assert none.languages == [] and langid.identified(empty, none).count() == 0
    assert langid.identified(docs, none).first()["__lang"] == "und"


def test_more_languages_than_a_model_holds(docs_of, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    rows = [(i, f"text of {'abcdefg'[i % 7] * 3}", f"l{i % 7}", None) for i in range(21)] + [(30, "x", "l6", None), (31, "y", "l4", None)]
    model = langid.train(docs_of(rows))
    assert model.languages == ["l0", "l4", "l6"] and model.others == 4
