import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
from codesieve.llm import langid
from llm.conftest import LARGE, ODD
from llm.test_decontam import plain as plain_hits
from llm.test_simhash import plain_components, plain_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return len((text or "").encode().split())


def plain_mix(docs):
    """{doc_id: copies} by sorting each source by hash, targets by resharing until none is above."""
    sums = defaultdict(int)
    for d in docs:
        sums[d["source"]] += words(d["text"])
    order = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = sum(sums.values()) - sum(3 * sums[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        total = sum(weight[s] for s in open_)
        target = {s: 3 * sums[s] if s in capped else left * weight[s] / total for s in order}
        new = {s for s in open_ if target[s] >= 3 * sums[s]}
        if not new:
            break
        capped |= new
    copies = {}
    for s in order:
        whole = int(target[s] // sums[s]) if sums[s] else 0
        rest, at = target[s] - whole * sums[s], 0
        own = sorted((int(hashlib.md5(str(d["doc_id"]).encode()).hexdigest()[:15], 16), d["doc_id"], words(d["text"]))
                     for d in docs if d["source"] == s)
        for _, i, n in own:
            take = at + n <= rest or at <= rest and at + n - rest < rest - at
            copies[i] = whole + take
            at += n
    return copies, target


def test_against_plain_code(spark):
    """All rows of run() from the documents and plain versions of the stages."""
    docs = [r.asDict() for r in spark.read.parquet(f"{LARGE}/documents.parquet").collect()]
    kept = [d for d in docs if any(c.isalpha() for c in d["text"] or "")]
    roots = plain_components({d["doc_id"]: plain_fingerprint(d["text"]) for d in kept})
    kept = [d for d in kept if roots[d["doc_id"]] == d["doc_id"]]
    items = [tuple(r) for r in spark.read.parquet(f"{LARGE}/benchmark.parquet").collect()]
    hits = {r[0] for r in plain_hits([(d["doc_id"], d["text"]) for d in kept], items) if r[2]}
    kept = [d for d in kept if d["doc_id"] not in hits]
    copies, _ = plain_mix(kept)
    want = Counter({d["doc_id"]: copies[d["doc_id"]] for d in kept if copies[d["doc_id"]]})
    rows = corpus_pipeline.run(spark, LARGE).collect()
    assert Counter(r["doc_id"] for r in rows) == want
    assert 0 < len(hits) and len(kept) < len(docs)
    texts = {d["doc_id"]: d["text"] for d in docs}
    assert all(r["text"] == texts[r["doc_id"]] for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stages_keep_columns_and_odd_rows(spark, docs_of, tmp_path):
    docs = docs_of([*ODD, (30, "the house and this garden", "en", "a"), (30, "the house and this garden", "en", "a"),
                    (None, "the house and that garden", "en", "a"), (None, None, None, None)])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, LARGE)
        assert out.columns[:len(docs.columns)] == docs.columns and (k == 4 or out.columns == docs.columns)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 0:
            assert {r["doc_id"] for r in docs.collect()} == {4, 5, 7, 8, 9, 10, 30, None}
            assert docs.where("doc_id IS NULL").count() == 2
        if k == 1:
            assert docs.where("doc_id = 5").count() == 0 and docs.where("doc_id = 30").count() == 2
            assert docs.where("doc_id IS NULL").count() == 2
    assert docs.count() > 0


def test_empty_table(spark, docs_of):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_of([]), LARGE).count() == 0, name


def test_no_language(spark, docs_of):
    assert corpus_pipeline.language_id(spark, docs_of([(1, "text", None, None)]), LARGE).count() == 0
    assert langid.UNKNOWN == "und"
