import html
import re

import numpy as np

from codesieve.llm import html_extract as hx
from codesieve.llm.queries import LLM_QUERIES
from llm.conftest import LARGE


def plain_article(page):
    """By the pages' own layout: one <article> of <h1> and <p>."""
    body = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", page, re.S)[1]
    parts = [re.sub(r"<[^>]*>", " ", x) for x in re.split(r"</?(?:p|h\d)>", body)]
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in parts) if t)


def test_query(spark):
    rows = {r["page_id"]: r for r in LLM_QUERIES["op9_html_extraction"](spark, LARGE).collect()}
    pages = spark.read.parquet(f"{LARGE}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        r = rows[p["page_id"]]
        assert r["text"] == plain_article(p["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == p["url"]


def test_blocks():
    blocks = hx.leaf_blocks("<body><nav class='Top-menu'>a <a href='>'>b</a></nav><!-- <p>no</p> --><p>x<br>y &lt;&am<p><b>z"
                            "<script>if (a<b) '</p>'</script><ul><li>1<li>2</ul>tail")
    assert [b.text for b in blocks] == ["a b", "x y <&am", "z", "1", "2", "tail"]
    assert blocks[0].words == ("top", "menu") and blocks[0].linked == 1
    assert [b.tags[-1] for b in blocks] == ["nav", "p", "p", "li", "li", "body"]


def test_elements_without_end():
    texts = lambda page: [b.text for b in hx.leaf_blocks(page)]
    assert texts("<p>a<svg width='1'/><p>b<svg><text>no</text></svg><p>c") == ["a", "b", "c"]
    assert texts("<p>a<svg/><p>b") == texts("<p>a<SVG viewBox=''><p>b") == ["a", "b"]
    for name in ("noscript", "object", "template", "iframe", "svg"):
        assert texts(f"<p>a<{name}>no<p>no</{name.upper()} ><p>b<{name} x=y><p>c<{name}><p>d") == ["a", "b", "c", "d"]
    assert texts("<p>a<object><!-- no</object><p>b") == ["a", "b"]
    assert texts("<p>a<script><p>no") == texts("<p>a<style><p>no") == ["a"]
    assert len(texts("<p>a<svg><object>" * 20000)) == 20000


def test_field_against_all_labellings():
    """Marginals and the best path compared with every labelling of a short page."""
    rng = np.random.default_rng(3)
    scores, step = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
    every = [[k >> i & 1 for i in range(6)] for k in range(64)]
    weight = [sum(scores[i][y] for i, y in enumerate(ys)) + sum(step[a][b] for a, b in zip(ys, ys[1:])) for ys in every]
    p = np.exp(weight) / np.exp(weight).sum()
    one, pair = hx._marginals([tuple(s) for s in scores], step.tolist())
    assert np.allclose(one, [sum(q for q, ys in zip(p, every) if ys[i]) for i in range(6)])
    assert abs(pair.sum() - 5) < 1e-9
    state = np.zeros((2, hx.FEATURES))
    state[:, :6] = scores.T
    assert hx.viterbi(hx.RandomField(state, step), [[i] for i in range(6)]) == every[int(np.argmax(weight))]


def test_learns_without_article_tags(spark):
    """Fitted on pages with <article>, right on a page without any such tag."""
    long = "A sentence with several words, and commas, that goes on for a while. " * 3
    page = lambda tag: (f"<body><div class=menu><a href=x>Home</a></div><{tag}><p>{long}</p><p>{long}</p>"  # noqa: E731
                        f"<div class=comments><p>nice</p></div></{tag}><div class=footer>&copy; x</div></body>")
    pages = spark.createDataFrame([(i, page("article")) for i in range(40)], "page_id long, html string")
    model, one = hx.train(pages), " ".join(long.split())
    assert hx.main_text(model, page("article")) == hx.main_text(model, page("div")) == f"{one}\n{one}"


def test_few_labelled_pages(spark, monkeypatch):
    """The labelled pages of least hash are the sample, also where few pages of many have labels."""
    samples = []
    monkeypatch.setattr(hx, "fit", samples.append)
    text = lambda i: f"Page {i} has a sentence with several words, and commas. " * 3
    rows = [(i, f"<ARTICLE><p>{text(i)}</ARTICLE>" if i % 40 == 7 else f"<div><p>{text(i)}</div>") for i in range(800)]
    for most in (1, 5, 30):
        monkeypatch.setattr(hx, "MOST_PAGES", most)
        for part in (rows, [r for r in rows if r[0] % 40 == 7]):
            hx.train(spark.createDataFrame(part, "page_id long, html string").repartition(3))
        whole, labelled = samples[-2:]
        assert whole == labelled and len(whole) == min(most, 20)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no tags"), (None, "<article><p>one &amp; two"), (5, "<article><p>one &amp; two"),
            (5, "<article><p>one &amp; two"), (6, "<p>" * 3000 + "x" * 200_000), (7, "<<a <p </ >")]
    pages = spark.createDataFrame([(i, h, "u", "c") for i, h in rows], "page_id long, html string, url string, text string")
    out = hx.extracted(pages, hx.train(pages)).collect()
    assert len(out) == len(rows) and all(r["__text"] is not None for r in out)
    assert {r["__text"] for r in out if r["page_id"] == 5} == {"one & two"}
    none = pages.limit(0)
    assert hx.extracted(none, hx.train(none)).count() == 0


def test_stray_quotes_and_endless_tags():
    """Quotes count behind = only, and a page of unclosed tags takes time in proportion to its length."""
    import time

    texts = lambda page: [b.text for b in hx.leaf_blocks(page)]
    assert texts('<p><a title="x"">two</a> three</p>') == ["two three"]
    assert texts("<p title='a>b' data-x=c'd>one</p><p class=\"q\" \">two") == ["one", "two"]
    assert texts("<p>one</p> 2 < 3 <p a") == ["one", "2 < 3"]
    assert texts("<p>one<!-- never closed <p>two") == ["one"] and texts("one<script>x > 1 </scrip>") == ["one"]
    for piece in ("<b a", "<b =\">\"", "<!", "<script", "</p", "<b a='"):
        start = time.time()
        hx.leaf_blocks(piece * ((1 << 20) // len(piece)))
        assert time.time() - start < 5, piece


def test_deep_pages():
    """Nested elements that are never closed, and end tags of none that is open, take linear time."""
    import time

    for piece in ("<div>x", "<div class=a>x", "<b>x", "</b>x", "<p><b></i>x", "<li><ul><b>x", "<a href=x>x<hr>"):
        start = time.time()
        blocks = hx.leaf_blocks(piece * 100_000)
        hx.features(blocks)
        assert time.time() - start < 20, piece
    deep = hx.leaf_blocks("<article><div class='a b'>" * 50 + "<i>x")[0]
    assert deep.tags == ("article", "div") * 50 and deep.words == ("a", "b") * 50 and deep.place.depth == 100
    shown, hidden = hx.features([deep]), hx.features([deep], hx.ARTICLE)
    flat = hx.features(hx.leaf_blocks("<div class='a b'>" * 50 + "<i>x"))
    assert hidden == flat and shown != flat
