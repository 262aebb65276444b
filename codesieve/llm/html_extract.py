"""Main text of web pages by a linear-chain conditional random field.

A page becomes its leaf blocks, the runs of text between block-level tags, each with its ancestors.
The field scores every block from its ancestors' tags and classes and from its text, and every
change between neighbours; Viterbi gives the likeliest labels of the whole page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 15
#: The field is fitted on this many labelled pages at most, those of least id hash.
MOST_PAGES = 600
#: Pages with more blocks than this are not used for fitting; all pages are decoded whole.
MOST_BLOCKS = 2000
EPOCHS, RATE, DECAY = 8, 0.3, 1e-5

# Tag names of the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW, CLOSED = "script|style", "noscript|template|svg|iframe|object"
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = frozenset("ul ol dl table body article section main div".split())
ARTICLE = frozenset({"article", "main"})
#: Marks of what is no article, in tags and in class and id words; used for labels.
OTHER_TAGS = frozenset("head nav header footer aside form button select textarea menu dialog".split())
OTHER_WORDS = frozenset("ad ads advert advertisement banner breadcrumb comment comments cookie footer header menu nav "
                        "navbar newsletter notice popup promo related share sidebar social sponsor subscribe widget".split())

# Quotes delimit a value behind ``=`` only. What is read is never read again: a tag that does not end
# is the last token, so the work is linear in the page.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<({CLOSED})\b[^>]*+>|<[!?][^>]*+>|"
    r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|(<)(?=/?[A-Za-z]|[!?])",
    re.S | re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in CLOSED.split("|")}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass(eq=False, slots=True)
class Place:
    """An open element with what its blocks need of all elements around it. Elements that add nothing
    share the sets of the one they are in, so a deep page costs no more than a flat one."""

    around: Place | None = None
    tag: str = ""
    words: tuple[str, ...] = ()
    #: Of this element and those around it: block-level tags, class words, depth, nearest block-level tag.
    all_tags: frozenset[str] = frozenset()
    all_words: frozenset[str] = frozenset()
    depth: int = 0
    nearest: str = ""
    #: Whether one of them is a link, names the article, is marked as something else.
    link: bool = False
    article: bool = False
    other: bool = False

    def inside(self, tag: str, words: tuple[str, ...]) -> Place:
        block = tag not in INLINE
        return Place(
            self, tag, words,
            self.all_tags if not block or tag in self.all_tags else self.all_tags | {tag},
            self.all_words if self.all_words.issuperset(words) else self.all_words.union(words),
            self.depth + block, tag if block else self.nearest, self.link or tag == "a",
            self.article or tag in ARTICLE,
            self.other or tag in OTHER_TAGS or not OTHER_WORDS.isdisjoint(words))

    def path(self) -> list[Place]:
        """Elements from the root to this one."""
        out, at = [], self
        while at.around is not None:
            out.append(at)
            at = at.around
        return out[::-1]


@dataclass
class Block:
    """A leaf block: its text, the element it is in, letters in links."""

    text: str
    place: Place
    linked: int = 0

    @property
    def tags(self) -> tuple[str, ...]:
        """Block-level tags from the root."""
        return tuple(p.tag for p in self.place.path() if p.tag not in INLINE)

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(w for p in self.place.path() for w in p.words)


@dataclass
class _Walk:
    stack: list = field(default_factory=lambda: [Place()])
    count: Counter = field(default_factory=Counter)
    parts: list = field(default_factory=list)
    linked: int = 0
    blocks: list = field(default_factory=list)

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.stack[-1], self.linked))
        self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        decoded = entities.unescape(raw) if "&" in raw else raw
        self.parts.append(decoded)
        if self.stack[-1].link:
            self.linked += len(decoded)

    def leave(self, at: int) -> None:
        for place in self.stack[at:]:
            self.count[place.tag] -= 1
        del self.stack[at:]

    def open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag not in INLINE:
            self.end_block()
            gone = CLOSES.get(tag, set()) | {"p"}
            for at in range(len(self.stack) - 1, 0, -1) if any(self.count[t] for t in gone) else ():
                if self.stack[at].tag in gone:
                    self.leave(at)
                    break
                if self.stack[at].tag in SCOPES:
                    break
        if tag not in VOID:
            words = [w.lower() for m in _NAMES.finditer(attributes) for g in m.groups() if g
                     for w in re.split(r"[\s_-]+", g) if w] if "=" in attributes else []
            self.stack.append(self.stack[-1].inside(tag, tuple(words)))
            self.count[tag] += 1

    def close(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_block()
        for at in range(len(self.stack) - 1, 0, -1) if self.count[tag] else ():
            if self.stack[at].tag == tag:
                self.leave(at)
                return
            if tag in INLINE and self.stack[at].tag not in INLINE:
                return


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks of a page in order. Unclosed and stray tags are tolerated; scripts, styles and
    comments are no text, nor are drawings, frames and the like up to their end tag, if they have
    one; <br> counts as white space. A tag without an end takes the rest of the page."""
    page, walk, at = page or "", _Walk(), 0
    tokens, endless = _TOKEN.finditer(page), set()
    while token := next(tokens, None):
        if token.start() > at:
            walk.text(page[at:token.start()])
        at = token.end()
        if token[6]:
            at = len(page)
            break
        if token[4]:
            (walk.close if token[3] else walk.open)(token[4].lower(), *(() if token[3] else (token[5] or "",)))
        elif token[2] and (name := token[2].lower()) not in endless and not (name == "svg" and token[0].endswith("/>")):
            if end := _ENDS[name].search(page, at):
                at = end.end()
                tokens = _TOKEN.finditer(page, at)
            else:
                endless.add(name)
    walk.text(page[at:])
    walk.end_block()
    return walk.blocks


def features(blocks: list[Block], hidden: frozenset[str] = frozenset()) -> list[list[int]]:
    """Hashed features of each block; tags in ``hidden`` are passed over."""
    out = []
    for k, b in enumerate(blocks):
        place, tags, depth, parent = b.place, b.place.all_tags, b.place.depth, b.place.nearest
        if not hidden.isdisjoint(tags):
            shown = [t for t in b.tags if t not in hidden]
            tags, depth, parent = set(shown), len(shown), shown[-1] if shown else ""
        size, words = len(b.text), b.text.count(" ") + 1
        names = {"bias", f"parent:{parent}", f"depth:{min(depth, 12)}",
                 f"words:{min(words.bit_length(), 8)}", f"linked:{round(4 * min(1.0, b.linked / size))}",
                 f"end:{b.text[-1] in '.!?…:;”\"'}", f"first:{k == 0}", f"last:{k == len(blocks) - 1}",
                 f"symbol:{not b.text[0].isalnum()}", f"commas:{min(3, b.text.count(','))}"}
        names.update(f"tag:{t}" for t in tags)
        names.update(f"word:{w}" for w in place.all_words)
        if place.other:
            names.add("other")
        out.append([crc32(n.encode()) % FEATURES for n in sorted(names)])
    return out


def markup_labels(blocks: list[Block]) -> list[int] | None:
    """Labels of a page whose markup names its article: 1 inside it and outside of anything marked
    as something else. None for a page without <article> or <main>."""
    if not any(b.place.article for b in blocks):
        return None
    return [int(b.place.article and not b.place.other) for b in blocks]


@dataclass(frozen=True)
class RandomField:
    """state: weights by label and feature. step: scores of label pairs."""

    state: np.ndarray
    step: np.ndarray


def _scores(state: np.ndarray, own: list[list[int]]) -> list[tuple[float, float]]:
    return [(float(s[0]), float(s[1])) for s in (state[:, f].sum(1) for f in own)]


def _plus(a: float, b: float) -> float:
    return max(a, b) + log(1 + exp(-abs(a - b)))


def _marginals(scores, step):
    """Probabilities of label 1 at each block and of each label pair, by forward and backward sums."""
    n = len(scores)
    f, b = [scores[0]], [(0.0, 0.0)] * n
    for s in scores[1:]:
        f.append(tuple(s[y] + _plus(f[-1][0] + step[0][y], f[-1][1] + step[1][y]) for y in (0, 1)))
    for k in range(n - 2, -1, -1):
        s = scores[k + 1]
        b[k] = tuple(_plus(step[y][0] + s[0] + b[k + 1][0], step[y][1] + s[1] + b[k + 1][1]) for y in (0, 1))
    total = _plus(*f[-1])
    one = [exp(min(0.0, f[k][1] + b[k][1] - total)) for k in range(n)]
    pair = np.zeros((2, 2))
    for k in range(n - 1):
        for y in (0, 1):
            for z in (0, 1):
                pair[y, z] += exp(min(0.0, f[k][y] + step[y][z] + scores[k + 1][z] + b[k + 1][z] - total))
    return one, pair


def fit(pages: list[tuple[list[list[int]], list[int]]]) -> RandomField:
    """Maximises the conditional likelihood by stochastic gradients with adaptive rates."""
    state, step = np.zeros((2, FEATURES)), np.zeros((2, 2))
    state_sum, step_sum = np.full((2, FEATURES), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(EPOCHS):
        for own, labels in pages:
            one, pair = _marginals(_scores(state, own), step.tolist())
            for f, p, y in zip(own, one, labels):
                g = np.array([(1 - y) - (1 - p), y - p])[:, None] - DECAY * state[:, f]
                state_sum[:, f] += g * g
                state[:, f] += RATE * g / np.sqrt(state_sum[:, f])
            seen = np.zeros((2, 2))
            np.add.at(seen, (labels[:-1], labels[1:]), 1)
            step_sum += (seen - pair) ** 2
            step += RATE * (seen - pair) / np.sqrt(step_sum)
    return RandomField(state, step)


def viterbi(model: RandomField, own: list[list[int]]) -> list[int]:
    """The likeliest labels; equal scores go to 0."""
    if not own:
        return []
    scores, step = _scores(model.state, own), model.step.tolist()
    best, back = scores[0], []
    for s in scores[1:]:
        origin = [int(best[1] + step[1][y] > best[0] + step[0][y]) for y in (0, 1)]
        back.append(origin)
        best = tuple(s[y] + best[origin[y]] + step[origin[y]][y] for y in (0, 1))
    labels = [int(best[1] > best[0])]
    for origin in reversed(back):
        labels.append(origin[labels[-1]])
    return labels[::-1]


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> RandomField:
    """Fits the field on up to MOST_PAGES pages that markup_labels can label.

    Those are the labelled pages of least id hash, however few of the table's pages have labels, so
    the sample is the same for the same table. Without a labelled page all weights are 0 and every
    block counts as no article.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, rows, labels = [], [], []
            for order, page in zip(batch.column(0), batch.column(1)):
                blocks = leaf_blocks(page.as_py())
                own = markup_labels(blocks) if 0 < len(blocks) <= MOST_BLOCKS else None
                if own is not None:
                    hashes.append(order.as_py())
                    # Every other page hides what its labels come from, so that the rest is learned too.
                    rows.append(features(blocks, ARTICLE if hashes[-1] % 2 else frozenset()))
                    labels.append(own)
            yield pa.RecordBatch.from_arrays([
                pa.array(hashes, pa.int64()), pa.array(rows, pa.list_(pa.list_(pa.int32()))),
                pa.array(labels, pa.list_(pa.int32()))], ["order", "features", "labels"])

    slim = pages.select(F.xxhash64(F.col(id_col).cast("string")).alias("order"), F.col(html_col).cast("string").alias("html"))
    # Pages are labelled in ascending order of their hash, first about four times as many as needed,
    # then eight times as many each time until there are enough or no page is left. The thresholds
    # part the hashes, so no page moves and none is parsed twice. Labels need one of these tags.
    tagged = slim.where(F.col("html").rlike("(?i)<(?:article|main)"))
    low, top, part = -2**63 - 1, 2**63 - 1, min(1.0, 4 * MOST_PAGES / max(pages.count(), 1))
    rows = []
    while low < top and len(rows) < MOST_PAGES:
        high = min(top, -2**63 + int(part * 2**64)) if part < 1 else top
        own = tagged.where(F.col("order") <= high)
        own = own.where(F.col("order") > low) if low >= -2**63 else own
        rows += own.mapInArrow(learn, "order long, features array<array<int>>, labels array<int>").orderBy(
            "order").limit(MOST_PAGES - len(rows)).collect()
        low, part = high, 8 * part
    return fit([(r["features"], r["labels"]) for r in rows])


def main_text(model: RandomField, page: str | None) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, y in zip(blocks, viterbi(model, features(blocks))) if y)


def extracted(pages: DataFrame, model: RandomField, html_col: str = "html") -> DataFrame:
    """pages with __text, the blocks of the article joined by line ends.

    Null and empty pages, and pages without an article, give an empty text. Repeated rows give
    equal texts; all columns of pages come through.
    """
    sent = pages.sparkSession.sparkContext.broadcast((model.state, model.step))

    @F.pandas_udf("string")
    def answer(column):
        own = RandomField(*sent.value)
        return column.map(lambda page: main_text(own, page), na_action=None)

    return pages.withColumn("__text", answer(F.coalesce(F.col(html_col).cast("string"), F.lit(""))))
