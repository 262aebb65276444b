"""Languages of a text as a mixture over n-gram models.

Each language has a distribution over letter trigrams, counted over all training rows. A text is a
mixture of languages; expectation-maximisation finds the proportions, and a language joins the set
only if the likelihood it adds passes a penalty that grows with the logarithm of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
MOST_LANGUAGES = 400
SMOOTHING = 0.05
#: A letter is part of three trigrams, so likelihoods count each three times over.
OVERLAP = 3
PENALTY = 2.0
ROUNDS = 25
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def trigrams(text: str | None) -> np.ndarray:
    """Hash bucket of (left, letter, right) for each letter; all that is no letter counts as space."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    padded = np.full(len(codes) + 2, 32, np.uint64)
    padded[1:-1][letter] = codes[letter]
    at = np.flatnonzero(letter)
    mixed = (padded[at] << np.uint64(42)) ^ (padded[at + 1] << np.uint64(21)) ^ padded[at + 2]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(49)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """languages by code point, and a row of trigram probabilities for each. ``others`` counts the
    languages beyond MOST_LANGUAGES, which have no row."""

    languages: list[str]
    probability: np.ndarray
    others: int = 0


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """Counts all rows with a language. At most MOST_LANGUAGES x BUCKETS counts reach the driver: of more
    languages those of most rows are learned, ties by code point, and the others are counted.

    Rows with null language or without a letter add nothing; without any other rows the model has
    no language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                own = sums.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"])

    slim = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = slim.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    found = sizes.count()
    if found > MOST_LANGUAGES:
        kept = [r["lang"] for r in sizes.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()]
        slim = slim.where(F.col("lang").isin(kept))
    counts = slim.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n"))
    dense = counts.groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("cells"))
    rows = dense.collect()
    rows.sort(key=lambda r: r["lang"])
    table = np.zeros((len(rows), BUCKETS))
    for own, row in zip(table, rows):
        for cell in row["cells"]:
            own[cell["bucket"]] = cell["n"]
    table = (table + SMOOTHING) / (table + SMOOTHING).sum(1, keepdims=True)
    return LanguageModel([r["lang"] for r in rows], table, max(0, found - MOST_LANGUAGES))


def _proportions(p: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, float]:
    """EM over the rows of p: proportions and log likelihood."""
    share = np.full(len(p), 1 / len(p))
    for _ in range(ROUNDS):
        part = share[:, None] * p
        new = (part / part.sum(0)) @ count / count.sum()
        if abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    return share, float(np.log(share @ p) @ count)


def identify(model: LanguageModel, text: str | None, penalty: float = PENALTY) -> tuple[list[tuple[str, float]], float]:
    """([(language, proportion)] from the largest, score). Nothing and 0 without a letter.

    The set starts with the likeliest single language and takes in the one that raises the
    likelihood fastest, as long as what it adds passes the penalty. The score is the main
    language's proportion times its posterior against the languages that were not selected.
    """
    grams = trigrams(text)
    if not len(grams) or not model.languages:
        return [], 0.0
    at, count = np.unique(grams, return_counts=True)
    p, count = model.probability[:, at], count.astype(float)
    alone = np.log(p) @ count
    chosen, total = [int(alone.argmax())], float(alone.max())
    share = np.ones(1)
    cost = penalty * np.log(1 + count.sum())
    while len(chosen) < len(p):
        slope = (p / (share @ p[chosen])) @ count
        slope[chosen] = -np.inf
        new = int(slope.argmax())
        if slope[new] <= count.sum():
            break
        new_share, new_total = _proportions(p[[*chosen, new]], count)
        if (new_total - total) / OVERLAP <= cost:
            break
        chosen, share, total = [*chosen, new], new_share, new_total
    order = sorted(range(len(chosen)), key=lambda k: (-share[k], chosen[k]))
    main = chosen[order[0]]
    others = [k for k in range(len(p)) if k == main or k not in chosen]
    odds = np.exp((alone[others] - alone[main]) / OVERLAP) if len(chosen) == 1 else np.ones(1)
    score = float(share[order[0]] / odds.sum())
    return [(model.languages[chosen[k]], float(share[k])) for k in order], min(max(score, 0.0), 1.0)


def identified(docs: DataFrame, model: LanguageModel, text_col: str = "text",
               penalty: float = PENALTY) -> DataFrame:
    """docs with __langs, an array of (lang, share) from the largest, __lang and __score.

    __lang is ``und`` with score 0 where the text is null or has no letter, or the model knows no
    language. Equal proportions and likelihoods go by code point of the language. Whole texts are
    read; repeated rows get equal answers; all columns of docs come through.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("langs array<struct<lang:string,share:double>>, lang string, score double")
    def answer(texts):
        import pandas as pd

        rows = []
        for text in texts:
            langs, score = identify(sent.value, text, penalty)
            rows.append(([{"lang": a, "share": b} for a, b in langs], langs[0][0] if langs else UNKNOWN, score))
        return pd.DataFrame(rows, columns=["langs", "lang", "score"])

    found = docs.withColumn("__found", answer(F.col(text_col).cast("string")))
    return found.withColumns({"__langs": F.col("__found.langs"), "__lang": F.col("__found.lang"),
                              "__score": F.col("__found.score")}).drop("__found")


def fold(id_col: str = "doc_id", folds: int = 3) -> Column:
    """0 to folds - 1 by the CRC-32 of the id as text; fold 1 is held out."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(F.encode(text, "UTF-8")), F.lit(folds))
