"""Language identification: words first, backing off to shorter and shorter character n-grams.

Fit: word counts per language over a bounded sample of labelled documents, the most frequent words of
each language (all languages have the same room, so a large one does not crowd out a small one), then n-gram counts
from those words. Score: a known word adds its log frequency in each language; an unseen word
adds the mean log frequency of its known n-grams of the longest size that has any. The score is
the posterior of the best language under equal priors.

Edge cases: a text that is null, empty or without a letter gets `und` and 0; a tie goes to the
language that sorts first; rows without a language are never learned from; with no labelled row
every text is `und`. Repeated rows are counted and answered as often as they occur.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benefactor.llm.common import fold_of, pick, share_below

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageIdParams:
    """Bounds of the fit; scoring reads whole texts of all rows."""

    docs_per_language: int = 4000  # expected number of sampled documents of each language
    max_words: int = 100_000  # learned (language, word) pairs, as many of each language
    least_words: int = 200  # of a language, however many languages there are
    sizes: tuple[int, ...] = (5, 4, 3, 2, 1)
    smoothing: float = 0.5
    cache_words: int = 200_000  # unseen words whose scores a worker remembers


@dataclass
class LanguageModel:
    languages: list[str]
    known: dict[str, int]  # word -> row of scores
    scores: np.ndarray  # log frequency by row and language
    grams: list[tuple[int, dict[str, int]]]  # by size, longest first: n-gram -> row of gram_scores
    gram_scores: np.ndarray
    cache_words: int = 200_000
    _index: dict[str, int] = field(default_factory=dict)
    _extra: list[np.ndarray] = field(default_factory=list)

    def _unseen(self, word: str) -> np.ndarray:
        padded = f"^{word}$"
        for size, rows in self.grams:
            own = [rows[g] for i in range(len(padded) - size + 1) if (g := padded[i : i + size]) in rows]
            if own:
                return self.gram_scores[own].mean(axis=0)
        return np.zeros(len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        counts = Counter(words)
        if not self.languages or not any(any(c.isalpha() for c in w) for w in counts):
            return UNKNOWN, 0.0
        rows, times, more = [], [], np.zeros(len(self.languages))
        known, index = self.known, self._index
        for word, n in counts.items():
            row = known.get(word)
            if row is not None:
                rows.append(row)
                times.append(n)
                continue
            place = index.get(word)
            if place is None:
                if len(index) >= self.cache_words:
                    index.clear()
                    self._extra.clear()
                place = index[word] = len(self._extra)
                self._extra.append(self._unseen(word))
            more = more + n * self._extra[place]
        total = more if not rows else more + np.asarray(times, float) @ self.scores[rows]
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.languages[best], float(odds[best] / odds.sum())


def _count_words(batches):
    for pdf in batches:
        totals: dict[str, Counter] = {}
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            totals.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        rows = [(lang, w, n) for lang, c in totals.items() for w, n in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "word", "n"])


def fit(labelled: DataFrame, params: LanguageIdParams = LanguageIdParams()) -> LanguageModel:
    """Learn from `labelled` (doc_id, text, lang); the sample is drawn by a hash of doc_id."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().collect()  # a row a language
    if not sizes:
        return LanguageModel([], {}, np.zeros((0, 0)), [], np.zeros((0, 0)))
    part = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, params.docs_per_language / r["count"]))])
    sample = rows.where(share_below(F.col("doc_id"), F.coalesce(part[F.col("lang")], F.lit(0.0)), 101))
    counts = (
        sample.select("lang", "text")
        .mapInPandas(_count_words, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
        .withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
        .where(F.col("nth") <= max(params.least_words, params.max_words // len(sizes)))
        .orderBy(F.desc("n"), "lang", "word")
        .toPandas()
    )
    languages = sorted({r["lang"] for r in sizes})
    place = {x: i for i, x in enumerate(languages)}
    columns = counts["lang"].map(place).to_numpy(int) if len(counts) else np.zeros(0, int)
    words = counts["word"].tolist()
    times = counts["n"].to_numpy(float)
    known: dict[str, int] = {}
    for w in words:
        known.setdefault(w, len(known))
    per_word = np.zeros((len(known), len(languages)))
    np.add.at(per_word, ([known[w] for w in words], columns), times)

    def logs(table: np.ndarray) -> np.ndarray:
        total = table.sum(axis=0) + params.smoothing * max(1, len(table))
        return np.log((table + params.smoothing) / total)

    grams, blocks, start = [], [], 0
    for size in params.sizes:
        rows_of: dict[str, int] = {}
        at, col, n = [], [], []
        for w, c, k in zip(words, columns.tolist(), times.tolist(), strict=True):
            padded = f"^{w}$"
            for i in range(len(padded) - size + 1):
                at.append(rows_of.setdefault(padded[i : i + size], len(rows_of)))
                col.append(c)
                n.append(k)
        block = np.zeros((len(rows_of), len(languages)))
        np.add.at(block, (at, col), n)
        blocks.append(logs(block))
        grams.append((size, {g: r + start for g, r in rows_of.items()}))
        start += len(rows_of)
    return LanguageModel(languages, known, logs(per_word), grams, np.concatenate(blocks), params.cache_words)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_words

    def score(batches):
        model = shared.value
        for pdf in batches:
            said = [model.predict(t) for t in pdf["text"]]
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"], "lang_pred": [s[0] for s in said], "score": [s[1] for s in said], "fold": pdf["fold"]}
            )

    return (
        docs.select("doc_id", "text", fold_of(F.col("doc_id")).alias("fold"))
        .mapInPandas(score, "doc_id long, lang_pred string, score double, fold long")
        .select("doc_id", (F.col("fold") == 2).alias("held_out"), "lang_pred", "score")
    )


def language_id(docs: DataFrame, params: LanguageIdParams = LanguageIdParams()) -> DataFrame:
    """Fit on the documents of folds 0, 1 and 3 and answer for all: doc_id, held_out, lang_pred, score."""
    rows = pick(docs, "doc_id", "text", "lang")
    model = fit(rows.where(fold_of(F.col("doc_id")) != 2), params)
    return identify(rows.select("doc_id", "text"), model)
