"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over hashed features is trained in numpy from confirmed toxic
documents (positives) and plain documents of unknown label (unlabelled), over the features whose
rates in the two differ clearly. A document's features are its words, and the stems (first bytes of longer
words) that make up a good part of its words: they tell of a vocabulary whose single words are too rare to learn. With the class prior
p, positive risk P+ (loss of calling positives positive), P- (of calling them negative) and
unlabelled risk U-, the estimate is  p * P+ + max(0, U- - p * P-).  Where the second term falls
below zero, the step lowers its size instead, which keeps a flexible model from calling every
unlabelled text negative.

Edge cases: a null or empty text has no words and gets the score of the bias alone; without
a toxic training row, every score is 0; a document with both labels counts as toxic; null labels
are ignored. Repeated rows are scored as often as they occur.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from benefactor.llm import hashing
from benefactor.llm.common import cut_lineage, fold_of, pick, share_below, utf8


@dataclass(frozen=True)
class ToxicityParams:
    """Bounds of the fit; scoring reads whole texts of all rows."""

    max_positive: int = 4000  # expected sampled toxic documents
    max_unlabelled: int = 12_000  # expected sampled documents of unknown label
    bits: int = 18  # the features are the upper bits of the word hashes
    stem: int = 5  # bytes of a stem, of words that are longer
    stem_share: int = 128  # a stem counts if it has two words and one in so many
    max_bytes: int = 64 << 20  # of sampled features, collected to the driver
    min_z: float = 4.5  # features whose rates among positives and unlabelled differ by fewer standard errors are left out
    steps: int = 300
    rate: float = 0.05
    decay: float = 3e-4
    threshold: float = 0.3


def _features(data: np.ndarray, bounds: np.ndarray, params: ToxicityParams):
    """The feature slots of each document, sorted."""
    shift = np.uint64(64 - params.bits)
    for a, b in hashing.batches(bounds):
        part, own = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        words, first = hashing.word_hashes(part, own, hashing.NO_ALNUM)
        stems, _ = hashing.word_hashes(part, own, hashing.NO_ALNUM, params.stem)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            stem, times = np.unique(stems[i:j][stems[i:j] != words[i:j]], return_counts=True)
            often = hashing.mix(stem[(times > 1) & (times * params.stem_share >= j - i)])
            yield np.unique((np.concatenate([words[i:j], often]) >> shift).astype(np.int32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _csr(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    return rows, np.concatenate(docs) if docs else np.zeros(0, np.int64)


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, params: ToxicityParams) -> tuple[np.ndarray, float]:
    """Weights by feature slot and the bias."""
    size = 1 << params.bits
    n_p, n_u = len(positive), len(unlabelled)
    in_p = np.bincount(np.concatenate(positive), minlength=size)
    in_u = np.bincount(np.concatenate(unlabelled), minlength=size)
    rate = (in_p + in_u) / (n_p + n_u)
    error = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n_p + 1 / n_u))
    used = np.flatnonzero((in_p + in_u > 0) & (np.abs(in_p / n_p - in_u / n_u) >= params.min_z * error))
    column = np.full(size, -1)
    column[used] = np.arange(len(used))

    def packed(docs):
        own = [column[d] for d in docs]
        return _csr([c[c >= 0] for c in own])

    (pr, pc), (ur, uc) = packed(positive), packed(unlabelled)
    k = len(used)
    w = np.zeros(k + 1)
    w[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros(k + 1), np.zeros(k + 1)

    def gradient(rows, cols, by_doc):
        g = np.empty(k + 1)
        g[:-1] = np.bincount(cols, by_doc[rows], k)
        g[-1] = by_doc.sum()
        return g

    for step in range(1, params.steps + 1):
        zp = np.bincount(pr, w[pc], n_p) + w[-1]
        zu = np.bincount(ur, w[uc], n_u) + w[-1]
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        rest_p, rest_u = -prior * sp / n_p, su / n_u  # gradient of U- minus p * P-
        if negative >= 0:
            g = gradient(pr, pc, prior * (sp - 1) / n_p + rest_p) + gradient(ur, uc, rest_u)
        else:
            g = -(gradient(pr, pc, rest_p) + gradient(ur, uc, rest_u))
        g[:-1] += params.decay * w[:-1]
        mean = 0.9 * mean + 0.1 * g
        square = 0.999 * square + 0.001 * g * g
        w -= params.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[used] = w[:-1]
    # few features cannot tell the positives that lack them, and the bias makes up for it; a text
    # without any feature is no more likely positive than the class is
    return weights, float(min(w[-1], np.log(prior / (1 - prior))))


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> tuple[np.ndarray, float] | None:
    """Learn from `docs` (doc_id, text) and `labels` (doc_id, toxic); None without a toxic row.

    The samples are drawn by a hash of doc_id; the ids of the positives, at most about
    `max_positive`, are broadcast, so that the texts are read once and not shuffled.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    rows = docs.count()
    if not toxic or not rows:
        return None
    prior = min(0.95, max(0.001, toxic / total))
    ids = known.where((F.col("toxic") == 1) & share_below(F.col("doc_id"), min(1.0, params.max_positive / toxic), 211))
    ids = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in ids.select("doc_id").collect()], "pos_id long")
    sample = (
        docs.where(F.col("text").isNotNull())
        .join(F.broadcast(ids), F.col("doc_id") == F.col("pos_id"), "left")
        .withColumn("unlabelled", share_below(F.col("doc_id"), min(1.0, params.max_unlabelled / rows), 223))
        .where("pos_id is not null or unlabelled")
        .select("text", F.col("pos_id").isNotNull().alias("positive"), "unlabelled")
    )

    def extract(batches):
        for batch in batches:
            found = [f.tobytes() for f in _features(*utf8(batch.column(0)), params)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.binary())], ["positive", "unlabelled", "slots"])

    features = cut_lineage(sample.mapInArrow(extract, "positive boolean, unlabelled boolean, slots binary"))
    size = features.agg(F.coalesce(F.sum(F.octet_length("slots")), F.lit(0))).first()[0]
    if size > params.max_bytes:  # very long texts: fewer of them, by a hash of what they say
        features = features.where(share_below(F.col("slots"), params.max_bytes / size, 227))
    got = features.distinct().collect()
    # equal texts count once: a copied document says nothing more about its words
    positive = [np.frombuffer(s, np.int32) for s in sorted({bytes(r["slots"]) for r in got if r["positive"]})]
    unlabelled = [np.frombuffer(s, np.int32) for s in sorted({bytes(r["slots"]) for r in got if r["unlabelled"]})]
    if not positive or not unlabelled:
        return None
    return train_nnpu(positive, unlabelled, prior, params)


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The columns of `docs` (one of them `text`) and `score`, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats
    names = docs.columns
    at = names.index("text")

    def run(batches):
        model = shared.value
        for batch in batches:
            if model is None:
                scores = np.zeros(batch.num_rows)
            else:
                weights, bias = model
                scores = _sigmoid(np.array([weights[f].sum(dtype=float) for f in _features(*utf8(batch.column(at)), params)]).reshape(-1) + bias)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Fit on folds 0, 1 and 3, answer for all: doc_id, held_out, score, predicted."""
    rows = pick(docs, "doc_id", "text")
    fold = fold_of(F.col("doc_id"))
    model = fit(rows.where(fold != 2), pick(labels, "doc_id", "toxic").where(fold != 2), params)
    scored = score(rows, model, params)
    return scored.select(
        "doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= params.threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier accepts.

    Here the folds play no part: all labels may be learned from.
    """
    rows = pick(docs, "doc_id", "text")
    model = fit(rows, pick(labels, "doc_id", "toxic"), params)
    names = list(docs.columns)
    plain = docs.toDF(*[n if n in ("doc_id", "text") and names.index(n) == i else f"__c{i}" for i, n in enumerate(names)])
    kept = score(plain, model, params).where(F.col("score") < params.threshold).drop("score")
    return kept.toDF(*names)
