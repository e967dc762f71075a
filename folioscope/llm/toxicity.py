"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence gets a probability from a
logistic model of its words; the document's probability is their noisy-or,
``1 - prod(1 - p)``.  Only document labels are used to train, so the sentence
scores learn by themselves where the offence stands, and locate it.

Defined results: null and empty texts, and texts without a word, score 0; if
the labels hold only one class, or none, every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, blank, bounded_batches, give_back, hash_sample

#: Expected bound of the labelled documents that the model is fitted on.
TRAIN_DOCS = 5000
#: Bytes of a text beyond which it isn't taken for the fit, so the sample is bounded in bytes too.
TRAIN_BYTES = 1 << 16
#: Words are hashed to so many features; one must stand in so many documents to count.
FEATURES, LEAST_DOCS = 1 << 20, 4
STEMS = (4, 5)
STEPS, RATE, SPARSE = 60, 0.3, 4e-4
#: Words of a sentence at most; what has no full stop is cut, so a sentence stays a passage.
LONGEST = 64
#: Most nonzero weights, which bounds what is broadcast.
MOST_WEIGHTS = 200_000

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def features_of(word: str) -> tuple[int, ...]:
    """The hashed word and, for longer words, its stems of each of the lengths in ``STEMS``."""
    names = [word, *(f"^{word[:n]}" for n in STEMS if len(word) > n)]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) & (FEATURES - 1) for x in names)


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and words of each sentence."""
    for found in SENTENCE.finditer(text):
        words = WORD.findall(found[0].lower())
        if len(words) <= LONGEST:
            if words:
                yield found.start(), found.end(), words
            continue
        spans = [(m.start(), m.end()) for m in WORD.finditer(found[0])]
        for k in range(0, len(spans), LONGEST):
            a, b = found.start() + spans[k][0], found.start() + spans[min(k + LONGEST, len(spans)) - 1][1]
            yield a, b, WORD.findall(text[a:b].lower())


@dataclass
class BagModel:
    bias: float
    weights: dict[int, float]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: BagModel):
        self.bias = model.bias
        self.weight = BoundedCache(lambda w: sum(model.weights.get(f, 0.0) for f in features_of(w)), 300_000)

    def logits(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        spans, z = [], []
        for start, end, words in sentences(text):
            spans.append((start, end))
            z.append(self.bias + sum(map(self.weight.__getitem__, set(words))))
        return spans, np.array(z)

    def score(self, text: str, least: float = 0.5) -> tuple[float, list[dict]]:
        """The document's noisy-or, and its sentences of at least ``least``."""
        spans, z = self.logits(text)
        if not spans:
            return 0.0, []
        found = np.flatnonzero(z >= np.log(least / (1 - least)))
        offending = [{"start": spans[k][0], "end": spans[k][1], "p": float(1 / (1 + np.exp(-z[k])))} for k in found]
        return float(-np.expm1(-np.logaddexp(0, z).sum())), offending


def fit(words: np.ndarray, sentence: np.ndarray, document: np.ndarray, label: np.ndarray) -> BagModel:
    """Fit by full-batch Adam with soft thresholding.

    ``words[i]`` is a feature of sentence ``sentence[i]``; ``document[s]`` is the
    bag of sentence ``s``; all are sorted by bag.
    """
    if len(words) == 0 or label.min() == label.max():
        return BagModel(-50.0, {})
    docs_of = np.unique(np.stack([words, document[sentence]]), axis=1)[0]
    enough = np.bincount(docs_of, minlength=FEATURES) >= LEAST_DOCS
    kept = enough[words]
    names, local = np.unique(words[kept], return_inverse=True)
    rows, n_sent, n_docs = sentence[kept], len(document), len(label)
    positive = label == 1
    share = positive.mean()
    per_bag = max(1.0, n_sent / n_docs)
    w, b = np.zeros(len(names)), float(np.log(share / per_bag))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = b + np.bincount(rows, w[local], n_sent)
        total = np.bincount(document, np.logaddexp(0, z), n_docs)
        outer = np.where(positive, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0) / n_docs
        grad_z = outer[document] / (1 + np.exp(-np.clip(z, -50, 50)))
        g, gb = np.bincount(local, grad_z[rows], len(names)), grad_z.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        up, down = 1 - 0.9**step, 1 - 0.99**step
        scale = RATE / (np.sqrt(v / down) + 1e-4)
        w -= scale * m / up
        w = np.sign(w) * np.maximum(np.abs(w) - SPARSE * scale, 0)
        b -= 0.3 * RATE * (mb / up) / (np.sqrt(vb / down) + 1e-8)
    strong = np.argsort(-np.abs(w))[:MOST_WEIGHTS]
    return BagModel(b, {int(names[i]): float(w[i]) for i in strong if w[i]})


def train(docs: DataFrame, labels: DataFrame, rows: Column, text: str = "text") -> BagModel:
    """Fit on a bounded sample of the labelled documents for which ``rows`` holds."""
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & rows).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = hash_sample(known, ("doc_id",), TRAIN_DOCS, known.count())
    short = docs.select("doc_id", blank(text).alias("t")).filter(F.octet_length("t") <= TRAIN_BYTES)
    texts = short.join(sample, "doc_id").select("t", "toxic")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cached = BoundedCache(features_of)
        for batch in batches:
            out = []
            for t, toxic in zip(batch["t"], batch["toxic"]):
                bags = [[f for w in set(words) for f in cached[w]] for _, _, words in sentences(t)]
                out.append((int(toxic), [len(x) for x in bags], [f for x in bags for f in x]))
            if out:
                yield pd.DataFrame(out, columns=["toxic", "sizes", "words"])

    got = texts.mapInPandas(features, "toxic int, sizes array<int>, words array<int>").toArrow().to_pandas()
    got = got[got["sizes"].map(len) > 0]
    if got.empty:
        return BagModel(-50.0, {})
    sizes = np.concatenate(got["sizes"].to_list()).astype(np.int64)
    document = np.repeat(np.arange(len(got)), got["sizes"].map(len))
    words = np.concatenate(got["words"].to_list()).astype(np.int64)
    return fit(words, np.repeat(np.arange(len(sizes)), sizes), document, got["toxic"].to_numpy())


def score_documents(docs: DataFrame, model: BagModel, text: str = "text", locate_from: float = 0.5) -> DataFrame:
    """``doc_id, score, offending``: the noisy-or score and the sentences of at least ``locate_from``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, offending array<struct<start:int,end:int,p:double>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = shared.value.scorer()
        for batch in batches:
            yield pd.DataFrame([scorer.score(t, locate_from) for t in batch], columns=["score", "offending"])
        del scorer
        give_back()

    return docs.select("doc_id", scored(blank(text)).alias("s")).select("doc_id", "s.*")
