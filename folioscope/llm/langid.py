"""Language identification with bit-sliced Bloom filters of letter trigrams.

Every filter position holds one bit for each language, so reading a trigram's
positions and taking their AND gives the mask of all languages that hold the
trigram.  The number of a text's trigrams in each language's filter, less what
the filter's false positive rate explains, decides.

Defined results: a null text or one without a letter is ``und`` with score 0;
on a tie the first language in alphabetical order wins; without any training
row every text is ``und``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blank, bounded_batches, give_back, quoted

UNKNOWN = "und"
#: Expected bound of training documents of each language; of longer ones the share falls.
TRAIN_DOCS = 1500
#: Trigrams kept for each language; the share of its trigrams that one must have, and how much rarer than in another language one may be.
GRAMS, LEAST_PART, LEAST_SHARE = 6000, 6e-7, 0.25
#: Filter positions and hash functions; a position holds one word of bits for each 64 languages.
POSITIONS, HASHES, WORD_BITS = 1 << 17, 3, 64
#: Labelled values that may be languages; more are taken for a column that holds something else.
MOST_LANGUAGES = 4096
#: Letters handled at once, and trigrams counted at once.
BLOCK, COUNTED = 1 << 20, 1 << 22

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(x).isalpha() for x in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Hashes of all trigrams whose middle is a letter; everything else counts as a space.  In blocks, so memory is bounded."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, len(codes) - 2, BLOCK):
        part = codes[start : start + BLOCK + 2]
        part = np.where(_letters()[part], part, np.uint32(32)).astype(np.uint64)
        middle = np.flatnonzero(part[1:-1] != 32)
        x = part[middle] * _A + part[middle + 1] * _B + part[middle + 2] * _C
        x ^= x >> np.uint64(29)
        x *= _B
        yield x ^ (x >> np.uint64(32))


def positions(grams: np.ndarray) -> list[np.ndarray]:
    return [((grams >> np.uint64(20 * k)) % np.uint64(POSITIONS)).astype(np.int64) for k in range(HASHES)]


@dataclass
class LanguageFilters:
    """``slices[p]``: the languages, as bits, that have position ``p`` set."""

    languages: list[str]
    slices: np.ndarray
    false_positive: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> LanguageFilters:
        languages = sorted(grams)
        slices = np.zeros((-(-len(languages) // WORD_BITS), POSITIONS), np.uint64)
        for k, name in enumerate(languages):
            for at in positions(grams[name]):
                slices[k // WORD_BITS][at] |= np.uint64(1 << k % WORD_BITS)
        load = [float((slices[k // WORD_BITS] >> np.uint64(k % WORD_BITS) & np.uint64(1)).mean()) for k in range(len(languages))]
        return cls(languages, slices, np.array(load) ** HASHES)

    def hits(self, text: str) -> tuple[np.ndarray, int]:
        """Trigrams in each language's filter, and trigrams in all."""
        found, n = np.zeros(len(self.languages), np.int64), 0
        for grams in trigrams(text):
            first, *rest = positions(grams)
            for w, words in enumerate(self.slices):
                masks = words[first]
                for at in rest:
                    masks &= words[at]
                k = WORD_BITS * w
                found[k : k + WORD_BITS] += [int(np.count_nonzero(masks & np.uint64(1 << j))) for j in range(min(WORD_BITS, len(found) - k))]
            n += len(grams)
        return found, n

    def predict(self, text: str | None) -> tuple[str, float]:
        found, n = self.hits(text) if text and self.languages else (None, 0)
        if not n:
            return UNKNOWN, 0.0
        share = np.clip((found / n - self.false_positive) / (1 - self.false_positive), 0, 1)
        best = int(np.argmax(share))
        return self.languages[best], float(share[best])


def train(docs: DataFrame, rows: Column, text: str = "text", lang: str = "lang") -> LanguageFilters:
    """Filters from a bounded sample of the rows for which ``rows`` holds and a language is given.

    Trigrams are counted in Spark; only those frequent enough come to the driver.
    """
    bounded_batches(docs.sparkSession)
    labelled = docs.filter(rows & F.col(lang).isNotNull()).select("doc_id", F.col(lang).alias("lang"), blank(text).alias("t"))
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} values stand for languages")
    if not totals:
        return LanguageFilters([], np.zeros((0, POSITIONS), np.uint64), np.zeros(0))
    grain = 1 << 30
    few = {name: min(grain, int(grain * TRAIN_DOCS / n)) for name, n in totals.items()}
    cut = F.create_map(*(F.lit(x) for pair in few.items() for x in pair))[F.col("lang")]
    # the id only tells copies apart, so that a large group of them isn't chosen as a whole
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id", "t"), F.lit(grain)) < cut).select("lang", "t")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def counted(name: str, held: list[np.ndarray]) -> pd.DataFrame:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"lang": name, "gram": values.view(np.int64), "n": n.astype(np.int64)})

        for batch in batches:
            for name, texts in batch.groupby("lang")["t"]:
                held, n = [], 0
                for grams in (g for t in texts for g in trigrams(t)):
                    held.append(grams)
                    n += len(grams)
                    if n >= COUNTED:
                        yield counted(name, held)
                        held, n = [], 0
                if held:
                    yield counted(name, held)
        give_back()

    counts = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # ranked within each language, so one of few rows keeps its own
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    frequent = ranked.filter(F.col("place") <= 2 * GRAMS).drop("place").toPandas()
    frequent["share"] = frequent["n"] / frequent.groupby("lang")["n"].transform("sum")
    frequent = frequent[frequent["share"] >= LEAST_PART]
    frequent = frequent[frequent["share"] >= LEAST_SHARE * frequent.groupby("gram")["share"].transform("max")]
    kept = frequent.sort_values(["n", "gram"], ascending=[False, True]).groupby("lang").head(GRAMS)
    return LanguageFilters.build({name: g["gram"].to_numpy(np.int64).view(np.uint64) for name, g in kept.groupby("lang")})


def predict(docs: DataFrame, model: LanguageFilters, text: str = "text", into: str = "language") -> DataFrame:
    """Add struct column ``into``, in place of one of that name, with ``lang_pred`` and ``score``.

    The filters' size is fixed by the number of languages (1 MB for each 64), so they are broadcast.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])
        give_back()

    return docs.withColumn(into, predicted(blank(F.col(quoted(text)))))
