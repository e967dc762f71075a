"""Exact token counts without shuffling pre-tokens.

A two-tier lookup inside map tasks: first a broadcast table of the lengths of
frequent pre-tokens, then a bounded cache in each worker that encodes what the
table lacks.  The table is only a cache; it never changes a count.

A piece of this vocabulary holds the space mark only in front and never a line
feed, so no merge crosses from a non-space to a space, or a line feed: a text
may be cut at those places and the lengths of the cuts added.

Defined results: null and empty texts have 0 tokens.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, blank, bounded_batches, give_back, hash_sample

#: Bound of the warm-up sample, in documents and in bytes of one, and of the frequent tier.
SAMPLE_DOCS, SAMPLE_BYTES = 2048, 1 << 16
PER_PARTITION = 8192
FREQUENT = 32_768
#: Cuts that a worker keeps the lengths of.
CACHED = 600_000
#: Bound in bytes of what is broadcast.
BROADCAST_BYTES = 8 << 20

MARK = "▁"
#: Runs of spaces; a text that has any is cut before each run.
RUNS = re.compile(r" *[^ ]+| +$")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def pre_tokens(text: str) -> list[str]:
    """Cuts of a text, each without the one space mark that the encoder puts in front.

    A cut at a line feed has no such mark; it begins with the line feed.  Where
    spaces stand in runs, at an end or before a line feed, cuts are made before
    runs of spaces only, and such a cut keeps all its spaces.
    """
    text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
        return RUNS.findall(" " + text)
    return text.replace("\n", " \n").split(" ")


def token_length(encoder, cut: str) -> int:
    if cut[0] == " ":
        return len(encoder.encode(cut[1:])) if len(cut) > 1 else 1
    return len(encoder.encode(cut)) - (cut[0] == "\n")


def frequent_table(docs: DataFrame, text: str, model: str) -> tuple[bytes, np.ndarray]:
    """The frequent pre-tokens of a bounded sample, as one blob and their lengths.

    Each task counts its own part of the sample, so no pre-token is shuffled;
    at most ``SAMPLE_DOCS`` documents' pre-tokens come to the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for x in batch["t"]:
                seen.update(w for w in pre_tokens(x) if len(w) <= 64 and "\x00" not in w)
        top = seen.most_common(PER_PARTITION)
        if top:
            yield pd.DataFrame({"w": [w for w, _ in top], "n": [n for _, n in top]})

    texts = docs.select("doc_id", blank(text).alias("t"))
    sample = hash_sample(texts, ("doc_id", "t"), SAMPLE_DOCS, docs.count()).select("t").filter(F.octet_length("t") <= SAMPLE_BYTES)
    seen: Counter[str] = Counter()
    for w, n in sample.mapInPandas(count, "w string, n long").collect():
        seen[w] += n
    encoder = _pieces(tokenizer_path(model))
    words = [w for w, _ in seen.most_common(FREQUENT)]
    lengths = np.array([token_length(encoder, w) for w in words], np.uint16)
    return "\x00".join(words).encode("utf-8", "surrogatepass"), lengths


def count_tokens(docs: DataFrame, text: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text."""
    bounded_batches(docs.sparkSession)
    blob, lengths = frequent_table(docs, text, model)
    if len(blob) + lengths.nbytes > BROADCAST_BYTES:
        raise ValueError("the table of frequent pre-tokens exceeds its bound")
    table = docs.sparkSession.sparkContext.broadcast((blob, lengths))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, sizes = table.value
        encoder = _pieces(tokenizer_path(model))
        known = zip(words.decode("utf-8", "surrogatepass").split("\x00"), sizes.tolist())
        cache = BoundedCache(lambda w: token_length(encoder, w), CACHED, known if len(sizes) else ())
        for batch in batches:
            yield batch.map(lambda x: sum(map(cache.__getitem__, pre_tokens(x)))).astype("int64")
        del cache, known
        give_back()

    whole = blank(text)
    return docs.select("doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), counted(whole).alias("n_tokens"))
