"""Best-fit packing of tokenised documents by hierarchical residual packing.

Items are dealt into bounded groups by a hash.  Each group is packed by
best-fit in decreasing order; bins that are nearly full are emitted, the rest
become items of the next round, dealt into fewer groups, until one bounded
group remains or a round no longer helps.

Defined results: a null or empty text is the end token alone; a document longer
than a sequence is cut, its full pieces fill sequences of their own; repeated
rows are packed once each.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import re
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank, bounded_batches, free_name, give_back, in_chunks, materialize, quoted
from .token_counts import tokenizer_path

SEQUENCE = 2048
#: Items that one group holds on average, and free tokens of a bin that count as nearly full.
GROUP, NEARLY = 20_000, 8
MOST_ROUNDS = 12
#: White space of the tokenizer at which a text may be cut without a change of its ids.
BREAKS = re.compile("[\t\r\n]")
#: Words that a worker keeps the ids of, and how many of them stay when it is full: those met first are the frequent ones.
CACHED, STAYING = 300_000, 120_000
#: Characters of a word that is not kept.
LONG = 64
#: Marks that stand around a word of letters as pre-tokens of their own; an apostrophe in front may join the word,
#: and those of special tokens are left out.
MARKS = "".join(c for c in string.punctuation if c not in "<|>")
LEADING = MARKS.replace("'", "")
#: A run of marks between a letter or digit and white space is a pre-token.
TAIL = re.compile(rf"[{re.escape(MARKS)}](?<=[^\W_].)[{re.escape(MARKS)}]*(?!\S)")
#: What keeps a text from being put in lower case as a whole: letters beyond the Latin ones, whose normal form or lower
#: case may differ, separators that only Python takes for white space, and the sign that special tokens begin with.
UNEVEN = re.compile("[^\x00-\x1b -\u012f\u0131-\u024f]|<\\|")


@functools.cache
def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Token ids of whole texts, as little-endian bytes, through a cache of the ids of space-free words.

    Latin texts are put in lower case first and the marks behind their words
    are split off, so fewer words differ.  Words of letters alone are encoded
    many at once: each is one pre-token, so an end-of-word token ends it.
    Other words are encoded one by one.
    """

    def __init__(self, path: str):
        self.encoder = _encoder(path)
        vocabulary = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {"": b""}

    def _encode(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, words: list[str]) -> None:
        for part in in_chunks(words, 2000):
            ids = np.array(self.encoder.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops, data = 4 * (np.flatnonzero(self.ends[ids]) + 1), ids.tobytes()
            self.cache.update(zip(part, (data[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist()))))

    def fill(self, words: set[str]) -> None:
        """Add what the cache lacks."""
        if len(self.cache) + 2 * len(words) > CACHED:
            self.cache = dict(itertools.islice(self.cache.items(), min(STAYING, len(self.cache))))
        cut = [(w, h, c) for w in words if plain(c := (h := w.rstrip(MARKS)).lstrip(LEADING))]
        self._letters(list({c for _, _, c in cut if c not in self.cache}))
        for word, front, core in cut:
            if word != core:
                head, tail = front[: len(front) - len(core)], word[len(front) :]
                for x in (head, tail):
                    if x not in self.cache:
                        self.cache[x] = self._encode(x)
                self.cache[word] = self.cache[head] + self.cache[core] + self.cache[tail]
        for word in words:
            if word not in self.cache:
                self.cache[word] = self._encode(word)
        # of long words no part stays either; the words themselves go when they have been read
        for word, front, core in cut:
            for x in (front[: len(front) - len(core)], core, word[len(front) :]):
                if len(x) > LONG and x not in words:
                    self.cache.pop(x, None)

    def of(self, text: str) -> bytes:
        words = BREAKS.sub(" ", text).split(" ") if UNEVEN.search(text) else TAIL.sub(r" \g<0>", text.lower()).split()
        found = list(map(self.cache.get, words))
        if None in found:
            at = [k for k, x in enumerate(found) if x is None]
            lacking = {words[k] for k in at}
            self.fill(lacking)
            for k in at:
                found[k] = self.cache[words[k]]
            for w in lacking:
                if len(w) > LONG:
                    del self.cache[w]
        return b"".join(found)


def plain(word: str) -> bool:
    """Letters alone, also after the tokenizer's normal form and lower case."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def token_pieces(docs: DataFrame, text: str = "text", tokenizer: str = "word_bpe_49k.json", end: int = 0, most: int = SEQUENCE) -> DataFrame:
    """``doc_id`` and every document's pieces of at most ``most`` ids, the end token included."""

    bounded_batches(docs.sparkSession)

    @F.pandas_udf(PIECES)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, last = WordIds(tokenizer_path(tokenizer)), np.array([end], "<u4").tobytes()
        for batch in batches:
            out = []
            for text in batch:
                found = ids.of(text) + last
                pieces = [found[at : at + 4 * most] for at in range(0, len(found), 4 * most)]
                out.append([{"piece": k, "start": k * most, "length": len(x) // 4, "ids_crc32": zlib.crc32(x)} for k, x in enumerate(pieces)])
            yield pd.Series(out)
        del ids
        give_back()

    return docs.select("doc_id", F.explode(cut(blank(text))).alias("p")).select("doc_id", "p.*")


def best_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and bin's fill of each item, by best-fit in decreasing order."""
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    free: list[int] = []
    open_bins: dict[int, list[int]] = {}
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        k = bisect.bisect_left(free, n)
        if k == len(free):
            b, room = len(fill), most
            fill.append(0)
        else:
            room = free[k]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                free.pop(k)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += n
        if room := room - n:
            if room not in open_bins:
                open_bins[room] = []
                bisect.insort(free, room)
            open_bins[room].append(b)
    return bin_of, offset, np.array(fill, np.int64)[bin_of] if len(lengths) else offset


def _round(items: DataFrame, groups: int, most: int) -> DataFrame:
    """Pack ``item, length`` in ``groups`` groups; a bin's id is that of its first item."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable").reset_index(drop=True)
        bins, offsets, fill = best_fit(pdf["length"].to_numpy(), most)
        heads = pdf["item"].to_numpy()[np.unique(bins, return_index=True)[1]] if len(pdf) else bins
        return pd.DataFrame({"item": pdf["item"], "bin": heads[bins] if len(pdf) else bins, "at": offsets, "fill": fill})

    dealt = items.withColumn("g", F.pmod(F.xxhash64("item", F.lit(groups)), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(pack, "item long, bin long, at long, fill long")


def pack(pieces: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (any columns with a ``length`` of at most ``most``).

    Other columns stay as they are, whatever their names.
    """
    item, others = free_name(pieces, "item"), [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = materialize(pieces.select(*map(quoted, others), F.monotonically_increasing_id().alias(item)), "pieces")
    waiting = pieces.filter(F.col("length") < most).select(F.col(item).alias("item"), "length")
    n, placed = waiting.count(), None
    for _ in range(MOST_ROUNDS):
        if not n:
            break
        groups = -(-n // GROUP)
        done = materialize(_round(waiting, groups, most), "packed")
        # where each piece stands, through all rounds so far
        if placed is None:
            placed = done.select("item", "bin", "at")
        else:
            step = done.select(F.col("item").alias("bin"), F.col("bin").alias("next"), F.col("at").alias("more"))
            placed = placed.join(step, "bin", "left").select("item", F.coalesce("next", "bin").alias("bin"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"))
        waiting = done.filter((F.col("at") == 0) & (F.col("fill") < most - NEARLY)).select(F.col("bin").alias("item"), F.col("fill").alias("length"))
        left = waiting.count()
        if groups == 1 or left > 0.98 * n:
            break
        n = left
    if placed is None:
        placed = waiting.select("item", F.col("item").alias("bin"), F.lit(0).cast("long").alias("at"))
    joined = pieces.alias("p").join(placed.alias("q"), F.col(f"p.{item}") == F.col("q.item"), "left")
    whole = [F.col(f"p.{quoted(c)}") for c in others]
    return joined.select(*whole, F.coalesce("q.bin", f"p.{item}").alias("sequence_id"), F.coalesce("q.at", F.lit(0)).cast("long").alias("offset"))
