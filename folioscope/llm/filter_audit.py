"""Filter interaction audit: what each of five filters removes, in every order they may be applied.

A table-driven transducer reads the bytes of a text once.  Bytes fall into
classes; the state after a byte says whether a word is open, and a table of
(state, class) says what is emitted there: a word's start or end, a code point,
a capital, a symbol.  The spans of words go into a hash table as they come:
open addressing by a polynomial hash, and a word is taken for one that is there
only after their bytes have been compared.  State and table are carried from
one piece of a long text to the next, so memory doesn't grow beyond the text
and its distinct words.  States and emissions of a piece are looked up for all
its bytes at once: a byte's class alone fixes the state after it.

A document then is a mask of the filters it fails.  Masks are counted for each
part before anything else, so the 120 orders are worked out on at most 32 rows
for each part, not on documents.

Defined results: a null text is empty; a null part is the empty string; repeated
rows count each time; a document without an id repeats no other, nor is it
repeated, and it has no labels; of several labels of an id any that is 1 counts;
an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, bounded_batches, give_back, materialize

# What the filters read.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"

FILTERS = "ABCDE"
#: Bytes that are read at once; short texts share a piece, longer ones take several.
PIECE = 1 << 18

# the transducer --------------------------------------------------------------------------------------------------------

#: Classes of bytes, and states after a byte.
SPACE, PLAIN, CAPITAL, SYMBOL, CONTINUED = range(5)
OUTSIDE, INSIDE = range(2)
#: What may be emitted at a byte.
STARTS, ENDS, POINT, UPPER, SIGN = (1 << k for k in range(5))

CLASS_OF = np.full(256, PLAIN, np.uint8)
CLASS_OF[list(SPACES)] = SPACE
CLASS_OF[list(CAPITALS)] = CAPITAL
CLASS_OF[list(SYMBOLS)] = SYMBOL
CLASS_OF[0x80:0xC0] = CONTINUED
NEXT = np.array([OUTSIDE, INSIDE, INSIDE, INSIDE, INSIDE], np.uint8)
EMITS = np.zeros((2, 5), np.uint8)
for _state in (OUTSIDE, INSIDE):
    for _class, _own in ((SPACE, POINT), (PLAIN, POINT), (CAPITAL, POINT | UPPER), (SYMBOL, POINT | SIGN), (CONTINUED, 0)):
        _turn = (ENDS if _state == INSIDE else 0) if _class == SPACE else (STARTS if _state == OUTSIDE else 0)
        EMITS[_state, _class] = _own | _turn
EMITS = EMITS.reshape(-1)

#: Multiplier of the words' hash (odd).
_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    at = 1
    while at < n:
        out[at : 2 * at] = out[: min(at, n - at)] * np.uint64(pow(base, at, 1 << 64))
        at *= 2
    return out


_UP = _powers(_BASE, PIECE + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), PIECE + 1)
#: Bytes of a lane that belong to a word of so many bytes.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(8)] + [_M64], np.uint64)


class WordTable:
    """A set of (text, word) pairs, words as spans of ``data``; ``add`` says which of the given ones are new.

    ``words`` are rows text, start, length and hash, a column for each word.
    """

    def __init__(self, data: np.ndarray):
        # eight bytes from any place on, as one number; the data has room for the last
        self.lanes = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        self.slots = np.full(1 << 10, -1, np.int64)
        self.n = 0
        self.words = np.empty((4, 1 << 9), np.int64)

    def _home(self, words: np.ndarray) -> np.ndarray:
        x = words[3].view(np.uint64) + words[0].view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) & np.uint64(len(self.slots) - 1)).view(np.int64)

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words are of one text and equal, byte by byte."""
        equal = (a[0] == b[0]) & (a[3] == b[3]) & (a[2] == b[2])
        at = np.flatnonzero(equal)
        lane = 0
        while len(at):
            left = np.minimum(a[2, at] - lane, 8)
            apart = ((self.lanes[a[1, at] + lane] ^ self.lanes[b[1, at] + lane]) & _LANE[left]) != 0
            equal[at[apart]] = False
            lane += 8
            at = at[~apart & (a[2, at] > lane)]
        return equal

    def _place(self, words: np.ndarray) -> np.ndarray:
        """Give words their slots, numbered on from those held; which of them weren't there."""
        slot, mask, n = self._home(words), len(self.slots) - 1, self.n
        number = n + np.arange(words.shape[1])
        new, left = np.zeros(words.shape[1], bool), np.arange(words.shape[1])
        while len(left):
            s = slot[left]
            free = self.slots[s] < 0
            # several may claim a slot; one of them has it
            self.slots[s[free]] = number[left[free]]
            holder = self.slots[s]
            own = holder == number[left]
            new[left[own]] = True
            left, s, holder = left[~own], s[~own], holder[~own]
            there, held = np.empty((4, len(left)), np.int64), holder < n
            there[:, held] = self.words[:, holder[held]]
            there[:, ~held] = words[:, holder[~held] - n]
            other = ~self._same(words[:, left], there)
            left = left[other]
            slot[left] = (s[other] + 1) & mask
        self.slots[slot[new]] = n + np.arange(int(new.sum()))
        return new

    def add(self, words: np.ndarray) -> np.ndarray:
        if 2 * (self.n + words.shape[1]) > len(self.slots):
            self.slots = np.full(1 << int(2 * (self.n + words.shape[1])).bit_length(), -1, np.int64)
            held, self.n = self.words[:, : self.n], 0
            self._place(held)
            self.n = held.shape[1]
        new = self._place(words)
        fresh = words[:, new]
        if self.n + fresh.shape[1] > self.words.shape[1]:
            grown = np.empty((4, 2 * (self.n + fresh.shape[1])), np.int64)
            grown[:, : self.n] = self.words[:, : self.n]
            self.words = grown
        self.words[:, self.n : self.n + fresh.shape[1]] = fresh
        self.n += fresh.shape[1]
        return new


def read_texts(texts: list[bytes]) -> np.ndarray:
    """Columns words, distinct words, capitals, code points and symbols, a row for each text."""
    out = np.zeros((len(texts), 5), np.int64)
    group: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        if group and size + len(text) + 1 > PIECE:
            _read_group(texts, group, out)
            group, size = [], 0
        group.append(k)
        size += len(text) + 1
    if group:
        _read_group(texts, group, out)
    return out


def _read_group(texts: list[bytes], group: list[int], out: np.ndarray) -> None:
    """Texts side by side, a space behind each, piece by piece."""
    n = sum(len(texts[k]) + 1 for k in group)
    data = np.frombuffer(b" ".join([*(texts[k] for k in group), b"       "]), np.uint8)
    ends = np.cumsum([len(texts[k]) + 1 for k in group])
    table = WordTable(data)
    inside, start, partial = False, 0, 0
    for a in range(0, n, PIECE):
        piece = data[a : min(n, a + PIECE)]
        kind = CLASS_OF[piece]
        after = NEXT[kind]
        before = np.empty_like(after)
        before[0], before[1:] = inside, after[:-1]
        emitted = EMITS[before * 5 + kind]
        # of each text in this piece
        whose = np.searchsorted(ends, a, "right"), np.searchsorted(ends, a + len(piece) - 1, "right")
        texts_here = np.arange(whose[0], whose[1] + 1)
        cuts = np.maximum(np.concatenate(([0], ends[texts_here[:-1]] - a)), 0)
        rows = np.asarray(group)[texts_here]
        for column, sign in ((2, UPPER), (3, POINT), (4, SIGN)):
            out[rows, column] += np.add.reduceat((emitted & sign) > 0, cuts, dtype=np.int64)
        begun, ended = np.flatnonzero(emitted & STARTS), np.flatnonzero(emitted & ENDS)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(piece * _UP[: len(piece)], dtype=np.uint64)))
        heads = np.concatenate(([0], begun)) if inside else begun
        tails = heads[len(ended) :]
        heads = heads[: len(ended)]
        hashed = (sums[ended] - sums[heads]) * _DOWN[heads]
        starts = heads + a
        if inside and len(ended):
            hashed[0] = (partial + int(hashed[0]) * pow(_BASE, a - start, 1 << 64)) & _M64
            starts[0] = start
        if len(ended):
            text = np.searchsorted(ends, starts, "right")
            new = table.add(np.stack((text, starts, ended + a - starts, hashed.view(np.int64))))
            out[np.asarray(group), 0] += np.bincount(text, minlength=len(group))
            out[np.asarray(group), 1] += np.bincount(text[new], minlength=len(group))
        if len(tails):
            own = (int(sums[-1]) - int(sums[tails[0]])) * int(_DOWN[tails[0]])
            carried = inside and not len(ended)
            partial = (partial + own * pow(_BASE, a - start, 1 << 64)) & _M64 if carried else own & _M64
            start = start if carried else int(tails[0]) + a
        inside = bool(after[-1])
    # the space behind each text
    out[np.asarray(group), 3] -= 1


def measured(docs: DataFrame, text: str = "text") -> Column:
    """A struct ``n_words, n_distinct, n_capitals, n_points, n_symbols`` of a text."""
    bounded_batches(docs.sparkSession)
    names = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(read_texts(texts.tolist()), columns=list(names))
        give_back()

    return read(blank(text).cast("binary"))


# the audit -------------------------------------------------------------------------------------------------------------


def fails(m: str) -> list[Column]:
    """The conditions of A to D on the struct ``m``."""
    c = lambda x: F.col(f"{m}.{x}")
    return [c("n_words") < 200, c("n_distinct") * 100 < c("n_words") * 50, c("n_capitals") * 100 > c("n_points") * 2, c("n_symbols") > 0]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic``: a row for each document; bit k of the mask is set where it fails filter k.

    Equal texts meet by their SHA-256, as ids and digests: the text itself goes
    to the transducer and no further.
    """
    bits = lambda tests: sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(blank("text").cast("binary"), 256)).alias("digest"), measured(docs).alias("m"))
    read = materialize(read.select("doc_id", "part", "digest", bits(fails("m")).cast("int").alias("mask")), "measured")
    first = read.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    seen = read.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).alias("mask"))
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marked = labels.groupBy("doc_id").agg(one("quality"), one("toxic"))
    return seen.join(marked, "doc_id", "left").select("part", "mask", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def orders() -> list[dict[str, object]]:
    """Every order of the filters, step by step: the step's filter and those before it, as bits."""
    found = []
    for order in permutations(range(len(FILTERS))):
        for step, k in enumerate(order):
            found.append({"filter_order": "".join(FILTERS[x] for x in order), "step": step + 1, "own": 1 << k, "before": sum(1 << x for x in order[:step])})
    return found


def audit(found: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from ``part, mask, good, toxic`` of documents.

    A document that fails m filters is removed by each of them in the same share
    of all orders, those in which it stands before the other m - 1.
    """
    counted = found.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    table = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    # 600 rows for each of a part's masks, of which there are 32 at most
    each = counted.select("*", F.inline(table))
    hit, past = F.col("mask").bitwiseAND(F.col("own")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    total = lambda test, c: F.sum(F.when(test, F.col(c)).otherwise(0))
    share = (F.lit(math.factorial(len(FILTERS))) / F.bit_count("mask")).cast("long")
    return each.groupBy("part", "filter_order", "step").agg(
        total(~hit & ~past, "n").alias("kept"), total(hit & ~past, "n").alias("removed"), total(hit & past, "n").alias("redundant"),
        total(F.col("mask") == F.col("own"), "n").alias("unique_fails"), total(hit & ~past, "good").alias("good_lost"), total(hit & ~past, "toxic").alias("toxic_lost"),
        F.sum(F.when(hit, F.col("n") * share).otherwise(0)).alias("shapley"),
    )
