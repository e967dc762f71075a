"""Benchmark decontamination by SimHash over item-sized windows.

For each benchmark item every window of a document with as many words as the
item has is a candidate.  A window is kept where enough of its shingles occur
in items of that length for a similarity of ``SIMILARITY`` to be possible (a
sound bound, no heuristic).  Fingerprints of kept windows meet those of items
of the same length in a multi-index of Hamming blocks, which by the pigeonhole
principle returns every pair within ``RADIUS`` bits; the exact weighted Jaccard
similarity of the shingles, with repeats as weights, decides.  Of pairs at the
least similarity two in a thousand differ in more bits than ``RADIUS`` (measured
by a test), of closer ones fewer.  Items of fewer shingles than ``SHORT`` would lose
more (four against five shingles: 4.5 %), so their windows meet them by a shared
shingle instead, one of the rarest that any match must have some of: none is lost.

Defined results: null and empty texts and items match nothing; a text or item
of fewer words than a shingle is one shingle (such an item matches only whole
texts of as many words); a text shorter than an item is compared as a whole, and
its window has the item's n_words; of several matches the most
similar is reported, on ties the least item, then the first window; rows are
told apart by their id and text, so a row without an id is judged too, and of
rows that share an id each is judged by itself (equal rows are one).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BoundedCache, blank, bounded_batches, free_name, give_back, materialize, temporary_tables, text_key

WORDS, SIMILARITY = 5, 0.8
#: Bits that differ at most; blocks of the index as start and width, so some block differs by RADIUS // len(BLOCKS) bits at most.
RADIUS, BLOCKS = 17, ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Items of fewer shingles are found by their rarest shingles, not by fingerprints.
SHORT = 30
#: Bytes of benchmark shingles that are broadcast at once; beyond it the items are searched for in parts.
BROADCAST_BYTES = 32 << 20

WORD = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
POWERS = [np.uint64(pow(int(_P), WORDS - 1 - k, 1 << 64)) for k in range(WORDS)]


def _word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)


def word_hashes(text: str, cache: dict) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash for each five words in a row; fewer words are one shingle."""
    n = len(words) - WORDS + 1
    if len(words) == 0:
        return words
    if n < 1:
        x = np.array([0], np.uint64)
        for w in words:
            x = x * _P + w + np.uint64(1)
    else:
        x = sum(words[k : k + n] * POWERS[k] for k in range(WORDS))
    x = (x ^ (x >> np.uint64(31))) * _Q
    return x ^ (x >> np.uint64(29))


def bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def pack_bits(rows: np.ndarray) -> np.ndarray:
    return np.packbits(rows, axis=1, bitorder="little").view(np.uint64).ravel()


def item_table(benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``item_id, n_words, fp, grams`` of every item with a word."""

    def read(texts: pd.Series) -> pd.DataFrame:
        cache, rows = BoundedCache(_word_hash), []
        for t in texts:
            words = word_hashes(t, cache)
            grams = shingles(words)
            fp = pack_bits((bits(grams).sum(axis=0, dtype=np.int64) * 2 > len(grams))[None, :])[0] if len(grams) else np.uint64(0)
            rows.append((len(words), int(np.uint64(fp).view(np.int64)), grams.view(np.int64).tolist()))
        return pd.DataFrame(rows, columns=["n_words", "fp", "grams"])

    read_items = F.pandas_udf(read, "n_words int, fp bigint, grams array<bigint>")
    return benchmark.select("item_id", read_items(blank(text)).alias("x")).select("item_id", "x.*").filter("n_words > 0")


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


class Windows:
    """Finds a document's windows that may be similar to an item."""

    def __init__(self, by_length: dict[int, np.ndarray]):
        self.by_length = by_length
        self.grams = grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *by_length.values()]))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(grams >> np.uint64(44)).astype(np.int64)] = True
        self.cache = BoundedCache(_word_hash, 200_000)

    def known(self, x: np.ndarray) -> np.ndarray:
        """Positions of shingles that are in the benchmark at all."""
        at = np.flatnonzero(self.filter[(x >> np.uint64(44)).astype(np.int64)])
        return at[among(x[at], self.grams)] if len(at) else at

    def of(self, text: str) -> list[dict]:
        """Stretches of the text's shingles that kept windows cover, each once, and the windows in them."""
        words = word_hashes(text, self.cache)
        grams = shingles(words)
        if len(grams) == 0:
            return []
        at_all, found = self.known(grams), []
        for n, own in self.by_length.items() if len(at_all) else ():
            own_m = max(1, n - WORDS + 1)
            # a text shorter than the item is a window as a whole
            m = min(own_m, len(grams))
            if m < own_m * SIMILARITY - 1e-9 or (n != len(words) and min(n, len(words)) < WORDS):
                continue
            # |A n B| / (a + b - |A n B|) >= s needs |A n B| >= s (a + b) / (1 + s)
            least = int(np.ceil((m + own_m) * SIMILARITY / (1 + SIMILARITY) - 1e-9))
            hit = at_all[among(grams[at_all], own)]
            if len(hit) < least:
                continue
            flags = np.zeros(len(grams) + 1, np.int64)
            flags[hit + 1] = 1
            seen = np.cumsum(flags)
            starts = np.flatnonzero(seen[m:] - seen[:-m] >= least)
            for part in range(0, len(starts), 4096):
                at = starts[part : part + 4096]
                found += [(a, a + m, n, f) for a, f in zip(at.tolist(), self._fingerprints(grams, at, m).tolist())]
        out: list[dict] = []
        end = -1
        for a, b, n, f in sorted(found):
            if a >= end:
                out.append({"first": a, "end": b, "windows": []})
            out[-1]["end"] = end = max(end, b) if a < end else b
            out[-1]["windows"].append({"start": a, "stop": b, "n_words": n, "fp": f})
        for x in out:
            x["grams"] = grams[x["first"] : x.pop("end")].view(np.int64)
        return out

    @staticmethod
    def _fingerprints(grams: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
        """SimHash of each window, by differences of running sums over the span that the starts cover."""
        fps, group = [], np.flatnonzero(np.diff(starts) > m) + 1
        for at in np.split(starts, group):
            lo, hi = at[0], at[-1] + m
            run = np.zeros((hi - lo + 1, 64), np.int32)
            np.cumsum(bits(grams[lo:hi]), axis=0, out=run[1:], dtype=np.int32)
            fps.append(pack_bits((run[at - lo + m] - run[at - lo]) * 2 > m))
        return np.concatenate(fps).view(np.int64)


STRETCHES = "array<struct<first:int,windows:array<struct<start:int,stop:int,n_words:int,fp:bigint>>,grams:array<bigint>>>"


def in_parts(items: DataFrame) -> tuple[DataFrame, int]:
    """``items`` with the part each is searched for in, and the number of parts, whose shingles stay within the bound."""
    size = items.select("n_words", F.explode("grams").alias("g")).distinct().count()
    # a quarter to spare, as a hash deals unevenly
    parts = 1 if 16 * size <= BROADCAST_BYTES else -(-20 * size // BROADCAST_BYTES)
    return items.withColumn("part", F.pmod(F.xxhash64("grams"), F.lit(parts)).cast("int")), parts


def candidates(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, t, part, first, windows, grams``: stretches of all windows that may reach the similarity with an item of the part.

    ``t`` is the text's key; with the id it tells rows apart.
    """
    bounded_batches(docs.sparkSession)
    items, parts = in_parts(items)
    if parts == 1:
        return _stretches_of_part(docs, items, text, 0)[0]
    found = []
    for part in range(parts):
        stretches, shared = _stretches_of_part(docs, items.filter(F.col("part") == part), text, part)
        found.append(materialize(stretches, "part"))
        shared.destroy()
    return reduce(DataFrame.unionByName, found)


def _stretches_of_part(docs: DataFrame, items: DataFrame, text: str, part: int):
    """The stretches, and the broadcast that they are read with."""
    grams = items.select("n_words", F.explode("grams").alias("g")).distinct().toArrow()
    lengths, own = grams["n_words"].to_numpy(), grams["g"].to_numpy().view(np.uint64)
    known = {int(n): np.sort(own[lengths == n]) for n in np.unique(lengths)}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        windows = Windows(shared.value)
        for batch in batches:
            yield pd.Series([windows.of(t) if len(windows.grams) else [] for t in batch])
        del windows
        give_back()

    found = docs.select("doc_id", text_key(text).alias("t"), F.explode(F.pandas_udf(find, STRETCHES)(blank(text))).alias("w"))
    return found.select("doc_id", "t", F.lit(part).alias("part"), "w.*"), shared


def _blocks(fp):
    """The value of each block of a fingerprint."""
    cut = (F.shiftrightunsigned(fp, start).bitwiseAND((1 << width) - 1) for start, width in BLOCKS)
    return F.array(*(F.struct(F.lit(k).alias("block"), value.alias("value")) for k, value in enumerate(cut)))


def index_items(items: DataFrame) -> DataFrame:
    """Every item under each value of each block within the block's share of the radius."""
    share = RADIUS // len(BLOCKS)
    flips = [sorted(sum(1 << b for b in bits) for n in range(share + 1) for bits in combinations(range(width), n)) for _, width in BLOCKS]
    spread = items.select("*", F.explode(_blocks(F.col("fp"))).alias("b")).select("*", F.explode(F.lit(flips)[F.col("b.block")]).alias("flip"))
    return spread.select("item_id", "item", "part", "n_words", F.col("fp").alias("item_fp"), "b.block", F.col("b.value").bitwiseXOR(F.col("flip")).alias("value"))


def rare_shingles(items: DataFrame) -> DataFrame:
    """For each short item those of its shingles, rarest in the benchmark first, of which a window of the similarity shares one.

    A window as long as the item or down to the similarity's share of it has at least that share of
    the item's shingles, so of any one more than are left out one is shared.
    """
    each = items.select("item_id", "item", "part", "n_words", F.size("grams").alias("m"), F.explode("grams").alias("gram"))
    common = each.groupBy("gram").agg(F.count("*").alias("k"))
    place = F.row_number().over(Window.partitionBy("item").orderBy("k", "gram"))
    needed = F.col("m") - F.ceil(F.col("m") * SIMILARITY - 1e-9) + 1
    return each.join(common, "gram").withColumn("place", place).filter(F.col("place") <= needed).select("item_id", "item", "part", "n_words", "gram").distinct()


def weighted_similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard of two bags of shingles, with repeats as weights."""
    u, n = np.unique(x, return_counts=True)
    v, m = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    both = np.minimum(n[i], m[j]).sum()
    return float(both / (n.sum() + m.sum() - both))


SIMILAR = "array<struct<start:int,similarity:double>>"


def similar_windows(first: pd.Series, grams: pd.Series, windows: pd.Series, item_grams: pd.Series) -> pd.Series:
    """Of each stretch, the windows that are similar to the item."""
    out = []
    for at, own, tried, item in zip(first, grams, windows, item_grams):
        exact = ((w["start"], weighted_similarity(own[w["start"] - at : w["stop"] - at], item)) for w in tried)
        out.append([{"start": start, "similarity": s} for start, s in exact if s >= SIMILARITY])
    return pd.Series(out)


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """``doc_id, t, start, n_words, item_id, similarity`` of every window of at least the similarity."""
    read = item_table(benchmark, item_text).withColumn("item", F.monotonically_increasing_id())
    items = materialize(read, "items")
    stretches = materialize(candidates(docs, items, text).withColumn("s", F.monotonically_increasing_id()), "stretches")
    windows = stretches.select("s", "part", F.explode("windows").alias("w")).select("s", "part", "w.*")
    items = items.withColumn("short", F.size("grams") < SHORT)
    spread = windows.select("*", F.explode(_blocks(F.col("fp"))).alias("b")).select("s", "part", "start", "stop", "n_words", "fp", "b.block", "b.value")
    # a window that several parts find meets each item once
    parted = in_parts(items)[0]
    near = spread.join(materialize(index_items(parted.filter("not short")), "index"), ["part", "n_words", "block", "value"])
    near = near.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("s", "item_id", "item", "n_words", "start", "stop")
    # an item of so many words has SHORT shingles or more
    small = stretches.select("s", "part", "first", "grams", F.explode("windows").alias("w")).filter(F.col("w.n_words") < SHORT + WORDS - 1)
    own = F.array_distinct(F.slice("grams", F.col("w.start") - F.col("first") + 1, F.col("w.stop") - F.col("w.start")))
    small = small.select("s", "part", "w.start", "w.stop", "w.n_words", F.explode(own).alias("gram"))
    rare = materialize(rare_shingles(parted.filter("short")), "rare")
    near = near.unionByName(small.join(rare, ["part", "n_words", "gram"]).select("s", "item_id", "item", "n_words", "start", "stop"))
    tried = materialize(near.groupBy("s", "item_id", "item", "n_words").agg(F.collect_set(F.struct("start", "stop")).alias("tried")), "tried")
    # shingles of a stretch and of an item are joined once for all windows between them
    both = tried.join(stretches.select("s", "doc_id", "t", "first", "grams"), "s").join(items.select("item", F.col("grams").alias("item_grams")), "item")
    found = both.select("doc_id", "t", "n_words", "item_id", F.explode(F.pandas_udf(similar_windows, SIMILAR)("first", "grams", "tried", "item_grams")).alias("w"))
    return found.select("doc_id", "t", "w.start", "n_words", "item_id", "w.similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """One row for each contaminated document: its best match and how many windows and items match.

    ``text_key`` is ``text_key`` of the text, by which the row is told from others of its id.
    """
    best = F.max_by(F.struct("item_id", "similarity", "start", "n_words"), F.struct("similarity", -F.col("item_id"), -F.col("start")))
    found = matches(docs, benchmark, text, item_text)
    grouped = found.groupBy("doc_id", "t").agg(best.alias("best"), F.countDistinct("start", "n_words").alias("n_windows"), F.countDistinct("item_id").alias("n_items"))
    return grouped.select("doc_id", F.col("t").alias("text_key"), "best.item_id", "best.similarity", F.col("best.start").alias("first_word"), "best.n_words", "n_windows", "n_items")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    with temporary_tables(docs.sparkSession):
        found = materialize(contaminated(docs, benchmark, text, item_text).select("doc_id", "text_key"), "contaminated", keep=True).alias("c")
    key = free_name(docs, "text_key")
    keyed = docs.withColumn(key, text_key(text)).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col(f"d.{key}") == F.col("c.text_key"))
    return keyed.join(found, same, "left_anti").drop(key)
