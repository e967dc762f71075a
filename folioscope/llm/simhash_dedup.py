"""Near-duplicate groups of SimHash fingerprints by anchor-point covering.

The bits of a fingerprint are split in blocks.  The anchors of a block are the
words of perfect binary codes (length 23 with covering radius three, length
seven with one), so every block value has one home anchor; it is replicated to
every anchor that is the home of some value within the block's share of the
radius, which are those within the covering radius plus that share.  Two
fingerprints near each other in some block so meet at the home anchor of either
one, where they are compared over all compared bits.

Two forms.  ``near_duplicates`` links fingerprints of 64 bits within a radius,
losing no pair; its blocks and codes are chosen by the number of fingerprints,
so that what meets at an anchor stays in bounds.  ``similar_groups`` links texts
whose sets of five-word shingles have a Jaccard similarity of 0.8 or more:
fingerprints of 256 bits meet the same way, and exact similarity decides what
is linked (of texts of ``SHORT`` shingles or more about one pair in a thousand
never meets at the least similarity, measured by a test; above it fewer).  What
is near but still apart after that, and every shorter text, meets by a prefix
filter on its rarest shingles, which loses no pair.

Equal fingerprints (or texts) are one row before covering.  An anchor with very
many fingerprints is cut into a grid of bounded cells, so no pair is lost and
no task holds an unbounded group; each cell gives a spanning star of its links
instead of all pairs.

Defined results: null and empty texts have fingerprint zero and link like any
other; repeated rows share a group; a text of fewer words than a shingle is one
shingle; a group whose rows have no id has a null component.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, blank, bounded_batches, free_name, give_back, materialize, temporary_tables, text_key
from .components import connected_components
from .decontaminate import shingles

WORDS, SEED, RADIUS = 4, 42, 4
#: Home fingerprints and replicas that one cell holds on average at most.
CELL_HOME, CELL_NEAR = 2048, 8192
#: Generator polynomials of the perfect codes by their length, and their covering radii, as fixed values.
CODES = {23: (0xC75, 3), 7: (0xB, 1)}


@dataclass(frozen=True)
class Cover:
    """Blocks of each 64-bit word of a fingerprint, each of parts (start, width); bits of a block that may differ; bits of the
    compared words (the first ones) that may differ in a link."""

    words: int
    blocks: tuple[tuple[tuple[int, int], ...], ...]
    share: int
    radius: int
    compared: int = 1

    def keeps_all(self) -> bool:
        """Whether any two within the radius differ by the share at most in some block."""
        return self.compared == self.words and self.radius < (self.share + 1) * len(self.blocks) * self.words


THREE = (((0, 22),), ((22, 21),), ((43, 21),))
#: 4096 anchors a block and 16 rows for each fingerprint.
SMALL = Cover(1, THREE, 1, RADIUS)
#: 262,144 anchors a block and about 115 rows for each fingerprint: a tenth of the comparisons.
LARGE = Cover(1, (((0, 23), (23, 7), (30, 2)), ((32, 23), (55, 7), (62, 2))), 2, RADIUS)
#: Distinct fingerprints from which fewer comparisons outweigh more rows.
LARGE_FROM = 50_000_000
#: Of 128 bits 19 differ on average at a similarity of 0.8, of 256 bits 39; the bounds are over three standard deviations above.
WIDE = Cover(4, THREE, 1, 33, 2)
WIDE_RADIUS = 60
SIMILARITY = 0.8
#: Rounds in which the members of a cell's group meet one of them, before the prefix filter takes what is left.
STARS = 2
#: Texts of fewer shingles are compared by the prefix filter, as too few bits agree in their fingerprints.
SHORT = 30
#: Counters of how common shingles are, two megabytes; and bits of a text's map of its shingles.
COUNTERS, MAP_BITS = 1 << 18, 1024


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash over the word shingles of a text, repeats included, as an unsigned number."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        spans = zip(starts[at : min(n, at + (1 << 15))].tolist(), last[at : at + (1 << 15)].tolist())
        hashed = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        counts += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, fp`` (a signed long) of every row."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
        give_back()

    return docs.select("doc_id", hashed(blank(text).cast("binary")).alias("fp"))


def syndrome(words: np.ndarray, length: int) -> np.ndarray:
    """Remainder of each word, as a polynomial over two elements, by the code's generator."""
    generator = CODES[length][0]
    degree, words = generator.bit_length() - 1, words.copy()
    for bit in range(length - 1, degree - 1, -1):
        words ^= np.where(words >> bit & 1, generator << (bit - degree), 0)
    return words


def code_length(width: int) -> int | None:
    """The code for a part of so many bits; parts narrower than a code's information have none, each value is its own anchor."""
    return next((n for n, least in ((7, 5), (23, 13)) if least <= width <= n), None)


@functools.cache
def part_cover(width: int, share: int) -> tuple[int, list[list[list[int]]]]:
    """Bits of an anchor; for each syndrome and each number of changed bits up to the share, the differences to the anchors reached."""
    length = code_length(width)
    radius = CODES[length][1] if length else 0
    n = 1 << CODES[length][0].bit_length() - 1 if length else 1
    found: list[list[list[int]]] = [[[] for _ in range(share + 1)] for _ in range(n)]
    for weight in range(radius + share + 1):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(length or width), weight)], np.int64)
        for s, e in zip(syndrome(errors, length).tolist() if length else [0] * len(errors), errors.tolist()):
            found[s][max(0, weight - radius)].append(e)
    return length or width, found


@functools.cache
def cover(widths: tuple[int, ...], share: int) -> tuple[np.ndarray, np.ndarray]:
    """For the syndromes of a block's parts the differences to all anchors it is replicated to, its home first, and their number."""
    parts = [part_cover(w, share) for w in widths]
    shifts = np.cumsum([0, *(bits for bits, _ in parts[:-1])]).tolist()
    levels = [x for x in product(range(share + 1), repeat=len(parts)) if sum(x) <= share]
    rows = []
    for own in product(*(found for _, found in parts)):
        reached = sorted((sum(level), d) for level in levels for d in product(*(f[n] for f, n in zip(own, level))))
        rows.append([sum(e << at for e, at in zip(d, shifts)) for _, d in reached])
    size = np.array([len(x) for x in rows])
    table = np.zeros((len(rows), size.max()), np.int64)
    for s, x in enumerate(rows):
        table[s, : len(x)] = x
    return table, size


def anchors(fps: np.ndarray, how: Cover) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row number, anchor key, and whether it is the home, for each fingerprint and anchor, one block at a time."""
    for k, (word, block) in enumerate(product(range(how.words), how.blocks)):
        bits, value, s, shift = fps[:, word].view(np.uint64), np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64), 0
        for start, width in block:
            own = (bits >> np.uint64(start) & np.uint64((1 << width) - 1)).astype(np.int64)
            length, found = part_cover(width, how.share)
            s = s * len(found) + (syndrome(own, length) if code_length(width) else 0)
            value |= own << shift
            shift += length
        table, size = cover(tuple(width for _, width in block), how.share)
        n = size[s]
        row = np.repeat(np.arange(len(fps)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield row, (value[row] ^ table[s[row], nth]) | k << 40, nth == 0


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def star_links(home: np.ndarray, near: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as a star for each component, of the pairs of a home and a near row within ``radius`` bits.

    The first column is the id, the others are the words compared.
    """
    nodes = np.unique(np.concatenate((home[:, 0], near[:, 0])))
    label, at_near, at_home = np.arange(len(nodes)), np.searchsorted(nodes, near[:, 0]), np.searchsorted(nodes, home[:, 0])
    own = np.zeros(len(nodes), bool)
    own[at_near] = True
    words = near[:, 1:].view(np.uint64)
    for part in range(0, len(home), 128):
        mine, apart = home[part : part + 128, 1:].view(np.uint64), np.uint16(0)
        for w in range(words.shape[1]):
            apart = apart + np.bitwise_count(mine[:, w, None] ^ words[None, :, w])
        close = apart <= radius
        # a home's own copy may stand in this cell or in another column
        for k in np.flatnonzero(close.sum(axis=1) > own[at_home[part : part + 128]]):
            labels = np.unique(np.append(label[at_near[close[k]]], label[at_home[part + k]]))
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels[0]
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[member], nodes[label[member]]


def near_links(points: DataFrame, how: Cover = SMALL) -> DataFrame:
    """``cell, u, v``: links whose components are those of all pairs of ``points(id, w0, w1, ...)`` that meet within the radius.

    Anchors with many rows are broadcast; there are as many anchors as the codes have words, however many points.
    """
    spark = points.sparkSession
    bounded_batches(spark)
    names = [f"w{k}" for k in range(how.words)]
    carried = ["id", *names[: how.compared]]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, keys, home in anchors(batch[names].to_numpy(np.int64), how):
                anchor, at = np.unique(keys, return_inverse=True)
                yield pd.DataFrame({"anchor": anchor, "n": np.bincount(at, minlength=len(anchor)), "n_home": np.bincount(at, home, len(anchor)).astype(np.int64)})

    counts = points.select(names).mapInPandas(count, "anchor long, n long, n_home long").groupBy("anchor").agg(F.sum("n").alias("n"), F.sum("n_home").alias("n_home"))
    large = counts.select("anchor", F.ceil(F.col("n_home") / CELL_HOME).alias("h"), F.ceil(F.col("n") / CELL_NEAR).alias("r")).filter("h > 1 or r > 1").orderBy("anchor").toArrow()
    shared = spark.sparkContext.broadcast([large[c].to_numpy().astype(np.int64) for c in ("anchor", "h", "r")])

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crowded, rows_of, columns_of = shared.value
        for batch in batches:
            fps, own = batch[names].to_numpy(np.int64), batch[carried].to_numpy(np.int64)
            along, across = mixed(own[:, 0], 1), mixed(own[:, 0], 2)
            for row, keys, home in anchors(fps, how):
                h, r = np.ones(len(keys), np.int64), np.ones(len(keys), np.int64)
                if len(crowded):
                    at = np.minimum(np.searchsorted(crowded, keys), len(crowded) - 1)
                    found = crowded[at] == keys
                    h[found], r[found] = rows_of[at[found]], columns_of[at[found]]
                # a home stands in a row of the grid, a replica in a column
                for copies, only, is_home in ((r, home, True), (h, np.ones(len(keys), bool), False)):
                    at = np.repeat(np.flatnonzero(only), copies[only])
                    nth = np.arange(len(at)) - np.repeat(np.cumsum(copies[only]) - copies[only], copies[only])
                    hashed = along if is_home else across
                    fixed = (hashed[row[at]] % np.maximum(h if is_home else r, 1)[at].astype(np.uint64)).astype(np.int64)
                    i, j = (fixed, nth) if is_home else (nth, fixed)
                    cell = mixed(mixed(mixed(keys[at]) + i.astype(np.uint64)) + j.astype(np.uint64)).view(np.int64)
                    yield pd.DataFrame({"cell": cell, "home": is_home} | {c: own[row[at], k] for k, c in enumerate(carried)})

    kinds = ", ".join(["cell long, home boolean", *(f"{c} long" for c in carried)])
    grid = points.select(*dict.fromkeys((*carried, *names))).mapInPandas(spread, kinds).repartition("cell").sortWithinPartitions("cell")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            cell, home, rows, out = pdf["cell"].to_numpy(), pdf["home"].to_numpy(bool), pdf[carried].to_numpy(np.int64), []
            bounds = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            for a, b in zip([0, *bounds], [*bounds, len(pdf)]):
                h = home[a:b]
                if h.any() and not h.all():
                    u, v = star_links(rows[a:b][h], rows[a:b][~h], how.radius)
                    out.append((np.full(len(u), cell[a]), u, v))
            if out:
                yield pd.DataFrame({k: np.concatenate(x) for k, x in zip(("cell", "u", "v"), zip(*out))})

        rest: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            ends = batch["cell"].to_numpy() == batch["cell"].iloc[-1]
            if not ends.all() or (rest and rest[-1]["cell"].iloc[0] != batch["cell"].iloc[0]):
                yield from links(pd.concat((*rest, batch[~ends]), ignore_index=True))
                rest = []
            rest.append(batch[ends])
        if rest:
            yield from links(pd.concat(rest, ignore_index=True))
        give_back()

    return grid.mapInPandas(compare, "cell long, u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", how: Cover | None = None) -> DataFrame:
    """``doc_id, fp, component_id``: the least id that is reachable by links of at most ``how.radius`` bits."""
    with temporary_tables(docs.sparkSession):
        hashed = materialize(fingerprints(docs, text), "fingerprints", keep=True)
        distinct = materialize(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
        if how is None:
            how = SMALL if distinct.count() < LARGE_FROM else LARGE
        if not how.keeps_all():
            raise ValueError("the blocks cover a smaller radius only")
        links = near_links(distinct.select(F.col("fp").alias("id"), F.col("fp").alias("w0")), how)
        stars = connected_components(links.select("u", "v"))
        rooted = distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        rooted = materialize(rooted, "rooted")
        least = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "components")
        classes = materialize(rooted.join(least, "root").select("fp", "component_id"), "classes", keep=True)
    return hashed.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


# texts of a similarity ------------------------------------------------------------------------------------------------

_MIX = np.random.default_rng(11).integers(0, 1 << 63, WIDE.words, np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(grams: np.ndarray) -> np.ndarray:
    """SimHash of ``WIDE.words`` words over shingle hashes, each once."""
    counts = np.zeros(64 * WIDE.words, np.int64)
    for at in range(0, len(grams), 255):
        x = grams[at : at + 255, None] * _MIX
        x = (x ^ (x >> np.uint64(32))) * _MIX
        x ^= x >> np.uint64(29)
        # at most 255 rows, so counts of a byte suffice
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(grams), bitorder="little").view(np.int64)


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, t, node, n, w0, ...``: nodes are equal for texts of the same words, ``t`` is the text's key, ``n`` counts distinct shingles."""
    bounded_batches(docs.sparkSession)
    names = [f"w{k}" for k in range(WIDE.words)]

    @F.pandas_udf(", ".join(f"{c} long" for c in ("node", "n", *names)))
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = _hash_of_words()
        for texts in batches:
            rows = []
            for t in texts:
                tokens = t.lower().split()
                words = np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))
                node = int(np.uint64(xxhash.xxh64_intdigest(b" ".join(tokens), 5)).view(np.int64))
                grams = np.unique(shingles(words))
                rows.append((node, len(grams), *wide_fingerprint(grams).tolist()))
            yield pd.DataFrame(rows, columns=["node", "n", *names])
        del cache
        give_back()

    return docs.select("doc_id", text_key(text).alias("t"), read(blank(text).cast("binary")).alias("s")).select("doc_id", "t", "s.*")


@functools.lru_cache(64)
def shingle_set(text: bytes, words: int = 5) -> frozenset:
    tokens = text.lower().split()
    return frozenset(zip(*(tokens[k:] for k in range(words)))) if len(tokens) >= words else frozenset([tuple(tokens)])


def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(map(shingle_set, a), map(shingle_set, b)):
        both = len(x & y)
        out.append(both / (len(x) + len(y) - both))
    return pd.Series(out, dtype=float)


def _grams(text: bytes, cache: BoundedCache) -> np.ndarray:
    tokens = text.lower().split()
    return np.unique(shingles(np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))))


def _hash_of_words() -> BoundedCache:
    return BoundedCache(lambda w: xxhash.xxh64_intdigest(w, 7), 100_000)


def prefixes(n: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """How many of a set's first members one that is at least as large, or one that is at most as large, must meet.

    Of two sets in one order whose similarity is reached, the first common member is among that
    many of the smaller and of the larger one: they share at least 2 s / (1 + s) of the smaller, and s of the larger.
    """
    least = lambda share: n - int(np.ceil(share * n - 1e-9)) + 1
    return least(2 * similarity / (1 + similarity)), least(similarity)


def prefix_pairs(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``u, v``: all pairs of ``texts(node, root, text)`` of different roots that may have the similarity.

    Shingles are ordered by how common they are (by counters that several may
    share: any order is right, as long as it is one), so what many texts have in common comes last; texts meet
    by a shingle in their prefixes, where what follows it is long enough for the
    overlap that the similarity needs.  Each carries a map with a bit set for each of its
    shingles: a bit that the other lacks is a shingle that it lacks, so no more than the
    rest can be shared.  All bounds are sound, so no pair is lost.
    """
    spark = texts.sparkSession
    maps = [f"b{k}" for k in range(MAP_BITS // 64)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, seen = _hash_of_words(), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                np.add.at(seen, (_grams(text, cache) % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"counter": at, "n": seen[at]})
        del cache
        give_back()

    got = texts.select("text").mapInPandas(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(COUNTERS, np.int64)
    common[got["counter"].to_numpy()] = got["n"].to_numpy()
    shared = spark.sparkContext.broadcast(common)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _hash_of_words()
        for batch in batches:
            grams, sizes, bits = [np.zeros(0, np.uint64)], np.zeros((len(batch), 3), np.int64), np.zeros((len(batch), MAP_BITS), bool)
            for k, text in enumerate(batch["text"]):
                own = _grams(text, cache)
                if len(own):
                    bits[k, (own % np.uint64(MAP_BITS)).astype(np.int64)] = True
                    sizes[k] = len(own), *prefixes(len(own), similarity)
                    grams.append(own[np.lexsort((own, shared.value[(own % np.uint64(COUNTERS)).astype(np.int64)]))[: sizes[k, 2]]])
            row = np.repeat(np.arange(len(batch)), sizes[:, 2])
            at = np.arange(len(row)) - np.repeat(np.cumsum(sizes[:, 2]) - sizes[:, 2], sizes[:, 2])
            words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            own = {c: batch[c].to_numpy()[row] for c in ("node", "root")} | {c: words[row, k] for k, c in enumerate(maps)}
            yield pd.DataFrame({"gram": np.concatenate(grams).view(np.int64), "at": at, "n": sizes[row, 0], "first": at < sizes[row, 1]} | own)
        del cache
        give_back()

    met = materialize(texts.mapInPandas(cut, ", ".join(["gram long, at int, n int, first boolean", *(f"{c} long" for c in ("node", "root", *maps))])), "prefixes")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    smaller = (x("n") < y("n")) | (x("n") == y("n")) & (x("node") < y("node"))
    needed = (x("n") + y("n")) * F.lit(similarity / (1 + similarity)) - 1e-9
    lacks = lambda one, other: functools.reduce(lambda a, b: a + b, (F.bit_count(one(m).bitwiseAND(F.bitwise_not(other(m)))) for m in maps))
    may = smaller & (x("root") != y("root")) & (F.least(x("n") - x("at"), y("n") - y("at")) >= needed) & (F.least(x("n") - lacks(x, y), y("n") - lacks(y, x)) >= needed)
    both = met.filter("first").alias("x").join(met.alias("y"), (x("gram") == y("gram")) & may)
    return both.select(F.least(x("node"), y("node")).alias("u"), F.greatest(x("node"), y("node")).alias("v")).distinct()


def similar_links(docs: DataFrame, signed: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``u, v``: links whose components are those of all pairs of nodes that meet and have at least the similarity.

    What a cell finds near each other is a group; its members are first compared with one of them, so a large group of copies
    costs a star.  Those that are still in different components, and short texts, meet by the prefix filter, so a large
    group of texts that are all a little less similar costs no pair for each two of them.  What meets in cells is compared by
    texts within ``WIDE_RADIUS`` bits only.
    """
    names = [f"w{k}" for k in range(WIDE.words)]
    # one row stands for all of a node
    points = materialize(signed.groupBy(F.col("node").alias("id")).agg(F.min_by(F.struct("doc_id", "t", "n", *names), "t").alias("x")).select("id", "x.*"), "points")
    stars = materialize(near_links(points.select("id", *names), WIDE), "stars")
    group = F.xxhash64("cell", "v").alias("key")
    members = stars.select(group, F.col("u").alias("node")).unionByName(stars.select(group, F.col("v").alias("node"))).distinct()
    members = materialize(members.join(points.select(F.col("id").alias("node"), *names), "node"), "members")
    # a partner of a short text has no more than this
    short = points.filter(F.col("n") <= int(SHORT / similarity)).select(F.col("id").alias("node"))
    wanted = materialize(members.select("node").unionByName(short).distinct(), "proposed")
    wanted = materialize(points.join(wanted.withColumnRenamed("node", "id"), "id", "left_semi").select("id", "doc_id", "t"), "wanted").alias("w")
    rows = docs.select("doc_id", text_key(text).alias("t"), blank(text).cast("binary").alias("text")).alias("d")
    texts = rows.join(wanted, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.t") == F.col("w.t"))).select(F.col("w.id").alias("node"), "d.text")
    # equal rows are one
    texts = materialize(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")

    def decided(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
        return both.select("u", "v", (F.pandas_udf(jaccard, "double")("a", "b") >= similarity).alias("near"))

    # of what a text meets near it, it is compared with the nearest
    apart = functools.reduce(lambda a, b: a + b, (F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in names))
    nearest = lambda met, u, v: met.filter(apart <= WIDE_RADIUS).groupBy(u.alias("u")).agg(F.min_by(v, F.struct(apart, v)).alias("v"))

    empty = members.sparkSession.createDataFrame([], "u long, v long, near boolean")
    known = empty
    for turn in range(STARS + 1):
        if not turn:
            # each cell's star as it is
            left, right = points.alias("x"), points.alias("y")
            pairs = nearest(stars.select("u", "v").distinct().join(left, F.col("u") == F.col("x.id")).join(right, F.col("v") == F.col("y.id")), F.col("x.id"), F.col("y.id"))
        else:
            roots = materialize(connected_components(links), "roots")
            rooted = materialize(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
            open_keys = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.min_by(F.struct("node", "root", *names), F.xxhash64("node", F.lit(turn))).alias("hub")).filter("a < z")
            open_keys = materialize(open_keys.select("key", "hub.*"), "open").alias("y")
            left = rooted.alias("x")
            if turn < STARS:
                pairs = nearest(left.join(open_keys, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root"))), F.col("x.node"), F.col("y.node"))
            else:
                still = rooted.join(open_keys.select("key"), "key", "left_semi").select("node").unionByName(short).distinct()
                still = materialize(still.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "still")
                pairs = prefix_pairs(materialize(still.join(texts, "node"), "left"), similarity)
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        fresh = materialize(decided(materialize(pairs.join(known, ["u", "v"], "left_anti"), "pairs")), "decided")
        known = known.unionByName(fresh)
        links = fresh.filter("near").select("u", "v")
        if turn:
            # what was linked before is a star to each root
            links = links.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
    return links


def similar_groups(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, t, root``: rows, told apart by id and text key, of one root are linked by texts of at least the similarity."""
    signed = materialize(signatures(docs, text), "signatures")
    roots = materialize(connected_components(similar_links(docs, signed, text, similarity)), "roots")
    return signed.select("doc_id", "t", "node").join(roots, "node", "left").select("doc_id", "t", F.coalesce("root", "node").alias("root"))


def first_of_each_group(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The row with the least id (then the least text key; rows without an id come last) of each group, with all its columns, once."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    with temporary_tables(docs.sparkSession):
        first = similar_groups(docs, text, similarity).groupBy("root").agg(F.min(order).alias("k")).select("k.none", F.coalesce(F.col("k.doc_id").cast("string"), F.lit("")).alias("id"), "k.t")
        first = materialize(first.distinct(), "first", keep=True).alias("f")
    names = [free_name(docs, c) for c in ("none", "id", "t")]
    keys = (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_key(text))
    keyed = docs.select("*", *(k.alias(n) for k, n in zip(keys, names))).alias("d")
    same = functools.reduce(lambda a, b: a & b, (F.col(f"d.{n}") == F.col(f"f.{c}") for n, c in zip(names, ("none", "id", "t"))))
    return keyed.join(first, same, "left_semi").dropDuplicates(names).drop(*names)
