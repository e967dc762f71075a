"""Vector code compression: product quantisation whose assignments walk a trie of distinct parts.

Vectors of integers are cut into equal consecutive parts, and each part position
has a codebook.  The distinct parts of a position, in lexicographic order, are
the leaves of a trie over their dimensions.  A walk in depth-first order carries
for every codebook entry the distance accumulated so far, so all parts with a
common prefix share it; a leaf takes the nearest entry and adds its values,
times the number of vectors that have this part, to the entry's sums.

The distinct parts are written once, dealt out by ranges of (position, values),
so each task holds whole subtrees; a round reads them and sends back a sum for
each entry and task.  The last assignment is one pass over the vectors, each
batch a trie of its own.

Arithmetic is exact in integers.  Defined results: rows whose vector is null, or
holds null, NaN or an infinity, are left out; a component beyond ``LARGEST`` in
magnitude counts as ``LARGEST``, so that squares stay exact; with fewer than
``entries`` vectors a codebook has as many entries; repeated rows count each time;
rows without an id come last as first entries, and of equal ids the least vector
is first; an empty table gives no rows.  Vectors of unlike lengths, or of one
that the parts don't divide, are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, give_back, materialize, temporary_tables

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 1 << 24
#: Leaves of a subtree whose levels are done at once, not child by child.
SUBTREE = 4096


@dataclass(frozen=True)
class Codebooks:
    """``entries[part][entry]`` are the integer values of an entry."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]

    @property
    def width(self) -> int:
        return len(self.entries[0][0])

    def sha256(self) -> str:
        """Of all values in decimal, by part, entry and place, with commas between."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()

    def part(self, k: int) -> np.ndarray:
        return np.array(self.entries[k], np.int64)


# the trie --------------------------------------------------------------------------------------------------------------


def walk(parts: np.ndarray, book: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Subtrees ``first, last, distances`` (leaf by entry) in depth-first order; ``parts`` are distinct rows in lexicographic order.

    The path from the root to the current node is a stack of accumulated
    distances, a vector over the entries each; memory doesn't grow with the trie.
    """
    depth = parts.shape[1]
    stack = [(0, len(parts), 0, np.zeros(len(book), np.int64))]
    while stack:
        first, last, level, far = stack.pop()
        if last - first <= SUBTREE or level == depth:
            yield first, last, below(parts[first:last], book, level, far)
            continue
        column = parts[first:last, level]
        bounds = first + np.flatnonzero(np.diff(column, prepend=column[0] - 1, append=column[-1] + 1))
        for a, b in zip(bounds[-2::-1].tolist(), bounds[:0:-1].tolist()):
            stack.append((a, b, level + 1, far + (parts[a, level] - book[:, level]) ** 2))


def below(parts: np.ndarray, book: np.ndarray, level: int, far: np.ndarray) -> np.ndarray:
    """Distances of all leaves under a node at ``level``: each node's are computed once, and passed on to its children."""
    node = np.zeros(len(parts), np.int64)
    reached = far[None, :]
    starts = np.zeros(len(parts), bool)
    starts[0] = True
    for d in range(level, parts.shape[1]):
        column = parts[:, d]
        starts[1:] |= column[1:] != column[:-1]
        first = np.flatnonzero(starts)
        reached = reached[node[first]] + (column[first, None] - book[None, :, d]) ** 2
        node = np.cumsum(starts) - 1
    return reached[node]


def assign(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (the first of equals) and its squared distance, for distinct parts in lexicographic order."""
    code, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    for first, last, far in walk(parts, book):
        best = far.argmin(axis=1)
        code[first:last], error[first:last] = best, far[np.arange(len(best)), best]
    return code, error


def assign_all(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for rows in any order, repeats included."""
    distinct, at = np.unique(parts, axis=0, return_inverse=True)
    code, error = assign(distinct, book)
    return code[at.reshape(-1)], error[at.reshape(-1)]


# on Spark --------------------------------------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Whether a vector has no null, NaN or infinite component (null: false)."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vector, fine), F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component, kept within ``LARGEST``."""
    floor = lambda x: F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(x.cast("double") * scale).cast("double")))
    return F.transform(vector, lambda x: floor(x).cast("int"))


def _checked_width(vectors: DataFrame, column: str, parts: int) -> int:
    low, high = vectors.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low is None:
        return 0
    if low != high or low % parts or not low:
        raise ValueError(f"vectors must have one length, a multiple of {parts}: there are {low} to {high} components")
    return low // parts


def distinct_parts(vectors: DataFrame, column: str, width: int, parts: int) -> DataFrame:
    """``part, v, n``: each position's distinct parts and how many vectors have them, in ranges of (part, v), in order."""
    cut = F.array(*(F.struct(F.lit(k).alias("part"), F.slice(column, k * width + 1, width).alias("v")) for k in range(parts)))
    # counted before they are dealt out by range, as one vector may be a third of all
    counted = vectors.select(F.explode(cut).alias("p")).groupBy("p.part", "p.v").agg(F.count("*").alias("n"))
    return counted.repartitionByRange("part", "v").sortWithinPartitions("part", "v")


def _sums(leaves: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """For each part and entry with any vector: how many, and their sums."""
    width = books.width

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            position = batch["part"].to_numpy()
            for k in np.unique(position).tolist():
                own = batch[position == k]
                values, n = np.stack(own["v"].to_numpy()).astype(np.int64), own["n"].to_numpy(np.int64)
                book = books.part(k)
                code, _ = assign(values, book)
                count, total = np.zeros(len(book), np.int64), np.zeros((len(book), width), np.int64)
                np.add.at(count, code, n)
                np.add.at(total, code, values * n[:, None])
                used = np.flatnonzero(count)
                yield pd.DataFrame({"part": np.full(len(used), k, np.int32), "entry": used.astype(np.int32), "n": count[used]} | {f"s{d}": total[used, d] for d in range(width)})
        give_back()

    sums = [f"s{d}" for d in range(width)]
    partial = leaves.mapInPandas(run, ", ".join(["part int, entry int, n long", *(f"{s} long" for s in sums)]))
    # sums may pass a long's range on the way of very many vectors
    rows = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(s).cast("decimal(20,0)")).alias(s) for s in sums)).collect()
    return {(r["part"], r["entry"]): (r["n"], [int(r[s]) for s in sums]) for r in rows}


def train(embeddings: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks fitted on all vectors; null if there is none.

    They start as the parts of the ``entries`` first vectors; what comes to the
    driver is those, and the sums of ``parts * entries`` entries in each round.
    """
    bounded_batches(embeddings.sparkSession)
    with temporary_tables(embeddings.sparkSession):
        vectors = embeddings.filter(usable(F.col(vector))).select(F.col(vec_id).alias("id"), integers(F.col(vector), scale).alias("x"))
        width = _checked_width(vectors, "x", parts)
        if not width:
            return None
        first = [r["x"] for r in vectors.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()]
        books = Codebooks(tuple(tuple(tuple(x[k * width : (k + 1) * width]) for x in first) for k in range(parts)))
        leaves = materialize(distinct_parts(vectors, "x", width, parts), "parts")
        for _ in range(rounds):
            found = _sums(leaves, books)
            moved = lambda k, e, old: tuple(s // found[k, e][0] for s in found[k, e][1]) if (k, e) in found else old  # noqa: E731, B023
            books = Codebooks(tuple(tuple(moved(k, e, old) for e, old in enumerate(part)) for k, part in enumerate(books.entries)))
    return books


def encode(embeddings: DataFrame, books: Codebooks | None, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Usable rows with all their columns, and a struct ``encoded(codes array<int>, error long)``.

    A column of that name stays under its name, and the struct gets underscores
    in front.
    """
    bounded_batches(embeddings.sparkSession)
    out = free_name(embeddings, "encoded")

    @F.pandas_udf("codes array<int>, error long")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            if not len(vectors):
                yield pd.DataFrame({"codes": pd.Series([], dtype=object), "error": pd.Series([], dtype="int64")})
                continue
            x = np.stack(vectors.to_numpy()).astype(np.int64)
            found = [assign_all(x[:, k * books.width : (k + 1) * books.width], books.part(k)) for k in range(len(books.entries))]
            yield pd.DataFrame({"codes": list(np.stack([c for c, _ in found], axis=1).astype(np.int32)), "error": sum(e for _, e in found)})
        give_back()

    kept = embeddings.filter(usable(F.col(vector)))
    if books is None:
        return kept.select("*", F.lit(None).cast("struct<codes:array<int>,error:bigint>").alias(out))
    return kept.select("*", nearest(integers(F.col(vector), scale)).alias(out))


def hex_code(codes: Column) -> Column:
    """Two lowercase hex digits for each code."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def with_label_error(encoded: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """Add ``label_error``: the error summed over equal labels, nulls together.

    Labels are summed before they meet the rows, so a label of very many rows
    is one row on one side of the join, and adaptive execution splits the other.
    """
    own = free_name(encoded, "_label")
    total = encoded.groupBy(F.col(label).alias(own)).agg(F.sum(error).alias("label_error"))
    return encoded.join(total, F.col(label).eqNullSafe(F.col(own))).drop(own)


def compress(embeddings: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable row, by codebooks fitted on them."""
    books = train(embeddings)
    coded = encode(embeddings.select("vec_id", "embedding", "label"), books)
    # the codes are read twice, for the labels' sums and for the rows
    with temporary_tables(embeddings.sparkSession):
        rows = materialize(coded.select("vec_id", "label", hex_code(F.col("encoded.codes")).alias("code"), F.col("encoded.error").alias("error")), "codes", keep=True)
    digest = F.lit(books.sha256() if books else None).cast("string")
    return with_label_error(rows).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
