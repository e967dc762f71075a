"""Removal of every byte that a repeated string of fixed length covers, over all texts.

A suffix sort to a bounded depth by a difference cover.  The cover is chosen by
content: the sampled suffixes are those at window minimisers, so two suffixes
that agree on ``LENGTH`` bytes always meet a sampled suffix after the same
shift, the property for which residues modulo three are used in memory.  (With
residues two thirds of all byte positions would be shuffled; with minimisers
about one in a hundred.)

1. *Name the samples* by the bytes that follow them; samples whose name is
   unique cannot start a repeat and are dropped.
2. *Merge the remaining suffixes*: the suffixes before a sample, up to the
   previous one, are compared as one block; blocks that agree as a whole are
   repeated, and one of them stands for all.
3. *Recurse* where blocks of one name differ: they are cut into short blocks
   and named again, and at last into single suffixes.
4. *Compare adjacent prefixes*: equal names of ``LENGTH`` bytes are repeats.

Names are 128 bits of two unlike hashes of the bytes (running sums of powers,
and XXH3), so equal names are taken as equal strings.

Defined results: null and empty texts, and texts shorter than ``LENGTH``, keep
all bytes; repeated rows count as separate texts, so all of a long repeated row
goes; a match never crosses texts.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, bounded_batches, give_back, materialize, quoted, temporary_tables, text_key

LENGTH = 400
#: Bytes that a minimiser is chosen by, and suffixes of a short block.
GRAM, SHORT = 24, 16
#: Positions handled at once; longer texts are read in overlapping parts.
PART = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_SEED = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.int64).view(np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(size, np.uint64(base))
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


class Hashes:
    """Hashes of any substring of ``data``, from running sums."""

    def __init__(self, data: bytes):
        n = len(data)
        size = 1 << max(12, (n + 1).bit_length())
        powers, self.inverse = _powers(size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_SEED[np.frombuffer(data, np.uint8)] * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH3 of each substring, read as a whole."""
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` keys in a row."""
    n = 1
    while 2 * n <= width:
        keys = np.minimum(keys[:-n], keys[n:])
        n *= 2
    return np.minimum(keys[: len(keys) - (width - n)], keys[width - n :]) if n < width else keys


def window_of(length: int) -> int:
    """Positions in which a minimiser is the least; with its bytes it must fit the length, and leave enough to name."""
    if length < 4 * GRAM:
        raise ValueError(f"strings of at least {4 * GRAM} bytes are looked for")
    return length // 2


def sampled(data: bytes, length: int = LENGTH) -> Iterator[dict[str, np.ndarray]]:
    """Sampled positions ``a`` with the suffixes ``p0 <= p < p1`` that meet them first, the name of what follows, and of the whole block."""
    last, window = len(data) - length + 1, window_of(length)
    for at in range(0, max(last, 0), PART):
        # blocks that start in [at, stop); one position before, and a window after, to see whole blocks
        stop, lo, hi = min(at + PART, last), max(at - 1, 0), min(at + PART + window, last)
        part = data[lo : hi - 1 + length]
        hashes = Hashes(part)
        start = np.arange(len(part) - GRAM + 1)
        order = hashes.of(start, start + GRAM) & np.uint64(0xFFFFFFFFFF000000)
        least = _least(order | np.uint64(0xFFFFFF) - start.astype(np.uint64), window)[: hi - lo]
        mine = 0xFFFFFF - (least & np.uint64(0xFFFFFF)).astype(np.int64)
        p0 = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        p1 = np.append(p0[1:], hi - lo)
        keep = (p0 + lo < stop) & (p0 + lo >= at) if not at else (p0 + lo < stop) & (p0 > 0)
        p0, p1 = p0[keep], p1[keep]
        a = mine[p0]
        yield {"a": a + lo, "p0": p0 + lo, "p1": p1 + lo, "name": hashes.of(a, a + length - window + 1), "whole": digests(part, p0, p1 - 1 + length)}


SAMPLES = "doc_id long, t long, a int, p0 int, p1 int, name long, whole long"


def _samples(docs: DataFrame, length: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {k: [] for k in ("row", "a", "p0", "p1", "name", "whole")}
            texts, held = batch.column("b"), 0

            def out(found=found, batch=batch) -> pa.RecordBatch:
                joined = {k: np.concatenate(v) for k, v in found.items()}
                rows = pa.array(joined["row"])
                columns = [batch.column("doc_id").take(rows), batch.column("t").take(rows)]
                columns += [pa.array(joined[k].astype(np.int32)) for k in ("a", "p0", "p1")]
                columns += [pa.array(joined[k].view(np.int64)) for k in ("name", "whole")]
                return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SAMPLES.split(", ")])

            for row in range(len(texts)):
                for x in sampled(texts[row].as_buffer().to_pybytes(), length):
                    found["row"].append(np.full(len(x["a"]), row))
                    held += len(x["a"])
                    for k, v in x.items():
                        found[k].append(v)
                if held > 200_000:
                    yield out()
                    held = 0
                    for v in found.values():
                        v.clear()
            if found["row"]:
                yield out()

    return docs.mapInArrow(find, SAMPLES)


def _resolve(blocks: DataFrame, payload: list[str], tag: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks that are repeated as a whole, those that must be cut, and all whose name another has.

    ``blocks`` has ``name`` (what all its suffixes share), ``whole``, a weight
    ``n`` and the payload.  Only blocks of weight one are still to be decided;
    heavier ones stand for several that are known to be repeated.
    """
    named = materialize(blocks.groupBy("name").agg(F.sum("n").alias("k")).filter("k > 1").select("name"), f"{tag}-names")
    kept = materialize(blocks.join(named, "name", "left_semi"), f"{tag}-kept")
    first = F.min(F.struct(*payload)).alias("first")
    wholes = materialize(kept.groupBy("name", "whole").agg(F.sum("n").alias("n"), first), f"{tag}-wholes")
    double = materialize(wholes.filter("n > 1").select("name", "whole"), f"{tag}-double")
    repeated = kept.filter("n = 1").join(double, ["name", "whole"], "left_semi").select(*payload)
    counted = wholes.groupBy("name").agg(F.count("*").alias("k"), F.count_if(F.col("n") == 1).alias("open"))
    differ = materialize(counted.filter("k > 1 and open > 0").select("name"), f"{tag}-differ")
    to_cut = wholes.join(differ, "name", "left_semi").select("n", "first.*")
    return repeated, materialize(to_cut, f"{tag}-cut"), kept


def repeated_starts(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, t, starts, across``: runs ``[p0, p1)`` of positions at which a repeated string starts.

    ``across`` is true where a row shares the name of a sample with another row;
    a name is a string of ``length - window_of(length) + 1`` bytes.  Rows with
    neither are left out.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_key(text).alias("t"), blank(text).cast("binary").alias("b"))
    samples = materialize(_samples(rows.filter(F.length("b") >= length), length), "samples")
    payload = ["doc_id", "t", "a", "p0", "p1"]
    whole_blocks, to_cut, shared = _resolve(samples.withColumn("n", F.lit(1).cast("long")), payload, "blocks")

    wanted = to_cut.groupBy("doc_id", "t").agg(F.collect_set(F.struct("a", "p0", "p1", "n")).alias("w"))
    once = rows.filter(F.length("b") >= length).alias("r")
    joined = once.join(materialize(wanted, "wanted").alias("w"), F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("r.t") == F.col("w.t"))).select("r.doc_id", "r.t", "w.w", "r.b")
    # of equal rows one is enough
    cut = joined.select("doc_id", "t", "w", "b").mapInArrow(partial(_cut_out, length=length), CUT)
    passages = materialize(cut.dropDuplicates(["doc_id", "t", "a"]), "passages")

    short_blocks, to_split, _ = _resolve(passages.mapInArrow(partial(_short_blocks, length=length), SHORTS), payload, "short")
    split = passages.select("doc_id", "t", "a", F.col("p0").alias("at"), "b").alias("l")
    need = materialize(to_split.groupBy("doc_id", "t", "a").agg(F.collect_set(F.struct("p0", "p1", "n")).alias("w")), "split").alias("w")
    split = split.join(need, F.col("l.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("l.t") == F.col("w.t")) & (F.col("l.a") == F.col("w.a"))).select("l.doc_id", "l.t", "l.at", "l.b", "w.w")
    singles = materialize(split.mapInArrow(partial(_single, length=length), SINGLES), "singles")
    equal = materialize(singles.groupBy("h1", "h2").agg(F.sum("n").alias("k")).filter("k > 1").select("h1", "h2"), "equal")
    single = singles.filter("n = 1").join(equal, ["h1", "h2"], "left_semi").select("doc_id", "t", "p0", (F.col("p0") + 1).alias("p1"))

    runs = whole_blocks.select("doc_id", "t", "p0", "p1").unionByName(short_blocks.select("doc_id", "t", "p0", "p1")).unionByName(single)
    # names that stand in more than one row
    row = F.xxhash64("doc_id", "t")
    across = materialize(shared.groupBy("name").agg(F.min(row).alias("a"), F.max(row).alias("z")).filter("a < z").select("name"), "across")
    across = shared.join(across, "name", "left_semi").select("doc_id", "t").distinct()
    runs = runs.select("doc_id", "t", F.struct("p0", "p1").alias("run")).unionByName(across, allowMissingColumns=True)
    # sets, as equal rows have the same runs
    return runs.groupBy("doc_id", "t").agg(F.collect_set("run").alias("starts"), F.max(F.col("run").isNull()).alias("across"))


CUT = "doc_id long, t long, a int, p0 int, p1 int, n long, b binary"


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted block."""
    for batch in batches:
        rows, out = [], {k: [] for k in ("a", "p0", "p1", "n", "b")}
        for row, (wanted, data) in enumerate(zip(batch.column("w"), batch.column("b"))):
            data = data.as_buffer().to_pybytes()
            for w in wanted.as_py():
                rows.append(row)
                for k in ("a", "p0", "p1", "n"):
                    out[k].append(w[k])
                out["b"].append(data[w["p0"] : w["p1"] - 1 + length])
        yield _with_ids(batch, rows, [pa.array(out["a"], pa.int32()), pa.array(out["p0"], pa.int32()), pa.array(out["p1"], pa.int32()), pa.array(out["n"], pa.int64()), pa.array(out["b"], pa.binary())], CUT)


def _with_ids(batch: pa.RecordBatch, rows: list[int], columns: list[pa.Array], schema: str) -> pa.RecordBatch:
    rows = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("t").take(rows), *columns], names=[x.split()[0] for x in schema.split(", ")])


SHORTS = "doc_id long, t long, a int, p0 int, p1 int, n long, name long, whole long"


def _short_blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Blocks cut where the distance to their sample is a multiple of ``SHORT``."""
    for batch in batches:
        rows, out = [], {k: [np.zeros(0, np.int64)] for k in ("a", "p0", "p1", "n", "name", "whole")}
        spans = zip(*(batch.column(k).to_pylist() for k in ("a", "p0", "p1", "n")), batch.column("b"))
        for row, (a, p0, p1, n, data) in enumerate(spans):
            data = data.as_buffer().to_pybytes()
            j = np.arange((a - p1 + 1) // SHORT, (a - p0) // SHORT + 1)
            first, stop = np.maximum(a - SHORT * j - SHORT + 1, p0), np.minimum(a - SHORT * j + 1, p1)
            shared = a - SHORT * j - p0
            name = _mix(Hashes(data).of(shared, shared + length - SHORT + 1) + j.astype(np.uint64))
            whole = digests(data, first - p0, stop - 1 - p0 + length)
            rows += [row] * len(j)
            for k, v in (("a", np.full(len(j), a)), ("p0", first), ("p1", stop), ("n", np.full(len(j), n)), ("name", name.view(np.int64)), ("whole", whole.view(np.int64))):
                out[k].append(v)
        joined = {k: np.concatenate(v) for k, v in out.items()}
        columns = [pa.array(joined[k], pa.int32() if k in ("a", "p0", "p1") else pa.int64()) for k in ("a", "p0", "p1", "n", "name", "whole")]
        yield _with_ids(batch, rows, columns, SHORTS)


SINGLES = "doc_id long, t long, p0 int, n long, h1 long, h2 long"


def _single(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every suffix of the blocks that are still open."""
    for batch in batches:
        rows, out = [], {k: [np.zeros(0, np.int64)] for k in ("p0", "n", "h1", "h2")}
        for row, (at, data, wanted) in enumerate(zip(batch.column("at").to_pylist(), batch.column("b"), batch.column("w"))):
            data = data.as_buffer().to_pybytes()
            hashes = Hashes(data)
            for w in wanted.as_py():
                p = np.arange(w["p0"], w["p1"])
                rows += [row] * len(p)
                for k, v in (("p0", p), ("n", np.full(len(p), w["n"])), ("h1", hashes.of(p - at, p - at + length).view(np.int64)), ("h2", digests(data, p - at, p - at + length).view(np.int64))):
                    out[k].append(v)
        joined = {k: np.concatenate(v) for k, v in out.items()}
        columns = [pa.array(joined["p0"], pa.int32()), *(pa.array(joined[k], pa.int64()) for k in ("n", "h1", "h2"))]
        yield _with_ids(batch, rows, columns, SINGLES)


def spans(starts: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte runs that strings starting in the given runs cover."""
    out: list[list[int]] = []
    for a, b in sorted((a, b - 1 + length) for a, b in starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


REMOVED = "n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(data: pd.Series, starts: pd.Series, keep: bool, length: int) -> pd.DataFrame:
    out = []
    for b, s in zip(data, starts):
        gone = spans([(x["p0"], x["p1"]) for x in s], length) if s is not None else []
        kept = b
        if gone:
            kept = b"".join(b[x:y] for x, y in zip([0, *(y for _, y in gone)], [*(x for x, _ in gone), len(b)]))
        out.append((sum(y - x for x, y in gone), len(gone), hashlib.sha256(kept).hexdigest(), kept if keep else None))
    return pd.DataFrame(out, columns=[x.split()[0] for x in REMOVED.split(", ")])


def remove_repeats(docs: DataFrame, text: str = "text", keep_bytes: bool = False, columns: tuple[str, ...] = (), length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats``, the named columns of ``docs`` and, if asked for, ``kept``.

    ``repeats`` is 1 where a sampled string of about half the length stands in another row too: of what is removed only
    that which other rows share, and passages that are too short to be removed.
    """
    with temporary_tables(docs.sparkSession):
        starts = materialize(repeated_starts(docs, text, length), "starts", keep=True).alias("s")
    body = blank(text)
    rows = docs.select("doc_id", F.struct(*map(quoted, columns)).alias("_own") if columns else F.lit(None).alias("_own"), text_key(text).alias("t"), body.cast("binary").alias("b")).alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.t") == F.col("s.t"))
    joined = rows.join(starts, same, "left").select("r.doc_id", "r._own", "r.b", "s.starts", "s.across")

    @F.pandas_udf(REMOVED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for data, runs in batches:
            yield _remove(data, runs, keep_bytes, length)
        give_back()

    done = joined.select("doc_id", "_own", F.length("b").cast("long").alias("n_bytes"), F.coalesce(F.col("across").cast("int"), F.lit(0)).alias("repeats"), run("b", "starts").alias("x"))
    own = [F.col(f"_own.{quoted(c)}").alias(c) for c in columns]
    return done.select("doc_id", "n_bytes", "x.n_removed", "x.n_spans", "x.kept_sha256", "repeats", *own, *(["x.kept"] if keep_bytes else []))


def whole_characters(kept: pd.Series) -> pd.Series:
    """Kept bytes as text, without the parts of characters that a removal cut through."""
    return kept.map(lambda b: b.decode("utf-8", "ignore"))


def without_repeats(docs: DataFrame, text: str = "text", columns: tuple[str, ...] = (), length: int = LENGTH) -> DataFrame:
    """Documents that something is left of, with what is left as their text; empty texts stay as they are."""
    names = {c: f"_own_{k}" for k, c in enumerate(columns)}
    own = docs.select("doc_id", text, *(F.col(quoted(c)).alias(n) for c, n in names.items()))
    done = remove_repeats(own, text, True, tuple(names.values()), length).filter((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0))
    return done.select("doc_id", F.pandas_udf(whole_characters, "string")("kept").alias(text), *(F.col(n).alias(c) for c, n in names.items()))
