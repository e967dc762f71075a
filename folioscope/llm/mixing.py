"""Mixing sources to target weights, by fitting subset sums to word budgets.

A source's target is its share by weight of the words the mix is to have, but at
most ``most`` times its size; what it can't take goes to the others by weight.
Every document is taken as often as fits the target as a whole, and what is left
of the budget is filled with further copies, one of a document at most:

* documents are counted by (source, size); a source's counts are one row for
  each distinct size, of which w words can have no more than sqrt(2 w);
* of each size the same share is taken, rounded down, then more of those that
  lost most by rounding, until the rest of the budget is small;
* a bounded-knapsack dynamic program over that rest (a bit for each sum of words)
  finds how many more of each size come nearest to it;
* of the documents of a size those with the least seeded hash are taken.

That choice ranks nothing but bounded groups: a size's documents are cut into
ranges of the hash, counts tell which range the last one taken is in, and only
inside it hashes are compared.  Texts are read once, for sizes and hashes; all
else moves rows of a few numbers.

Defined results: a null text has no words; a null source is a source, the last
one; rows that are equal in all of (doc_id, source, text) are chosen like any
other, which of them being the same; a source without words has target zero; an
empty table gives no rows.  Two runs agree: nothing depends on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blank, free_name, materialize, temporary_tables

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, 42
WORD = r"[^\x20\x09-\x0D]+"
#: Largest rest of a budget that the dynamic program fills.
REST = 1 << 16
#: Documents of a size that are ranked together, on average.
RANKED = 4096


# budgets ---------------------------------------------------------------------------------------------------------------


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """``source, source_size, rank``: from 0, by code points, null last; ``sizes`` has a row for each source.

    Ranges of sources are counted and numbered one behind the other, so no task
    sees all of them; what meets the driver is a count for each partition.
    """
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sizes.repartitionByRange(*order).select("*", F.spark_partition_id().alias("p"))
    dealt = materialize(dealt, "sources")
    counts = {r["p"]: r["n"] for r in dealt.groupBy("p").agg(F.count("*").alias("n")).collect()}
    before, at = {}, 0
    for p in sorted(counts):
        before[p], at = at, at + counts[p]
    ahead = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("p")] if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("p").orderBy(*order)) - 1
    return dealt.select("source", "source_size", (place + ahead).cast("long").alias("rank"))


def with_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target``: what is left of the budget by weight, or ``most`` times the size where that is less.

    Each round settles the sources that the current level would carry beyond
    their bound; the level only rises, so none is settled too early.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = materialize(sources.withColumn("weight", weight), "weighted")
    bound = F.col("source_size") * F.lit(float(most))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget, level, settled = share * total, -1.0, -1
    while True:
        full = bound <= F.col("weight") * F.lit(level)
        row = sources.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("size"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if row["n"] == settled or not row["w"]:
            break
        settled, level = row["n"], (budget - most * row["size"]) / row["w"]
    return sources.withColumn("target", F.when(full, bound).otherwise(F.col("weight") * F.lit(level)).cast("double")).drop("weight", "rank")


def nearest_sum(sizes: np.ndarray, counts: np.ndarray, wanted: int) -> np.ndarray:
    """How many of each size come nearest to ``wanted`` in sum (of two as near the smaller), by dynamic programming.

    A size's count is cut into powers of two, each an item of its own; ``item``
    holds for every sum the first item by which it is reached, and the sum left
    without that item was reached by earlier ones.
    """
    taken = np.zeros(len(sizes), np.int64)
    if wanted <= 0:
        return taken
    top = 2 * wanted
    reached, item = np.zeros(top + 1, bool), np.full(top + 1, -1, np.int32)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for k in np.argsort(-sizes, kind="stable").tolist():
        size, left, some = int(sizes[k]), int(min(counts[k], top // max(int(sizes[k]), 1))), 1
        while left > 0 and not reached[wanted]:
            n = min(some, left)
            left, some = left - n, some * 2
            if n * size <= top:
                fresh = np.flatnonzero(reached[: top + 1 - n * size] & ~reached[n * size :]) + n * size
                reached[fresh], item[fresh] = True, len(items)
                items.append((k, n))
        if reached[wanted]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - wanted))])
    while at:
        k, n = items[item[at]]
        taken[k] += n
        at -= n * int(sizes[k])
    return taken


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size (above zero) to take, at most ``counts``, for a sum of words near ``budget``."""
    total = sum(int(s) * int(c) for s, c in zip(sizes, counts))
    if budget >= total:
        return counts.copy()
    if 2 * budget > total:
        # what is left out is the smaller sum
        return counts - fit(sizes, counts, total - budget)
    # Python's whole numbers: counts times budgets don't fit 64 bits
    exact = [divmod(int(c) * budget, total) for c in counts]
    taken, lost = np.array([q for q, _ in exact], np.int64), [r for _, r in exact]
    rest = budget - sum(int(s) * int(t) for s, t in zip(sizes, taken))
    longest = np.argsort(-sizes, kind="stable").tolist()
    # once more of those that lost most, then the longest as often as they fit; some of the rest is kept, so that it can be met
    for order, most, kept in ((sorted(range(len(sizes)), key=lambda k: (-lost[k], k)), 1, REST // 2), (longest, rest, REST // 2), (longest, rest, 0)):
        for k in order:
            if rest <= REST:
                break
            n = min(int(counts[k] - taken[k]), (rest - kept) // int(sizes[k]), most)
            if n > 0:
                taken[k] += n
                rest -= n * int(sizes[k])
    spare = counts - taken
    if rest <= REST:
        return taken + nearest_sum(sizes, spare, rest)
    # all that is left is longer than the rest: one more, if that is nearer than none
    for k in [k for k in reversed(longest) if spare[k] > 0][:1]:
        taken[k] += int(sizes[k]) - rest < rest
    return taken


def takings(counted: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, size, n, passes, more``: each document is taken ``passes`` times, and ``more`` of the size's once again."""
    out = "source string, size long, n long, passes long, more long"

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        size, n = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        passes = int(target // total)
        left = max(0, round(target - passes * total))
        return rows[["source", "size", "n"]].assign(passes=passes, more=fit(size, n, left))

    both = counted.filter("size > 0").join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return both.groupBy("source").applyInPandas(plan, out)


# documents -------------------------------------------------------------------------------------------------------------


def chosen(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (``source, size, h``) with ``taken``, the number of copies.

    ``h`` is cut into as many ranges as a size has thousands of documents; a
    range before the last one taken is taken whole, one behind it not at all.
    """
    ranges = F.greatest(F.ceil(F.col("n") / RANKED), F.lit(1))
    # the upper 31 bits of the hash, as a share of their range
    cut = F.floor(F.shiftrightunsigned("h", 33) * ranges / F.lit(float(1 << 31))).cast("int")
    planned = plan.withColumnRenamed("source", "_s").withColumnRenamed("size", "_z")
    met = rows.join(planned, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left").drop("_s", "_z")
    met = met.withColumn("range", F.when(F.col("more") > 0, cut).otherwise(-1))
    met = materialize(met, "met")
    open_ = met.filter("more > 0 and more < n")
    ahead = F.sum("own").over(Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    held = open_.groupBy("source", "size", "range").agg(F.count("*").alias("own"), F.first("more").alias("all"))
    held = held.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("range").alias("_r"), "own", (F.col("all") - F.coalesce(ahead, F.lit(0))).alias("quota"))
    met = met.join(held, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("range") == F.col("_r")), "left").drop("_s", "_z", "_r")
    split = (F.col("quota") > 0) & (F.col("quota") < F.col("own"))
    # only ranges that are split are ranked; the others have their answer
    whole = F.when(F.col("own").isNull(), F.coalesce("more", F.lit(0)) > 0).otherwise(F.col("quota") >= F.col("own"))
    split_rows = met.filter(F.coalesce(split, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("source", "size", "range").orderBy("h", F.col("doc_id").asc_nulls_last()))
    one = split_rows.withColumn("extra", (rank <= F.col("quota")).cast("int"))
    rest = met.filter(~F.coalesce(split, F.lit(False))).withColumn("extra", whole.cast("int"))
    both = rest.unionByName(one)
    copies = F.coalesce("passes", F.lit(0)) + F.col("extra")
    return both.withColumn("taken", copies.cast("long")).drop("n", "passes", "more", "range", "own", "quota", "extra")


def _copies(docs: DataFrame, weights: tuple[float, ...], share: float, most: int, seed: int) -> DataFrame:
    """``mix`` with each row's hash ``h``."""
    if most < 1 or int(most) != most or not weights or min(weights) <= 0:
        raise ValueError("weights must be above zero, and a document's copies a whole number")
    with temporary_tables(docs.sparkSession):
        rows = docs.select("doc_id", "source", F.regexp_count(blank("text"), F.lit(WORD)).cast("long").alias("size"), row_hash(seed).alias("h"))
        rows = materialize(rows, "sizes")
        # counted once; the sources' sizes are sums over the counts
        counted = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "counted")
        sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
        sources = with_targets(numbered_sources(sizes), weights, share, most).withColumnRenamed("source", "_source")
        sources = materialize(sources, "targets", keep=True)
        plan = materialize(takings(counted, sources), "plan")
        picked = materialize(chosen(rows, plan).withColumnRenamed("taken", "copies"), "picked", keep=True)
    return picked.join(sources, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def row_hash(seed: int) -> Column:
    return F.xxhash64("doc_id", F.coalesce("source", F.lit("")), blank("text"), F.lit(seed))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies``: how often the mix takes each document.

    ``weights`` go to the sources in order, again and again; ``share`` is the
    size of the mix in sizes of the corpus; no document is taken more than
    ``most`` times.
    """
    return _copies(docs, weights, share, most, seed).select("doc_id", "source", "size", "source_size", "target", "copies")


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs``, and ``copy``, from 0, of each time a document is taken.

    Of rows that are equal in id, source and text one stands for all, with all their
    copies.  A column ``copy`` stays under its name; the new one gets underscores in front.
    """
    copies = _copies(docs, weights, share, most, seed).groupBy("h").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    key, many, out = free_name(docs, "h"), free_name(docs, "copies"), free_name(docs, "copy")
    rows = docs.withColumn(key, row_hash(seed)).join(copies.select(F.col("h").alias(key), F.col("copies").alias(many)), key).dropDuplicates([key])
    return rows.withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1))).drop(key, many)
