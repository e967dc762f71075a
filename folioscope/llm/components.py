"""Connected components of a link table, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, temporary_tables

MOST_ROUNDS = 40


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(u, v)`` (longs) that isn't itself the least node of its component.

    Alternates large-star and small-star steps: each turns towards the least
    neighbour, so components become stars after a logarithmic number of rounds.
    A hub's links are split by adaptive execution, as both sides of each join
    are plain scans; no neighbour list is ever gathered.
    """
    with temporary_tables(links.sparkSession):
        return materialize(_stars(links), "stars", keep=True)


def _stars(links: DataFrame) -> DataFrame:
    """The same, as a plan over tables that are still there."""
    ordered = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = materialize(ordered, "links")
    before = _digest(links)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v")
        links = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = _digest(links)
        if after == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
