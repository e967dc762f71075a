"""Places, sums and last values along an order, dealt over many tasks within one key.

A window holds a key's rows in one task.  Here a key's order is cut into ranges
by a bounded sample; each range is a window of its own, and what the ranges before
it come to, a row for each range, is brought to its rows by the same partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled rows for each range.
SAMPLED = 32
_BEFORE, _UP_TO = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)


def cut_in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int, seed: int = 7) -> DataFrame:
    """Add ``_range``: rows with a greater (keys, order) have no lesser one; of about ``parts`` even ones.

    A sample of ``SAMPLED * parts`` rows comes to the driver, whatever the size; results don't depend on it.
    """
    columns = [*keys, *order]
    some = df.select(*columns).orderBy(F.rand(seed)).limit(SAMPLED * parts).orderBy(*columns).collect()
    bounds = [some[k] for k in range(SAMPLED, len(some), SAMPLED)]
    if not bounds:
        return df.withColumn("_range", F.lit(0))
    literal = lambda row: F.struct(*(F.lit(row[c]).cast(df.schema[c].dataType).alias(c) for c in columns))
    own = F.struct(*(F.col(c).alias(c) for c in columns))
    return df.withColumn("_range", F.size(F.filter(F.array(*(literal(r) for r in bounds)), lambda b: b <= own)))


def _sorted(names: Sequence[str], descending: bool) -> list[Column]:
    return [F.desc_nulls_last(n) if descending else F.asc_nulls_first(n) for n in names]


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, parts: int, descending: bool = False) -> DataFrame:
    """Add ``_ahead``, the sum of ``amount`` over the rows before (rows equal in order one behind the other), and ``_all``, the key's."""
    rows = cut_in_ranges(df.withColumn("_amount", amount), keys, order, parts)
    rows = rows.withColumn("_key", F.struct(*keys, "_range"))
    inside = Window.partitionBy("_key").orderBy(*_sorted(order, descending))
    rows = rows.withColumn("_own", F.sum("_amount").over(inside.rowsBetween(*_UP_TO)) - F.col("_amount"))
    whole = rows.groupBy("_key").agg(F.sum("_amount").alias("_sum"))
    across = Window.partitionBy(*(f"_key.{k}" for k in keys))
    ahead = F.coalesce(F.sum("_sum").over(across.orderBy(*_sorted(["_key._range"], descending)).rowsBetween(*_BEFORE)), F.lit(0))
    whole = whole.select("_key", ahead.alias("_past"), F.sum("_sum").over(across).alias("_all"))
    return rows.join(whole, "_key").withColumn("_ahead", F.col("_past") + F.col("_own")).drop("_key", "_range", "_amount", "_own", "_past")


def last_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, into: str, parts: int, descending: bool = False) -> DataFrame:
    """Add the last ``value`` that isn't null up to each row, the row's own included."""
    rows = cut_in_ranges(df.withColumn("_value", value), keys, order, parts)
    rows = rows.withColumn("_key", F.struct(*keys, "_range"))
    own = F.last("_value", ignorenulls=True).over(Window.partitionBy("_key").orderBy(*_sorted(order, descending)).rowsBetween(*_UP_TO))
    there = F.when(F.col("_value").isNotNull(), F.struct(*order))
    last = F.min_by("_value", there) if descending else F.max_by("_value", there)
    ends = rows.groupBy("_key").agg(last.alias("_end"))
    across = Window.partitionBy(*(f"_key.{k}" for k in keys)).orderBy(*_sorted(["_key._range"], descending)).rowsBetween(*_BEFORE)
    ends = ends.select("_key", F.last("_end", ignorenulls=True).over(across).alias("_past"))
    found = rows.withColumn("_own", own).join(ends, "_key").withColumn(into, F.coalesce("_own", "_past"))
    return found.drop("_key", "_range", "_value", "_own", "_past")


def places(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int, into: str = "place", descending: bool = False) -> DataFrame:
    """Add each row's place within its key, from 1."""
    rows = running_total(df, keys, order, F.lit(1).cast("long"), parts, descending)
    return rows.withColumn(into, (F.col("_ahead") + 1).cast("int")).drop("_ahead", "_all")
