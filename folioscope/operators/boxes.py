"""Page boxes: tests and arithmetic on corner coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_wide(mx0: Column, mx1: Column, cx0: Column, cx1: Column, factor: float = 2.0) -> Column:
    return (mx1 - mx0) > (cx1 - cx0) * factor


def _exact(x: Column) -> Column:
    return F.round(x, 4).cast("decimal(18,4)")


def expand(x0: Column, y0: Column, x1: Column, y1: Column, top: float, right: float, bottom: float, left: float) -> Column:
    zero = F.lit(0.0)
    return F.struct(_exact(F.greatest(zero, x0 - left)).alias("x0"), _exact(F.greatest(zero, y0 - top)).alias("y0"), _exact(x1 + right).alias("x1"), _exact(y1 + bottom).alias("y1"))


def widen(mx0: Column, mx1: Column, cx0: Column, cx1: Column, side: str = "right") -> Column:
    """The box's ends, moved out to mirror the margin on the other side."""
    if side == "right":
        return F.struct(_exact(cx0).alias("x0"), _exact(F.least(mx1, mx1 - (cx0 - mx0))).alias("x1"))
    return F.struct(_exact(F.greatest(mx0, mx0 + (mx1 - cx1))).alias("x0"), _exact(cx1).alias("x1"))


def inherit(nodes: DataFrame, most_depth: int = 16) -> DataFrame:
    """``page, box``: each page's own box, or that of its nearest ancestor that has one; else its media box.

    ``nodes`` has ``node, parent, box, media, is_page``.
    """
    found = nodes.filter("is_page").select(F.col("node").alias("page"), "media", "box", F.col("parent").alias("up"))
    above = nodes.select(F.col("node").alias("up"), F.col("parent").alias("_next"), F.col("box").alias("_box"))
    for _ in range(most_depth):
        found = found.join(above, "up", "left").select("page", "media", F.coalesce("box", "_box").alias("box"), F.when(F.col("box").isNull() & F.col("_box").isNull(), F.col("_next")).alias("up"))
    return found.select("page", F.coalesce("box", "media").alias("box"))
