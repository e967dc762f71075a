"""User models over features, and tiled scoring of images."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vote(heads: Column) -> dict[str, Column]:
    """Mean of a model's heads: the class, and how sure it is in percent."""
    p = F.aggregate(heads, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size(heads))
    return {"is_color": p >= 0.5, "confidence": F.floor(F.greatest(p, 1 - p) * 100).cast("int"), "should_convert": F.lit(False)}


def score_features(df: DataFrame, features: list[str], make_predict: Callable, n_heads: int, batch_size: int = 1024) -> DataFrame:
    """Add a user model's heads; the model is loaded once in each worker."""
    from pyspark.sql.types import ArrayType, DoubleType

    run = predict_batch_udf(make_predict, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=[[len(features)]])
    return df.withColumn("heads", run(F.array(*(F.col(c).cast("double") for c in features))))


def guarded_scores(df: DataFrame, decided: Column, answers: dict[str, Column], features: list[str], make_predict: Callable, n_heads: int, batch_size: int = 1024) -> DataFrame:
    """``is_color, confidence, should_convert``: ``answers`` where the cheap test ``decided`` holds, the model's vote elsewhere.

    Only undecided rows reach the model's workers: a condition around a model's
    column would still send all rows there.
    """
    sure = F.coalesce(decided, F.lit(False))
    asked = score_features(df.filter(~sure), features, make_predict, n_heads, batch_size)
    voted = asked.withColumns(vote(F.col("heads"))).drop("heads")
    return df.filter(sure).withColumns({k: answers[k].cast(voted.schema[k].dataType) for k in ("is_color", "confidence", "should_convert")}).unionByName(voted)


def tile_starts(length: Column, tile: int, overlap: int) -> Column:
    stride = tile - 2 * overlap
    if stride < 1:
        raise ValueError("the overlap leaves no stride")
    n = F.greatest(F.ceil(F.greatest(length - tile, F.lit(0)) / stride) + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: k * stride)


def tile_score(pixels: DataFrame, tile: int, overlap: int, predict: Callable[[np.ndarray], np.ndarray], keys: tuple[str, ...] = ("image",), scale: int = 1, padding: int = 0) -> DataFrame:
    """Score overlapping tiles of images ``(keys), y, x, v`` and blend them: ``(keys), y, x, out``.

    A tile is the largest thing a task holds.  Weights fall off towards a
    tile's edges; the blend is their weighted mean, clipped to 0..255.  A model
    that gives back tiles ``scale`` times as large makes images as much larger;
    what a tile has beyond its image is ``padding``.
    """
    size = pixels.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    stride = tile - 2 * overlap
    ys = lambda c, n: F.transform(F.sequence(F.greatest(F.ceil((c - tile + 1) / stride), F.lit(0)), F.least(F.floor(c / stride), F.greatest(F.ceil((n - tile) / stride), F.lit(0)))), lambda k: k.cast("int") * stride)
    at = [*keys, "ty", "tx"]
    placed = pixels.join(size, [*keys]).select(*keys, "y", "x", "v", F.explode(ys(F.col("y"), F.col("h"))).alias("ty"), "w")
    placed = placed.select(*keys, "y", "x", "v", "ty", F.explode(ys(F.col("x"), F.col("w"))).alias("tx"))
    side, feather = tile * scale, max(1, 2 * overlap * scale)
    ramp = np.minimum(np.minimum(np.arange(side) + 1, side - np.arange(side)), feather) / feather
    grown = np.arange(scale)

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        """Whole tiles, sorted by tile: each is filled, scored and weighted."""
        cuts = np.flatnonzero((rows[at].to_numpy()[1:] != rows[at].to_numpy()[:-1]).any(axis=1)) + 1
        y, x = (rows["y"] - rows["ty"]).to_numpy(), (rows["x"] - rows["tx"]).to_numpy()
        v = rows["v"].to_numpy() / 255
        # each pixel becomes a square of scale by scale
        ys_, xs_ = (y[:, None] * scale + np.repeat(grown, scale)).ravel(), (x[:, None] * scale + np.tile(grown, scale)).ravel()
        n, out = scale * scale, np.empty(len(rows) * scale * scale)
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            block = np.full((tile, tile), padding / 255)
            block[y[a:b], x[a:b]] = v[a:b]
            out[a * n : b * n] = predict(block)[ys_[a * n : b * n], xs_[a * n : b * n]]
        weight = ramp[ys_] * ramp[xs_]
        repeated = rows[[*keys, "ty", "tx"]].loc[rows.index.repeat(n)].reset_index(drop=True)
        return repeated[[*keys]].assign(y=repeated["ty"].to_numpy() * scale + ys_, x=repeated["tx"].to_numpy() * scale + xs_, wv=out * weight, w=weight)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat((rest, batch), ignore_index=True)
            if rows.empty:
                continue
            tail = (rows[at] == rows[at].iloc[-1]).all(axis=1)
            rest = rows[tail]
            if not tail.all():
                yield score(rows[~tail].reset_index(drop=True))
        if rest is not None:
            yield score(rest.reset_index(drop=True))

    dealt = placed.repartition(*at).sortWithinPartitions(*at).drop("w")
    kinds = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)
    scored = dealt.mapInPandas(run, f"{kinds}, y int, x int, wv double, w double")
    blended = scored.groupBy(*keys, "y", "x").agg((F.sum("wv") / F.sum("w")).alias("s"))
    return blended.select(*keys, "y", "x", F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "s")) * 255).cast("int").alias("out"))


def n_tiles(length: int, tile: int, overlap: int) -> int:
    return max(1, math.ceil(max(0, length - tile) / (tile - 2 * overlap)) + 1)
