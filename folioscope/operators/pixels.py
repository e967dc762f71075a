"""Pixel statistics: histograms, peaks, shades, levels and colourfulness, from value or key counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UP_TO = (Window.unboundedPreceding, 0)


def histogram(pixels: DataFrame) -> DataFrame:
    """256 bins of each image, empty ones included, from ``image, v``."""
    counts = pixels.groupBy("image", "v").agg(F.count("*").alias("n"))
    # an image has 256 counts at most, so they fit a map; one scan, no join
    bins = counts.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.coalesce(F.try_element_at("m", v), F.lit(0)))
    return bins.select("image", F.posexplode(dense).alias("v", "n"))


def level_runs(hist: DataFrame, limit: int = 60, percent: float | None = 0.25, white: bool = False) -> DataFrame:
    """Level stretches of the dark (or light) end of dense histograms, and which of them are peaks.

    A peak stands above both neighbours, beyond the ends zero; its place is the
    stretch's middle, rounded down.  ``enough``: it holds ``percent`` of all pixels.
    """
    image = Window.partitionBy("image")
    total = F.sum("n").over(image)
    hist = hist.withColumn("least", F.ceil(total * F.lit((percent or 0.0) / 100)))
    end = hist.filter(F.col("v") >= 255 - limit if white else F.col("v") <= limit)
    order = image.orderBy("v")
    change = (F.col("n") != F.lag("n", 1, -1).over(order)).cast("int")
    runs = end.withColumn("run", F.sum(change).over(order.rowsBetween(*_UP_TO)))
    runs = runs.groupBy("image", "run").agg(F.first("n").alias("n"), F.min("v").alias("l"), F.max("v").alias("r"), F.first("least").alias("least"))
    order = image.orderBy("run")
    is_peak = (F.col("n") > F.lag("n", 1, 0).over(order)) & (F.col("n") > F.lead("n", 1, 0).over(order))
    return runs.select("image", F.floor((F.col("l") + F.col("r")) / 2).cast("int").alias("bin"), F.col("n").alias("height"), (F.col("n") >= F.col("least")).alias("enough"), is_peak.alias("is_peak"))


def local_peaks(hist: DataFrame, limit: int = 60, percent: float | None = 0.25, white: bool = False) -> DataFrame:
    return level_runs(hist, limit, percent, white).filter("is_peak").drop("is_peak")


def prominences(peaks: DataFrame, hist: DataFrame, limit: int = 60, white: bool = False) -> DataFrame:
    """``prominence`` of peaks: their height over the higher of the lowest bins on the way to a higher bin, or to the end, on each side."""
    end = hist.filter(F.col("v") >= 255 - limit if white else F.col("v") <= limit).select("image", "v", "n")
    j = peaks.join(end, "image")
    low, high = (0, limit) if not white else (255 - limit, 255)
    above = F.col("n") > F.col("height")
    near = j.groupBy(*peaks.columns).agg(F.max(F.when(above & (F.col("v") < F.col("bin")), F.col("v"))).alias("lo"), F.min(F.when(above & (F.col("v") > F.col("bin")), F.col("v"))).alias("hi"))
    j = near.join(end, "image")
    left = F.min(F.when((F.col("v") <= F.col("bin")) & (F.col("v") > F.coalesce("lo", F.lit(-1))), F.col("n")))
    right = F.min(F.when((F.col("v") >= F.col("bin")) & (F.col("v") < F.coalesce("hi", F.lit(256))), F.col("n")))
    out = j.groupBy(*near.columns).agg(left.alias("_l"), right.alias("_r"))
    # the padding beyond the ends is zero
    left, right = F.when(F.col("lo").isNull(), 0).otherwise(F.col("_l")), F.when(F.col("hi").isNull(), 0).otherwise(F.col("_r"))
    return out.withColumn("prominence", F.col("height") - F.greatest(left, right)).select(*peaks.columns, "prominence")


def pick_peak(runs: DataFrame, white: bool = False) -> DataFrame:
    """The highest peak that is high enough, else the highest one, else the end of the range; the lower bin on ties."""
    best = lambda only: F.max(F.when(only, F.struct("height", (-F.col("bin")).alias("b"))))
    picked = runs.groupBy("image").agg(best(F.col("is_peak") & F.col("enough")).alias("x"), best(F.col("is_peak")).alias("y"))
    return picked.select("image", F.coalesce(-F.col("x.b"), -F.col("y.b"), F.lit(255 if white else 0)).alias("level"))


def shades(pixels: DataFrame, threshold: float = 0.01, exact_values: bool = False) -> DataFrame:
    """Shades that more than ``threshold`` percent of an image's pixels have.

    A shade is one of 256 equal bins over the image's own range of values,
    unless ``exact_values``.
    """
    counts = pixels.groupBy("image", "v").agg(F.count("*").alias("n"))
    whole = counts.groupBy("image").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    b = counts.join(whole, "image")
    shade = F.when(F.col("lo") == F.col("hi"), 128).otherwise(F.least(F.lit(255), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 256)))
    b = b.withColumn("shade", F.col("v") if exact_values else shade.cast("int"))
    b = b.groupBy("image", "shade", "total").agg(F.sum("n").alias("n"))
    return b.filter(F.col("n") > F.ceil(F.col("total") * F.lit(threshold / 100))).select("image", "shade", "n", (F.col("n") / F.col("total") * 100).alias("pct"))


def bit_depth(n: Column) -> Column:
    bits = F.ceil(F.log2(n))
    return F.when(n <= 1, 1).otherwise(F.pow(F.lit(2), F.ceil(F.log2(F.greatest(bits, F.lit(1)))))).cast("int")


def padded_shades(found: DataFrame) -> DataFrame:
    """Each image's shades cut down or filled with white to 2, 4, 16 or 256."""
    ordered = found.groupBy("image").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), "shade"))).alias("s"))
    n = F.size("s")
    bits = F.ceil(F.log2(n.cast("double")))
    near = F.when(bits <= 1, 1).when(bits <= 3, 2).when(bits <= 6, 4).otherwise(8)
    target = F.pow(F.lit(2), near).cast("int")
    by_share = F.transform("s", lambda x: x.shade)
    filled = F.concat(by_share, F.array_repeat(F.lit(255), F.greatest(target - n, F.lit(0))))
    return ordered.select("image", n.alias("n_shades"), F.when(n <= 1, by_share).when(target < n, F.slice(F.array_sort(by_share), 1, target)).otherwise(filled).alias("palette"))


def is_gray(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image").agg(F.bool_and((F.col("r") == F.col("g")) & (F.col("r") == F.col("b"))).alias("is_gray"))


def colour_keys(pixels: DataFrame) -> DataFrame:
    """How many pixels of an image have each integer colourfulness key ``4(r-g)^2 + (r+g-2b)^2``."""
    d2 = 4 * F.pow(F.col("r") - F.col("g"), F.lit(2)) + F.pow(F.col("r") + F.col("g") - 2 * F.col("b"), F.lit(2))
    return pixels.groupBy("image", d2.cast("long").alias("d2")).agg(F.count("*").alias("n"))


def colourfulness(d2: Column) -> Column:
    return F.least(F.sqrt(d2 / 4.0), F.lit(285.0)) / 285.0


def top_colours(keys: DataFrame, top: int = 17) -> DataFrame:
    """The ``top`` most colourful pixels of each image, as counts by key."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("image").orderBy(F.desc("d2")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return keys.withColumn("taken", F.greatest(F.least(F.col("n"), F.lit(top) - before), F.lit(0)))


def colour_features(keys: DataFrame, top: int = 17) -> DataFrame:
    """Moments and order statistics of colourfulness without the ``top`` largest pixels, from key counts."""
    rest = top_colours(keys, top).select("image", "d2", (F.col("n") - F.col("taken")).alias("w")).filter("w > 0").withColumn("d", colourfulness(F.col("d2")))
    s = lambda k: F.sum(F.col("w") * F.pow("d", F.lit(float(k))))
    sums = rest.groupBy("image").agg(F.sum("w").alias("n"), *(s(k).alias(f"s{k}") for k in (1, 2, 3, 4)))
    m = sums.withColumn("mean", F.col("s1") / F.col("n"))
    n, mu = F.col("n"), F.col("mean")
    m2 = F.greatest(F.col("s2") / n - mu * mu, F.lit(0.0))
    m3 = F.col("s3") / n - 3 * mu * F.col("s2") / n + 2 * mu * mu * mu
    m4 = F.col("s4") / n - 4 * mu * F.col("s3") / n + 6 * mu * mu * F.col("s2") / n - 3 * mu * mu * mu * mu
    zero = F.lit(0.0)
    moments = m.select("image", "n", "mean", F.sqrt(m2).alias("std"), F.when(m2 > 0, m3 / F.pow(m2, F.lit(1.5))).otherwise(zero).alias("skew"), F.when(m2 > 0, m4 / (m2 * m2) - 3).otherwise(zero).alias("kurt"), F.sqrt("s2").alias("l2"))
    upto = F.sum("w").over(Window.partitionBy("image").orderBy("d2").rowsBetween(*_UP_TO))
    ordered = rest.withColumn("upto", upto).join(sums.select("image", "n"), "image")

    def at(q: float) -> Column:
        # linear between the two pixels around place q * (n - 1)
        place = (F.col("n") - 1) * F.lit(q)
        low = F.min(F.when(F.col("upto") > F.floor(place), F.col("d")))
        high = F.min(F.when(F.col("upto") > F.ceil(place), F.col("d")))
        part = F.first(place - F.floor(place))
        return low + (high - low) * part

    q = ordered.groupBy("image").agg(*(at(x).alias(f"q{int(x * 100)}") for x in (0.0, 0.25, 0.5, 0.75, 1.0)))
    return moments.join(q, "image").withColumn("iqr", F.col("q75") - F.col("q25")).withColumn("median_r", F.rint(F.col("q50") * 1000) / 1000)


def threshold_shares(keys: DataFrame, least: float, ks: Sequence[int] = (2, 16, 128, 1024)) -> DataFrame:
    """Pixels of at least a colourfulness, as shares of small counts."""
    hits = keys.groupBy("image").agg(F.sum(F.when(colourfulness(F.col("d2")) >= least, F.col("n")).otherwise(0)).alias("hits"))
    return hits.select("image", "hits", *((F.least(F.col("hits"), F.lit(k)) / k).alias(f"t{k}") for k in ks))


def gamma_of(black: Column) -> Column:
    """Gamma that keeps the middle where a black level moves; null from 128 on."""
    b = black / 255.0
    return F.when(black == 0, 1.0).when(black <= 127, F.rint(F.log((0.5 - b) / (1 - b)) / F.log(F.lit(0.5)) * 100) / 100)


def level(v: Column, black: Column, white: Column, gamma: Column) -> Column:
    x = F.pow((v - black) / (white - black), 1 / gamma)
    return F.when(v < black, 0).when(v > white, 255).otherwise(F.rint(x * 255)).cast("int")


def level_lut(levels: DataFrame) -> DataFrame:
    """The 256 output values of each row's black, white and gamma."""
    v = levels.select("*", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    return v.withColumn("out", level(F.col("v"), F.col("black"), F.col("white"), F.col("gamma")))


def level_params(black: Column, white: Column, offset: int = 0) -> Column:
    pct = lambda x: F.rint(x / 255.0 * 10000) / 100
    return F.concat((pct(black) + offset).cast("string"), F.lit(","), pct(white).cast("string"), F.lit("%,"), gamma_of(black).cast("string"))


def level_decision(black: Column, white: Column, is_color: Column, limit: int = 60, skip_white: bool = False) -> Column:
    """What to do with an image, by its levels."""
    bad_black, bad_white = black <= 0, white >= 255
    leave = (bad_black & bad_white) | (bad_black & F.lit(skip_white)) | (black > limit)
    return F.when(leave & ~is_color, "GRAYSCALED").when(leave, "COPIED").otherwise("PROCESSED")


def posterize(v: Column, bits: int) -> Column:
    c = 2**bits
    return v if bits == 8 else F.floor(F.rint(v * F.lit(float(c - 1)) / 255) * 255 / (c - 1)).cast("int")


def autoposterize(size: Column) -> Column:
    bits = F.greatest(F.floor(F.log2(size.cast("double"))), F.lit(1)).cast("int")
    return F.struct(bits.alias("bits"), F.when(bits >= 8, "COPIED").otherwise("PROCESSED").alias("status"))


def nearest_shade(v: Column, palette: Column) -> Column:
    return F.array_min(F.transform(palette, lambda s: F.struct(F.abs(s - v).alias("d"), s.alias("s")))).getField("s")


def to_gray(r: Column, g: Column, b: Column) -> Column:
    return F.floor(r * 0.299 + g * 0.587 + b * 0.114 + 0.5).cast("int")


def contrast_stretch(pixels: DataFrame, value: str = "v") -> DataFrame:
    """``stretched``: values over their image's range, 0 where it has none.

    The range is found by grouping, as an image's pixels may not fit one window.
    """
    span = pixels.groupBy("image").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    stretched = F.when(F.col("hi") > F.col("lo"), (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return pixels.join(span, "image").withColumn("stretched", stretched).drop("lo", "hi")
