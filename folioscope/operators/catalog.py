"""Catalog operators: numbering, selection, grouping and checks of pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running_total

#: Suffixes of image files.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif", "webp", "avif", "heic", "heif", "jxl", "jp2")
#: Suffixes whose images are kept without loss.
LOSSLESS = ("png", "webp", "bmp", "tiff", "tif")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def is_image(name: Column) -> Column:
    return suffix(name).isin(*IMAGE_SUFFIXES)


def number_pages(pages: DataFrame, book: str = "book", name: str = "name", parts: int | None = None) -> DataFrame:
    """Images only, numbered in name order within a book, with the book's count; a book is one window, or with ``parts`` so many."""
    images = pages.filter(is_image(F.col(name)))
    if parts:
        rows = running_total(images, (book,), (name,), F.lit(1).cast("long"), parts)
        return rows.withColumn("index", F.col("_ahead").cast("int")).withColumn("total_count", F.col("_all")).drop("_ahead", "_all")
    inside = Window.partitionBy(book)
    return images.withColumn("index", F.row_number().over(inside.orderBy(name)) - 1).withColumn("total_count", F.count("*").over(inside))


def books(paths: DataFrame, path: str = "path", dir_only: bool = False) -> DataFrame:
    """Child folders, and archives unless ``dir_only``, of a listing."""
    p = F.col(path)
    inside = p.contains("/")
    archive = suffix(p).isin("cbz", "cbr", "cb7")
    found = paths.select(F.when(inside, F.split_part(p, F.lit("/"), F.lit(1))).when(archive, p).alias("book"), F.when(inside, "folder").otherwise(suffix(p)).alias("container"))
    found = found.filter("book is not null").distinct()
    return found.filter("container = 'folder'") if dir_only else found


def container_kind(head: Column) -> Column:
    """The kind of an archive by its first bytes, else null."""
    h = F.hex(head)
    return F.when(h.startswith("504B0304") | h.startswith("504B0506"), "CBZ").when(h.startswith("526172211A07"), "RAR").when(h.startswith("377ABCAF271C"), "SEVENZIP").when(F.substring(h, 515, 10) == "7573746172", "TAR")


def select_pages(pages: DataFrame, wanted: str, page: str = "page") -> DataFrame:
    """Pages of a list like ``1-5,10,odd,even``: counted from 1, kept as indexes from 0; all if the list is empty."""
    tests: list[Column] = []
    for item in filter(None, (x.strip().lower() for x in wanted.split(","))):
        if item in ("odd", "even"):
            tests.append(F.col(page) % 2 == (1 if item == "even" else 0))
            continue
        first, _, last = item.partition("-")
        a, b = int(first), int(last or first)
        if a < 1:
            raise ValueError("pages are counted from 1")
        tests.append(F.col(page).between(a - 1, b - 1))
    return pages.filter(reduce(lambda x, y: x | y, tests)) if tests else pages


def skip_action(pages: DataFrame, skips: DataFrame, keys: Sequence[str] = ("book", "step", "page")) -> DataFrame:
    """Add the skip list's ``action`` of this step, null if the page isn't listed."""
    return pages.join(skips.select(*keys, "action").dropDuplicates([*keys]), [*keys], "left")


def skip_existing(pages: DataFrame, manifest: DataFrame, keys: Sequence[str] = ("book", "name")) -> DataFrame:
    return pages.join(manifest.select(*keys).distinct(), [*keys], "left_anti")


def color_flag(pages: DataFrame, listed: DataFrame, detected: DataFrame, computed: Column) -> DataFrame:
    """``is_color`` of a page: by the configured list, else the detected one, else as computed; false without a page number."""
    a = listed.select("book", "page", F.lit(True).alias("_listed")).distinct()
    b = detected.select("book", "page", F.lit(True).alias("_detected")).distinct()
    out = pages.join(a, ["book", "page"], "left").join(b, ["book", "page"], "left")
    flag = F.when(F.col("page").isNull(), False).otherwise(F.coalesce("_listed", "_detected", computed))
    return out.withColumn("is_color", flag).drop("_listed", "_detected")


def route_by_color(is_color: Column, can_convert: Column, ext: Column) -> Column:
    return F.when(is_color, "color").when(can_convert & ext.isin(*LOSSLESS), "regray").otherwise("keep")


def image_sizes(pages: DataFrame) -> DataFrame:
    size = F.concat_ws("x", "width", "height")
    return pages.groupBy("book", size.alias("size")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("name")).alias("names"))


def status_counts(pages: DataFrame, status: str = "status") -> DataFrame:
    return pages.groupBy(status).agg(F.count("*").alias("n"))


def denoise_level(quality: Column) -> Column:
    """Denoising that a JPEG quality calls for: -1 none, then 0 to 3."""
    return F.when((quality < 0) | (quality > 95), -1).when(quality >= 92, 0).when(quality >= 81, 1).when(quality >= 69, 2).otherwise(3)


def quality_histogram(images: DataFrame, quality: str = "quality") -> DataFrame:
    return images.groupBy(quality).agg(F.count("*").alias("n")).withColumn("level", denoise_level(F.col(quality)))


def join_size(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The size, mode and suffix of each joined spread."""
    ext = suffix(F.col("name"))
    any_png, all_webp, any_webp = F.bool_or(ext == "png"), F.bool_and(ext == "webp"), F.bool_or(ext == "webp")
    pick = F.when(any_png, "png").when(all_webp, "webp").when(any_webp, "png").otherwise("jpg")
    return pages.groupBy(*keys).agg(F.sum("width").alias("width"), F.max("height").alias("height"), F.when(F.bool_and(F.col("mode") == "L"), "L").otherwise("RGB").alias("mode"), pick.alias("ext"), F.count("*").alias("n"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def unsorted_starts(chapters: DataFrame) -> DataFrame:
    """Chapters that don't start after the one before them."""
    before = F.lag("start").over(Window.partitionBy("book").orderBy("ord"))
    return chapters.withColumn("before", before).filter("start <= before")


def merge_books(parts: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Pages of several books as one, by their base names; and the names that collide."""
    if len(parts) < 2:
        raise ValueError("at least two books are needed")
    merged = reduce(DataFrame.unionByName, (p.withColumn("name", F.regexp_extract("name", r"([^/]*)$", 1)) for p in parts))
    return merged, duplicates(merged, ["name"])


def resize(width: Column, height: Column, mode: str, w: float | None = None, h: float | None = None) -> tuple[Column, Column]:
    """New size by ``exact``, ``width``, ``height``, ``fit`` or ``multiply``; fractions are cut off."""
    if any(x is not None and x <= 0 for x in (w, h)):
        raise ValueError("sizes must be above zero")
    if mode == "exact":
        return F.lit(int(w)), F.lit(int(h))
    if mode == "width":
        return F.lit(int(w)), (height * (F.lit(float(w)) / width)).cast("int")
    if mode == "height":
        return (width * (F.lit(float(h)) / height)).cast("int"), F.lit(int(h))
    ratio = F.lit(float(w)) if mode == "multiply" else F.least(F.lit(float(w)) / width, F.lit(float(h)) / height)
    return (width * ratio).cast("int"), (height * ratio).cast("int")


def crop(width: Column, height: Column, left: int, top: int, right: int, bottom: int) -> Column:
    return F.struct(F.lit(left).alias("x0"), F.lit(top).alias("y0"), (width - right).alias("x1"), (height - bottom).alias("y1"))


def split_spread(pages: DataFrame) -> DataFrame:
    """A joined page ``a-b`` as its two pages, half as wide each."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    half = lambda p, w: F.struct(p.alias("page"), w.alias("half_width"))
    left = F.floor(F.col("width") / 2).cast("int")
    two = F.array(half(low, left), half(high, (F.col("width") - left).cast("int")))
    return pages.filter("b is not null").select("*", F.explode(two).alias("_h")).select("*", "_h.*").drop("_h")


def gen_volumes(spark, n: int) -> DataFrame:
    if n < 1 or int(n) != n:
        raise ValueError("a whole number of volumes is needed")
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("number"), F.concat(F.lit("v"), F.format_string("%02d", "id")).alias("path"))
