"""Range assignment and sequences: pages to chapters and spreads, renumbering, shares of base numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import base_of, part_of
from .running import last_value, running_total

_UP_TO = (Window.unboundedPreceding, 0)


def chapter_ends(chapters: DataFrame) -> DataFrame:
    """``end``: the page before the next chapter's start; the last chapter is open."""
    nxt = F.lead("start").over(Window.partitionBy("book").orderBy("start"))
    return chapters.withColumn("end", nxt - 1).withColumn("is_single", nxt.isNull())


def assign_chapters(pages: DataFrame, chapters: DataFrame, columns: tuple[str, ...] = ("ord", "number")) -> DataFrame:
    """Every page with the chapter it falls into, as of its number.

    Chapters and pages of a book meet in one sorted window, so the work is
    linear in both; it needs starts that rise (see ``unsorted_starts``).  Pages
    before the first chapter get nulls.
    """
    own = [c for c in pages.columns if c not in ("book", "page")]
    kept = F.struct(F.col("start"), *(F.col(c) for c in columns))
    starts = chapters.select("book", F.col("start").alias("page"), F.lit(0).alias("_kind"), kept.alias("_ch"))
    rows = pages.select("book", "page", F.lit(1).alias("_kind"), *own)
    both = starts.unionByName(rows, allowMissingColumns=True)
    seen = F.last("_ch", ignorenulls=True).over(Window.partitionBy("book").orderBy("page", "_kind").rowsBetween(*_UP_TO))
    return both.withColumn("_at", seen).filter("_kind = 1").select("book", "page", *own, *(F.col(f"_at.{c}").alias(c) for c in columns), F.col("_at.start").alias("chapter_start"))


#: Bits of a page number; beyond the last page that may be.
_LEVELS, _OPEN = 32, 2147483647


def range_steps(ranges: DataFrame, keys: tuple[str, ...] = ("book",)) -> DataFrame:
    """``page, ord``: the pages from which on the first (by ``ord``) range that holds a page is another one, or none.

    A range is put together of at most two blocks of 2^k pages for each k; a block keeps the first of its ranges.  At the
    ends of ranges, where alone the first one can change, the blocks around are looked up: work goes with the
    number of ranges, however they overlap.
    """
    r = ranges.select(*keys, "ord", F.col("start").cast("long").alias("a"), (F.coalesce("end", F.lit(_OPEN)).cast("long") + 1).alias("z")).filter("a < z")
    blocks = []
    for k in range(_LEVELS + 1):
        low, high = F.shiftright(F.col("a") + ((1 << k) - 1), k), F.shiftright("z", k)
        for block, there in ((low, low % 2 != 0), (high - 1, high % 2 != 0)):
            blocks.append(F.when((low < high) & there, F.struct(F.lit(k).alias("k"), block.alias("block"))))
    cells = r.select(*keys, "ord", F.explode(F.filter(F.array(*blocks), lambda x: x.isNotNull())).alias("c")).groupBy(*keys, "c").agg(F.min("ord").alias("ord"))
    ends = r.select(*keys, F.explode(F.array("a", "z")).alias("page")).distinct()
    return blocks_around(ends, cells, keys).join(cells, [*keys, "c"], "left").groupBy(*keys, "page").agg(F.min("ord").alias("ord"))


def blocks_around(ends: DataFrame, cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Pages with the blocks ``c`` around them, of those sizes only that their key's ``cells`` have: short ranges have few."""
    sizes = cells.groupBy(*keys).agg(F.collect_set("c.k").alias("_sizes"))
    around = F.transform("_sizes", lambda k: F.struct(k.alias("k"), F.call_function("shiftright", F.col("page"), k).alias("block")))
    return ends.join(sizes, [*keys], "left").select(*keys, "page", F.explode_outer(around).alias("c"))


def first_range(pages: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = ("book",)) -> DataFrame:
    """Pages with the first (by ``ord``) range ``[start, end]`` that holds them; an open end holds all pages on.

    Pages are taken as of the steps of :func:`range_steps`, so work goes with pages and
    ranges, not with how many ranges hold a page.
    """
    own = [c for c in pages.columns if c not in (*keys, "page", "ord")]
    steps = range_steps(ranges, keys).select(*keys, "page", F.lit(0).alias("_kind"), F.struct("ord").alias("_step"))
    rows = pages.select(*keys, F.col("page").cast("long").alias("page"), F.lit(1).alias("_kind"), *own)
    seen = F.last("_step", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("page", "_kind").rowsBetween(*_UP_TO))
    both = steps.unionByName(rows, allowMissingColumns=True).withColumn("_at", seen)
    hit = both.filter((F.col("_kind") == 1) & F.col("_at.ord").isNotNull())
    return hit.select(*keys, F.col("page").cast(pages.schema["page"].dataType).alias("page"), F.col("_at.ord").alias("ord"), *own)


def spread_pages(pages: DataFrame, spreads: DataFrame, joined: Column) -> DataFrame:
    """Pages of the first spread that holds them; joined pages and spreads of fewer than two pages are left out."""
    hit = first_range(pages.filter(~joined), spreads)
    return hit.withColumn("_n", F.count("*").over(Window.partitionBy("book", "ord"))).filter("_n >= 2").drop("_n")


def spread_members(pages: DataFrame, lists: DataFrame) -> DataFrame:
    """Pages of spreads given as texts like ``4-5-6``; a page may be in several."""
    member = lists.select("book", "spread", F.explode(F.transform(F.split("spread", "-"), lambda x: x.cast("int"))).alias("page"))
    return pages.join(member, ["book", "page"])


def shift_names(pages: DataFrame, start: int = 0, title: str | None = None, volume: str | None = None, reverse: bool = False, spreads: bool = False, parts: int | None = None) -> DataFrame:
    """New names that count on from ``start``.

    With ``spreads`` a page wider than high counts as many pages as the last
    upright page of its height fits into its width (its own width, if none came
    before), at least one.  A book is one window, or with ``parts`` so many, for folders that no task should hold.
    """
    order = F.desc("name") if reverse else F.asc("name")
    book = Window.partitionBy("book")
    narrow = F.when(F.col("width") < F.col("height"), F.col("width"))
    if spreads:
        if parts:
            pages = last_value(pages, ("book", "height"), ("name",), narrow, "_upright", parts, reverse)
        else:
            pages = pages.withColumn("_upright", F.last(narrow, ignorenulls=True).over(Window.partitionBy("book", "height").orderBy(order).rowsBetween(*_UP_TO)))
        fits = F.floor(F.col("width") / F.coalesce("_upright", F.lit(1)))
        span = F.when(F.col("width") > F.col("height"), F.greatest(fits, F.lit(1))).otherwise(F.lit(1)).cast("int")
        pages = pages.withColumn("span", span).drop("_upright")
    else:
        pages = pages.withColumn("span", F.lit(1))
    if parts:
        pages = running_total(pages, ("book",), ("name",), F.col("span").cast("long"), parts, reverse)
        counts = pages.groupBy("book").agg(F.count("*").alias("_total")) if spreads else None
        at = F.lit(start) + F.col("_ahead")
        total = F.col("_all")
        if counts is not None:
            pages, total = pages.join(counts, "book"), F.col("_total")
    else:
        at = F.lit(start) + F.sum("span").over(book.orderBy(order).rowsBetween(*_UP_TO)) - F.col("span")
        total = F.count("*").over(book)
    digits = F.greatest(F.lit(3), F.length((total + start).cast("string")))
    pages = pages.withColumn("first_page", at.cast("int")).withColumn("_digits", digits).drop("_ahead", "_all", "_total")
    text = lambda x: F.lpad(x.cast("string"), F.greatest("_digits", F.length(x.cast("string"))), F.lit("0"))
    first, last = F.col("first_page"), F.col("first_page") + F.col("span") - 1
    number = F.concat(F.lit("p"), text(first), F.when(F.col("span") > 1, F.concat(F.lit("-"), text(last))).otherwise(""))
    prefix = "".join(f"{x} - " for x in (title, volume) if x is not None)
    return pages.withColumn("new_name", F.concat(F.lit(prefix), number, F.regexp_extract("name", r"(\.[^.]+)$", 1))).drop("_digits")


def step_names(steps: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``kind-n`` by order of occurrence, within ``keys``."""
    place = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("pos"))
    return steps.withColumn("step", F.concat_ws("-", "kind", place.cast("string")))


def fill_blank_sizes(pages: DataFrame) -> DataFrame:
    """Blank pages take the last real page's size; those before any are dropped; ``out`` counts what is kept."""
    order = Window.partitionBy("book").orderBy("page").rowsBetween(*_UP_TO)
    filled = pages.select("book", "page", "is_blank", *(F.last(F.when(~F.col("is_blank"), F.col(c)), ignorenulls=True).over(order).alias(c) for c in ("width", "height")))
    kept = filled.filter("width is not null")
    return kept.withColumn("out", F.row_number().over(Window.partitionBy("book").orderBy("page")) - 1)


def page_sides(pages: DataFrame) -> DataFrame:
    """Side of each page after the cover, in reading order from right to left.

    A page much wider than the book's first one is in the center, and starts the
    alternation anew.
    """
    book = Window.partitionBy("book").orderBy("page")
    first = F.first("width").over(book.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    bound = F.when(2 * first - 80 < first, first + 150).otherwise(2 * first - 80)
    marked = pages.withColumn("_n", F.row_number().over(book)).withColumn("_center", (F.col("width") > bound) & (F.col("_n") > 1))
    run = F.sum(F.col("_center").cast("int")).over(book.rowsBetween(*_UP_TO))
    marked = marked.withColumn("_run", run)
    # place among the pages since the cover, or since the last center page
    place = F.row_number().over(Window.partitionBy("book", "_run").orderBy("page")) - 2
    place = F.when(F.col("_run") == 0, F.col("_n") - 2).otherwise(place)
    side = F.when(F.col("_n") == 1, "cover").when(F.col("_center"), "center").when(place % 2 == 0, "right").otherwise("left")
    return marked.withColumn("side", side).drop("_n", "_center", "_run")


def oneshot_keys(books: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("library").orderBy("book")) - 1
    return books.withColumn("key", F.format_string("%02d", place))


def base_groups(chapters: DataFrame) -> DataFrame:
    """For each base number of a book: its chapters in order, how many, and their least part."""
    base = base_of(F.col("number"))
    return chapters.groupBy("book", base.alias("base")).agg(F.sort_array(F.collect_list("number")).alias("numbers"), F.count("*").alias("group_size"), F.min(part_of(F.col("number"))).alias("least_part"))


def base_rank(chapters: DataFrame) -> DataFrame:
    """Place of a chapter within its base number (from 1, the base chapter included), that number's chapters and their least part."""
    own = Window.partitionBy("book", "base")
    based = chapters.withColumn("base", base_of(F.col("number"))).withColumn("rank", F.row_number().over(own.orderBy("number")))
    return based.withColumn("group_size", F.count("*").over(own)).withColumn("least_part", F.min(part_of(F.col("number"))).over(own))


def mix_and_match(a: DataFrame, b: DataFrame, by_stem: bool = False) -> DataFrame:
    """The smaller of two files that correspond: by place in name order (their stems must agree), or by stem.

    Both have ``folder, stem, size``; on equal sizes ``a`` wins.
    """
    if by_stem:
        both = a.select("folder", "stem", F.col("size").alias("size_a")).join(b.select("folder", "stem", F.col("size").alias("size_b")), ["folder", "stem"], "full")
        return both.withColumn("pick", F.when(F.col("size_b").isNull() | (F.col("size_a") <= F.col("size_b")), "A").otherwise("B"))
    place = F.row_number().over(Window.partitionBy("folder").orderBy("stem"))
    left = a.select("folder", place.alias("place"), F.col("stem"), F.col("size").alias("size_a"))
    right = b.select("folder", place.alias("place"), F.col("stem").alias("stem_b"), F.col("size").alias("size_b"))
    both = left.join(right, ["folder", "place"]).filter("stem = stem_b").drop("stem_b")
    return both.withColumn("pick", F.when(F.col("size_a") <= F.col("size_b"), "A").otherwise("B"))
