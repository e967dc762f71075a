"""First ranges against brute force, and places, sums and last values of one key over many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import catalog, ranges, running


@pytest.mark.parametrize("seed", range(4))
def test_first_range_against_brute_force(spark, seed):
    rng = random.Random(seed)
    top = rng.choice((12, 300, 2_000_000_000))
    held, pages = [], []
    for book in (1, 2, None):
        for ord_ in range(rng.randrange(0, 25)):
            a = rng.randrange(top)
            held.append((book, ord_, a, rng.choice((None, a, a - 1, a + rng.randrange(top)))))
        pages += [(book, p, f"n{p}") for p in [rng.randrange(top) for _ in range(150)] + [0, 1, 0]]
    held = [(b, o, a, min(z, 2147483646) if z is not None else None) for b, o, a, z in held]
    rng.shuffle(held)
    got = ranges.first_range(spark.createDataFrame(pages, "book int, page int, name string"), spark.createDataFrame(held, "book int, ord int, start int, end int"))
    assert dict(got.dtypes)["page"] == "int"
    want = []
    for b, p, n in pages:
        own = [o for x, o, a, z in held if x == b and b is not None and a <= p <= (2147483647 if z is None else z)]
        if own:
            want.append((b, p, min(own), n))
    assert sorted(tuple(r) for r in got.filter("book is not null").select("book", "page", "ord", "name").collect()) == sorted(want)


def test_overlaps_cost_no_square(spark):
    """2,000 ranges that all hold all of 2,000 pages: neither meets each of the other."""
    pages = spark.range(2000).select(F.lit(1).alias("book"), F.col("id").cast("int").alias("page"))
    held = spark.range(2000).select(F.lit(1).alias("book"), F.col("id").cast("int").alias("ord"), (-F.col("id")).cast("int").alias("start"), (F.col("id") + 3000).cast("int").alias("end"))
    steps = ranges.range_steps(held)
    assert steps.count() <= 4000
    assert [tuple(r) for r in ranges.first_range(pages, held).groupBy("ord").count().collect()] == [(0, 2000)]


def test_short_ranges_are_looked_up_in_few_blocks(spark, monkeypatch):
    """Ends of ranges of two pages are sent for two sizes of blocks, not for each of 33."""
    held = spark.range(4000).select((F.col("id") % 7).alias("book"), F.col("id").cast("int").alias("ord"), (F.col("id") * 5).cast("int").alias("start"), (F.col("id") * 5 + 1).cast("int").alias("end"))
    sent, blocks_around = [], ranges.blocks_around
    monkeypatch.setattr(ranges, "blocks_around", lambda *a: sent.append(blocks_around(*a)) or sent[-1])
    steps = ranges.range_steps(held)
    assert steps.count() == 8000 and steps.filter("ord is not null").count() == 4000
    assert sent[0].count() <= 2 * 8000


def test_no_ranges_and_no_pages(spark):
    pages = spark.createDataFrame([(1, 1)], "book int, page int")
    held = spark.createDataFrame([(1, 0, 0, 5)], "book int, ord int, start int, end int")
    assert ranges.first_range(pages, held.limit(0)).count() == 0 and ranges.first_range(pages.limit(0), held).count() == 0


@pytest.fixture(scope="module")
def folder(spark):
    """One book of 5,000 pages, another of three, and one without a name."""
    rng = random.Random(3)
    rows = [(1, f"p{k:05d}.png", rng.choice((700, 700, 1500, 900)), rng.choice((1000, 1000, 900, 1200))) for k in rng.sample(range(99_999), 5000)]
    rows += [(2, f"{c}.jpg", 10, 20) for c in "abc"] + [(None, "x.png", 5, 6), (None, "y.png", 5, 6)]
    return spark.createDataFrame(rows, "book int, name string, width int, height int").repartition(5)


@pytest.mark.parametrize("how", [{}, {"spreads": True}, {"reverse": True}, {"spreads": True, "reverse": True, "title": "T", "start": 7}])
def test_renumbering_in_ranges_is_the_same(folder, how):
    columns = ["book", "name", "span", "first_page", "new_name"]
    one = ranges.shift_names(folder.filter("book is not null"), **how).select(columns).collect()
    many = ranges.shift_names(folder.filter("book is not null"), parts=8, **how).select(columns).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(one) == 5003


def test_numbers_in_ranges_are_the_same(folder):
    columns = ["book", "name", "index", "total_count"]
    one, many = (catalog.number_pages(folder, parts=parts).select(columns).collect() for parts in (None, 8))
    assert sorted(map(str, map(tuple, one))) == sorted(map(str, map(tuple, many))) and len(one) == 5005
    down = {r["name"]: r["place"] for r in running.places(folder.filter("book = 1"), ("book",), ("name",), 8, descending=True).collect()}
    assert [down[n] for n in sorted(down, reverse=True)] == list(range(1, 5001))


def test_a_book_is_many_tasks_work(spark, folder):
    parts = running.cut_in_ranges(folder.filter("book = 1"), ("book",), ("name",), 8).groupBy("_range").agg(F.count("*").alias("n"), F.min("name").alias("a"), F.max("name").alias("z")).orderBy("_range").collect()
    assert len(parts) == 8 and max(r["n"] for r in parts) < 1400
    assert all(x["z"] < y["a"] for x, y in zip(parts, parts[1:]))


def test_last_values_go_over_ranges(spark):
    rows = [(k // 500, k % 500, k if k % 97 == 3 else None) for k in range(1000)]
    got = running.last_value(spark.createDataFrame(rows, "book int, page int, v int"), ("book",), ("page",), F.col("v"), "seen", 6).collect()
    want, last = {}, None
    for b, p, v in rows:
        last = None if p == 0 and v is None else v if v is not None else last
        want[b, p] = last
    assert {(r["book"], r["page"]): r["seen"] for r in got} == want
    assert running.places(spark.createDataFrame([], "book int, page int"), ("book",), ("page",), 4).count() == 0
