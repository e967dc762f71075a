"""Golden values of name parsing and formatting."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import names as N


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def lit(x, kind="string"):
    return F.lit(x).cast(kind)


@pytest.mark.parametrize(
    "number, group, least, rank, volume, name, extra, want",
    [
        (1.0, 1, None, 1, None, None, None, "Test - c001 (OShot) - p000 [dig] [Pub] [crd]"),
        (1.5, 1, None, 1, None, "Extra Story", None, "Test - c001x1 (OShot) - p000 [dig] [Extra Story] [Pub] [crd]"),
        (2.2, 4, 1, 2, 2.0, None, None, "Test - c002x2 (c002.2) (v02) - p000 [dig] [Pub] [crd]"),
        (2.6, 2, 5, 2, 1.5, None, "Cover", "Test - c002x2 (v01x1) - p000 [Cover] [dig] [Pub] [crd]"),
        (13.5, 2, 5, 2, 2.0, None, None, "Test - c013x1 (v02) - p000 [dig] [Pub] [crd]"),
    ],
)
def test_page_name(spark, number, group, least, rank, volume, name, extra, want):
    got = one(spark, N.fmt_page_name(lit("Test"), lit("Pub"), lit(number, "double"), lit(name), lit("000"), lit("dig"), lit("crd"), lit(volume, "double"), lit(extra), lit(None), lit(1, "int"), lit(group, "int"), lit(least, "int"), lit(rank, "int")))[0]
    # a part below five shows itself, also where it follows the volume's own
    assert got == want


def test_page_name_suffixes(spark):
    got = one(spark, N.fmt_page_name(lit("T"), lit(None), lit(1.0, "double"), lit(None), lit("001"), lit(""), lit("x"), lit(None, "double"), lit(None), lit("HQ"), lit(2, "int"), lit(1, "int"), lit(None, "int"), lit(1, "int")))[0]
    assert got == "T - c001 (OShot) - p001 [Unknown Publisher] [x] {HQ} {r2}"


@pytest.mark.parametrize("text, pages, single", [("5", [5], True), ("3-6", [3, 4, 5, 6], False), ("a", None, None), ("a-b", None, None)])
def test_range(spark, text, pages, single):
    r = N.parse_range(lit(text))
    assert one(spark, r["pages"], r["is_single"]) == (pages, single)


@pytest.mark.parametrize("seconds, want", [(0, "0s"), (59, "59s"), (60, "1m"), (3661, "1h1m1s"), (86400, "1d"), (90061, "1d1h1m1s"), (-1, None)])
def test_elapsed(spark, seconds, want):
    assert one(spark, N.fmt_elapsed(lit(seconds, "long"))) == (want,)


def test_parse_page_splits_long_numbers(spark):
    p = N.parse_page(lit("x p1234 y"))
    assert one(spark, p["a"], p["b"]) == (123, 4)


@pytest.mark.parametrize(
    "name, want",
    [
        ("Real - c001 (v01) - p005 [dig] [Pub] [x]", "01.001"),
        ("Real - c002x1 (c002.1) (v01) - p005 [dig] [Pub] [x]", "01.002.1"),
        ("Real - c003x2 (OShot) - p005 [dig] [Pub] [x]", "00.003.6"),
        ("Real - c003 (v02x1) - p005 [dig] [Pub] [x]", "02.5.003"),
        ("Real - c004#1 (v01) - p005-006 [dig] [A Title] [Pub] [x]", "01.004.5 - A Title"),
    ],
)
def test_chapter_key(spark, name, want):
    parts = N.parse_chapter(lit(name), "Real", "Pub")
    assert one(spark, N.chapter_key(parts, True))[0] in (want, f"{want} - Extra 2", f"{want} - Extra 1")


def test_names_are_made_safe(spark):
    assert one(spark, N.secure_name(lit('a/b:c<d>"e\\f?g*h|i#j\U0001f600'))) == ("a／b：c＜d＞”e＼f？g⋆h｜ij_",)
    assert one(spark, N.unsecure_name(lit("a／b：c＜d＞”e＼f？g⋆h｜i"))) == ('a／b:c<d>"e\\f?g*h|i',)


def test_fix_text_name(spark):
    broken = "é.png".encode().decode("cp437")
    assert one(spark, N.fix_text_name(lit(broken)), N.fix_text_name(lit("é.png")), N.fix_text_name(lit("a.png"))) == ("é.png", "é.png", "a.png")


def test_volume_pattern(spark):
    f = lambda t, c=None: one(spark, N.parse_volume(lit(t), "Real Book", c))[0]
    assert f("Real Book v01 (2023) (Digital) (credit)", "credit") == "01"
    assert f("Real Book v01 (2023) (Digital) (other)", "credit") is None
    assert f("Real Book 1") is None


def test_archive_name_and_volume_text(spark):
    text = N.fmt_volume_text(lit(1.0, "double"), lit(2.0, "double"))
    assert one(spark, text) == ("v01-02",)
    name = N.fmt_archive_name(lit("Title"), lit(2023, "int"), lit("Digital"), lit("crd"), text, lit(None), lit(2, "int"), "round")
    assert one(spark, name) == ("Title v01-02 (2023) (Digital) (crd) (v2)",)
