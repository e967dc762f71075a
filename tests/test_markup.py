"""References rewritten as one step: chains, swaps, sets of sources, css urls, paths, folders."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import markup

PAGES = "page_id int, book string, path string, html string"


def rewritten(spark, html, mapping, **how):
    pages = spark.createDataFrame([(1, "x", "OPS/text/p.xhtml", html)], PAGES)
    pairs = spark.createDataFrame([(k, v) for k, v in mapping.items()], "old string, new string")
    return markup.rewrite_refs(pages, pairs, **how).first()["html"]


@pytest.mark.parametrize(
    "html, want",
    [
        ('<a href="a"> <a href="b" title="a">', '<a href="b"> <a href="c" title="a">'),
        ("<img src='b'/><img src=a>", "<img src='c'/><img src=b>"),
        ('<svg><image xlink:href = " a "/></svg>', '<svg><image xlink:href = " b "/></svg>'),
        ('<img srcset="a 1x, b 2x,other 3x" src="none">', '<img srcset="b 1x, c 2x,other 3x" src="none">'),
        ("<p style=\"background: url('a'); mask:url(b)\">", "<p style=\"background: url('b'); mask:url(c)\">"),
        ('<style>p{background:url( "b" )}</style>', '<style>p{background:url( "c" )}</style>'),
        ('<!-- <a href="a"> --><a href="a">', '<!-- <a href="a"> --><a href="b">'),
        ("<p data-x='href=\"a\"'>src=\"a\" and url of a</p>", "<p data-x='href=\"a\"'>src=\"a\" and url of a</p>"),
        ('<a data-href="a" hrefs="a" HREF="a">', '<a data-href="a" hrefs="a" HREF="b">'),
        ('<a href="">a</a>', '<a href="">a</a>'),
        ("a plain text", "a plain text"),
        ("", ""),
        (None, None),
        ('<a href="a', '<a href="a'),
        ('<img src="a"', '<img src="a"'),
    ],
)
def test_chained_names(spark, html, want):
    assert rewritten(spark, html, {"a": "b", "b": "c"}) == want


def test_swapped_names_and_odd_characters(spark):
    html = '<a href="a"><a href="b"><a href="$1"><a href="x(1)"><a href=x(1)>'
    assert rewritten(spark, html, {"a": "b", "b": "a", "$1": r"\$0", "x(1)": "y"}) == r'<a href="b"><a href="a"><a href="\$0"><a href="y"><a href=y>'


def test_paths_are_seen_from_the_page(spark):
    html = '<img src="../img/a%20b.png?q=1#f"/><a href="#top"><a href="https://x/OPS/img/c.png"><a href="//x/c"><img src="/OPS/img/c.png"><img src="q.png"><img src="../../../z"><img src="u.png"><img src=" q.png ">'
    mapping = {"OPS/img/a b.png": "OPS/img/ü *~.webp", "OPS/img/c.png": "OPS/text/d.png", "OPS/text/q.png": "z.png", "OPS/text/u.png": "OPS/text/deep/er/u.png"}
    want = '<img src="../img/%C3%BC%20%2A~.webp?q=1#f"/><a href="#top"><a href="https://x/OPS/img/c.png"><a href="//x/c"><img src="d.png"><img src="../../z.png"><img src="../../../z"><img src="deep/er/u.png"><img src=" ../../z.png ">'
    assert rewritten(spark, html, mapping, base="path") == want


@pytest.mark.parametrize("base, target, want", [("a/b.x", "a/c", "c"), ("b.x", "a/c", "a/c"), ("a/b/c.x", "a/d", "../d"), ("a/b/c.x", "e", "../../e"), ("a/b.x", "a/b.x", "b.x"), ("a/b.x", "a/b/c", "b/c")])
def test_relative_paths(spark, base, target, want):
    assert spark.range(1).select(markup.relative_href(F.lit(base), F.lit(target))).first()[0] == want


def test_mappings_hold_in_their_book(spark):
    pages = spark.createDataFrame([(1, "x", "p", '<a href="a">'), (2, "y", "p", '<a href="a">'), (3, None, "p", '<a href="a">'), (2, "y", "p", '<a href="a">'), (2, "y", "p", '<a href="c">')], PAGES)
    pairs = spark.createDataFrame([("x", "a", "1"), ("y", "a", "2"), ("y", "a", "0"), ("y", "c", "d")], "book string, old string, new string")
    got = markup.rewrite_refs(pages, pairs, within=("book",))
    assert got.columns == pages.columns
    assert sorted((r["page_id"], r["html"]) for r in got.collect()) == [(1, '<a href="1">'), (2, '<a href="0">'), (2, '<a href="0">'), (2, '<a href="d">'), (3, '<a href="a">')]


def test_a_large_mapping_is_joined_not_collected(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit('<a href="'), F.col("id").cast("string"), F.lit('"><a href="'), (F.col("id") + 1).cast("string"), F.lit('">')).alias("html"))
    pairs = spark.range(20_000).select(F.col("id").cast("string").alias("old"), (F.col("id") + 1).cast("string").alias("new"))
    out = markup.rewrite_refs(pages, pairs)
    want = {(k, f'<a href="{k + 1}"><a href="{k + 2}">') for k in range(400)}
    assert {(r["page_id"], r["html"]) for r in out.collect()} == want


def test_stems_meet_in_their_folder(spark):
    old = spark.createDataFrame([("x", "a.png", "a"), ("y", "a.png", "a"), ("y", "b.png", "b")], "book string, file string, stem string")
    new = spark.createDataFrame([("x", "A.jpg", "A"), ("y", "a.webp", "a"), ("y", "b.jpg", "b"), ("y", "B.webp", "B")], "book string, file string, stem string")
    found, unclear = markup.match_replacements(old, new, ("book",))
    assert sorted(map(tuple, found.collect())) == [("x", "a.png", "A.jpg"), ("y", "a.png", "a.webp")]
    assert sorted(map(tuple, unclear.collect())) == [("y", "b.png", "B.webp"), ("y", "b.png", "b.jpg")]
