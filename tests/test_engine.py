"""Peaks, rules, boxes, markup, archives, images, configurations, pipelines and streams on small fixtures."""

import io
import json
import random
import struct
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from folioscope.operators import catalog, markup, pixels, ranges, rules, scoring
from folioscope.plans import pipeline
from folioscope.sources import archives
from folioscope.sources.config import read_config
from folioscope.streaming.ingest import ingest


def png(width, height, channels):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + bytes(range(width * channels)) for _ in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def brute_peaks(h):
    """Middles of level stretches above both neighbours, beyond the ends zero."""
    out, i = [], 0
    while i < len(h):
        j = i
        while j + 1 < len(h) and h[j + 1] == h[i]:
            j += 1
        if h[i] > (h[i - 1] if i else 0) and h[i] > (h[j + 1] if j + 1 < len(h) else 0):
            out.append((i + j) // 2)
        i = j + 1
    return out


def brute_prominence(h, i):
    padded, i = [0, *h, 0], i + 1
    lows = []
    for step in (-1, 1):
        j, low = i, padded[i]
        while 0 <= j < len(padded) and padded[j] <= padded[i]:
            low = min(low, padded[j])
            j += step
        lows.append(low)
    return padded[i] - max(lows)


def test_peaks_against_brute_force(spark):
    rng = random.Random(5)
    hists = {k: [rng.choice((0, 0, 1, 2, 3, 5)) for _ in range(256)] for k in range(12)}
    df = spark.createDataFrame([(k, v, n) for k, h in hists.items() for v, n in enumerate(h)], "image int, v int, n long")
    peaks = pixels.local_peaks(df, percent=None)
    got = pixels.prominences(peaks, df).collect()
    want = {(k, i): brute_prominence(h[:61], i) for k, h in hists.items() for i in brute_peaks(h[:61])}
    assert {(r["image"], r["bin"]): r["prominence"] for r in got} == want
    white = pixels.local_peaks(df, percent=None, white=True).collect()
    assert {(r["image"], r["bin"]) for r in white} == {(k, 195 + i) for k, h in hists.items() for i in brute_peaks(h[195:])}


def test_rules_are_two_valued(spark):
    df = spark.createDataFrame([(1, None, "ab"), (2, 5, "cd"), (3, 7, None)], "id int, k int, s string")
    cond = lambda f, o, v: {"op": "condition", "field": f, "operator": o, "value": v}
    ids = lambda t: [r["id"] for r in rules.rule_filter(df, t).orderBy("id").collect()]
    assert ids(cond("k", "!=", 5)) == [3]
    assert ids({"op": "not", "rule": cond("k", "!=", 5)}) == [1, 2]
    assert ids(cond("s", "in", "xabx")) == [1]
    assert ids(cond("s", "not in", ["ab"])) == [2]
    assert ids(cond("missing", "==", 1)) == []
    assert ids({"op": "or", "rules": [cond("k", ">", 6), cond("s", "IS", "ab")]}) == [1, 3]
    with pytest.raises(ValueError):
        rules.condition(F.col("k"), "~", 1)


def test_rules_are_pushed_down(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet")
    plan = rules.rule_filter(df, {"op": "condition", "field": "user_id", "operator": ">", "value": 5})._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(user_id)" in plan.replace("In(", "") or "GreaterThan(user_id" in plan


@pytest.mark.parametrize(
    "href, want",
    [
        ("a.png", "OPS/t/a.png"), ("../i/a%20b.png#x", "OPS/i/a b.png"), ("/c/./d.png", "c/d.png"), ("../../../x", None), ("https://a/b", None),
        ("//a/b", None), ("", "OPS/t/p.xhtml"), ("OPS/i/a.png", "OPS/i/a.png"), ("a+b%zz.png", "OPS/t/a+b%zz.png"), ("data:image/png;base64,xx", None),
    ],
)
def test_resolve_href(spark, href, want):
    assert spark.range(1).select(markup.resolve_href(F.lit("OPS/t/p.xhtml"), F.lit(href))).first()[0] == want


@pytest.mark.parametrize(
    "html, want",
    [
        ('<html><body><div><img src="a.png"/></div></body></html>', "a.png"),
        ('<body><svg><image xlink:href="b.png"/></svg></body>', "b.png"),
        ('<body><p>text</p><img src="a.png"/></body>', None),
        ('<body><img src="a.png"/><img src="b.png"/></body>', None),
        ('<body><h1><img src="a.png"/></h1></body>', None),
    ],
)
def test_image_only(spark, html, want):
    assert spark.range(1).select(markup.image_only(F.lit(html))).first()[0] == want


def test_archives_round_trip(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    with zipfile.ZipFile(folder / "b.dat", "w") as z:
        z.writestr("x/2.png", b"two")
        z.writestr("1.jpg", b"one")
        z.writestr("note.txt", b"no")
    with tarfile.open(folder / "c.cbz", "w") as t:
        info = tarfile.TarInfo("3.webp")
        info.size = 5
        t.addfile(info, io.BytesIO(b"three"))
    (folder / "d.cbz").write_bytes(b"nothing")
    got = archives.read_archives(spark, str(folder)).collect()
    assert sorted((r["container"], r["name"], r["index"], r["total_count"], bytes(r["content"])) for r in got) == [("CBZ", "1.jpg", 0, 2, b"one"), ("CBZ", "2.png", 1, 2, b"two"), ("TAR", "3.webp", 0, 1, b"three")]
    packed = archives.pack_archives(spark.createDataFrame([("a", "2.png", b"2"), ("a", "1.png", b"1")], "archive string, name string, content binary"), "hello").first()
    with zipfile.ZipFile(io.BytesIO(bytes(packed["content"]))) as z:
        assert z.namelist() == ["1.png", "2.png"] and z.comment == b"hello" and z.read("1.png") == b"1"
    archives.write_packs(spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "3")], "archive string, name string"), str(tmp_path / "packs"))
    assert spark.read.parquet(str(tmp_path / "packs")).count() == 3
    archives.write_manifest(spark.createDataFrame([(2, "b"), (1, "a")], "image int, x string"), str(tmp_path / "m"))
    assert [r["image"] for r in spark.read.json(str(tmp_path / "m")).orderBy("image").collect()] == [1, 2]


def test_image_sources(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    for name, data in (("2.png", png(4, 6, 1)), ("1.png", png(3, 2, 3)), ("bad.png", b"\x89PNG broken"), ("x.txt", b"text")):
        (tmp_path / "v1" / name).write_bytes(data)
    listed = archives.list_images(spark, str(tmp_path)).orderBy("index").collect()
    assert [(r["book"], r["name"], r["total_count"]) for r in listed] == [("v1", "1.png", 3), ("v1", "2.png", 3), ("v1", "bad.png", 3)]
    meta = archives.read_image_meta(spark, str(tmp_path))
    assert {(r["width"], r["height"], r["nChannels"]) for r in meta.filter("height > 0").collect()} == {(4, 6, 1), (3, 2, 3)}
    assert archives.broken_images(meta).filter("origin like '%bad.png'").count() == 1
    assert archives.not_gray(meta.filter("height > 0")).count() == 1
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    heads = files.select("path", *(x.alias(k) for k, x in archives.png_meta(F.col("content")).items())).collect()
    assert {(r["width"], r["height"], r["nChannels"]) for r in heads} == {(4, 6, 1), (3, 2, 3), (-1, -1, -1)}


def test_config(spark, tmp_path):
    config = {"title": "T", "publisher": "P", "credit": "c", "volumes": [{"path": "v01", "number": 1.0, "chapters": [{"number": 1.0, "start": 0}, {"number": 2.0, "start": 9}], "spreads": [[2, 3]], "meta_naming": [{"tag": "Cover", "page": 0}], "skip_actions": [{"step": "level-1", "action": "copy", "pages": [1, 2]}]}], "actions": [{"kind": "level", "params": {"limit": "60"}}]}
    (tmp_path / "c.json").write_text(json.dumps(config, indent=1))
    t = read_config(spark, str(tmp_path / "c.json"))
    assert ranges.chapter_ends(t["chapters"]).orderBy("start").select("start", "end", "is_single").collect() == [(0, 8, False), (9, None, True)]
    assert t["spreads"].collect()[0]["end"] == 3 and t["skips"].count() == 2 and t["meta"].first()["tag"] == "Cover"
    steps = ranges.step_names(t["actions"])
    assert pipeline.violations(t["chapters"], t["volumes"].select(F.col("book").alias("path")), steps, t["skips"]).count() == 0
    (tmp_path / "bad.json").write_text('{"title": ')
    with pytest.raises(Exception):
        read_config(spark, str(tmp_path / "bad.json"))["volumes"].collect()


def test_stream_takes_each_page_once(spark, tmp_path):
    landing, done, checkpoint = (str(tmp_path / x) for x in ("in", "done", "cp"))
    schema = "book int, name string"
    run = lambda: ingest(spark, landing, schema, done, checkpoint, lambda df: df.withColumn("x", F.length("name"))).awaitTermination()
    spark.createDataFrame([(1, "a"), (1, "b")], schema).write.mode("append").parquet(landing)
    run()
    spark.createDataFrame([(1, "b"), (2, "c")], schema).write.mode("append").parquet(landing)
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(done).collect()) == [(1, "a", 1), (1, "b", 1), (2, "c", 1)]


def test_tiles_cover_and_blend(spark):
    px = spark.createDataFrame([(1, y, x, (7 * y + 3 * x) % 256) for y in range(21) for x in range(34)], "image int, y int, x int, v int")
    out = scoring.tile_score(px, 16, 3, lambda b: b).join(px, ["image", "y", "x"])
    assert out.count() == 21 * 34 and out.filter("out <> v").count() == 0
    assert [scoring.n_tiles(n, 16, 3) for n in (1, 16, 17, 26, 27)] == [1, 1, 2, 2, 3]
    assert spark.range(1).select(scoring.tile_starts(F.lit(27), 16, 3)).first()[0] == [0, 10, 20]


def test_page_selection_and_checks(spark):
    p = spark.createDataFrame([(k,) for k in range(12)], "page int")
    assert [r["page"] for r in catalog.select_pages(p, "1-3,10").orderBy("page").collect()] == [0, 1, 2, 9]
    assert [r["page"] for r in catalog.select_pages(p, "odd").orderBy("page").collect()] == [0, 2, 4, 6, 8, 10]
    assert catalog.select_pages(p, "").count() == 12
    with pytest.raises(ValueError):
        catalog.select_pages(p, "0-3")
    with pytest.raises(ValueError):
        catalog.merge_books([p])
    assert [r["path"] for r in catalog.gen_volumes(spark, 2).collect()] == ["v01", "v02"]
    with pytest.raises(ValueError):
        catalog.gen_volumes(spark, 1.5)


def test_mix_by_stem(spark):
    a = spark.createDataFrame([(0, "a", 5), (0, "b", 3)], "folder int, stem string, size int")
    b = spark.createDataFrame([(0, "b", 2), (0, "c", 1)], "folder int, stem string, size int")
    got = {r["stem"]: r["pick"] for r in ranges.mix_and_match(a, b, True).collect()}
    assert got == {"a": "A", "b": "B", "c": "B"}


def test_windows_survive_empty_input(spark):
    pages = spark.createDataFrame([], "book int, page int, width int, height int, name string")
    chapters = spark.createDataFrame([], "book int, ord int, number double, start int")
    assert ranges.assign_chapters(pages, chapters).count() == 0
    assert ranges.shift_names(pages, spreads=True).count() == 0
    assert pixels.histogram(spark.createDataFrame([], "image int, v int")).count() == 0


def test_pipeline_of_posterize_regray_and_spreads(spark):
    pages = spark.createDataFrame([(1, p, f"p{p:03d}.{e}", s, c) for p, e, s, c in ((0, "png", 3, True), (4, "png", 4, False), (5, "jpg", 200, False), (6, "webp", 256, False))], "book long, page int, name string, shades int, is_color boolean")
    skips = spark.createDataFrame([(1, 6, "regray-1")], "book long, page int, step string")
    actions = [{"kind": "spreads", "spreads": ["4-5", "5-6"]}, {"kind": "regray"}]
    done = pipeline.run_pipeline(pages, actions, skips).orderBy("page").collect()
    assert [r["spread"] for r in done] == [None, "4-5", "4-5", "5-6"]
    assert [r["status"] for r in done] == ["COPIED", "GRAYSCALED", "COPIED", None]
    assert done[3]["history"] == ["spreads-1:done", "regray-1:ignored"]
    auto = pipeline.run_pipeline(pages, [{"kind": "autoposterize"}]).orderBy("page").collect()
    assert [(r["bits"], r["status"]) for r in auto] == [(1, "PROCESSED"), (2, "PROCESSED"), (7, "PROCESSED"), (8, "COPIED")]
    fixed = pipeline.run_pipeline(pages, [{"kind": "posterize", "bits": 4}]).collect()
    assert {(r["bits"], r["status"]) for r in fixed} == {(4, "PROCESSED")}
