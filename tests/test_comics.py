"""Archives by ranges and filters, written all or none; headers of images; streams that remember."""

import io
import struct
import tarfile
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringEndsWith

from folioscope.sources import archives, comics
from folioscope.streaming.ingest import ingest


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("comics")
    with zipfile.ZipFile(at / "large.cbz", "w") as z:
        for k in range(40):
            z.writestr(f"d{k % 3}/p{k:03d}.png", bytes([k]) * 5000)
        z.writestr("note.txt", b"no")
    with tarfile.open(at / "b.tar", "w") as t:
        for k in range(6):
            info = tarfile.TarInfo(f"{k}.jpg")
            info.size = 3000
            t.addfile(info, io.BytesIO(bytes([k]) * 3000))
    (at / "other.cbz").write_bytes(b"nothing")
    (at / "empty.cbz").write_bytes(b"")
    (at / "sub").mkdir()
    with zipfile.ZipFile(at / "sub" / "s.cbz", "w") as z:
        z.writestr("one.gif", b"x")
    return str(at)


def test_one_archive_is_read_by_several_tasks(spark, folder):
    df = archives.read_archives(spark, folder, split=30_000)
    rows = df.withColumn("task", F.spark_partition_id()).collect()
    own = [r for r in rows if r["archive"].endswith("/large.cbz")]
    assert len({r["task"] for r in own}) >= 5 and len(own) == 40
    assert [(r["name"], r["index"], r["total_count"]) for r in sorted(own, key=lambda r: r["index"])] == [(f"p{k:03d}.png", k, 40) for k in range(40)]
    assert all(bytes(r["content"]) == bytes([r["index"]]) * 5000 and r["length"] == 5000 for r in own)
    tar = sorted((r["name"], r["index"], r["container"], bytes(r["content"])[:1]) for r in rows if r["archive"].endswith("b.tar"))
    assert tar == [(f"{k}.jpg", k, "TAR", bytes([k])) for k in range(6)]
    assert len(rows) == 47 and archives.read_archives(spark, folder, images=False).count() == 48


@pytest.mark.parametrize("split", [100, 7000, 10**9])
def test_any_split_gives_each_member_once(folder, split):
    reader = comics.ArchiveReader({"path": folder, "split": str(split)})
    got = [r[:4] for p in reader.partitions() for r in reader.read(p)]
    assert len(got) == 47 == len(set(got))


class Counted(io.RawIOBase):
    def __init__(self, path):
        self.file, self.bytes = open(path, "rb"), 0

    def read(self, n=-1):
        data = self.file.read(n)
        self.bytes += len(data)
        return data

    def seek(self, *a):
        return self.file.seek(*a)

    def tell(self):
        return self.file.tell()

    def readable(self):
        return True

    def seekable(self):
        return True


@pytest.mark.parametrize("name", ["large.cbz", "b.tar"])
def test_filters_read_fewer_bytes(folder, name):
    def read(filters, **options):
        reader = comics.ArchiveReader({"path": folder, **options})
        assert list(reader.pushFilters(filters)) == []
        file = Counted(f"{folder}/{name}")
        return len(list(reader.of_archive(file, name, 0, 10**9))), file.bytes

    all_, some, none = read([]), read([StringEndsWith(("name",), "5.png" if name == "large.cbz" else "5.jpg")]), read([], content="false")
    assert some[0] < all_[0] == none[0] and some[1] < all_[1] / 2 and none[1] < all_[1] / 2


def test_filters_are_pushed_down(spark, folder):
    df = archives.read_archives(spark, folder).filter("name = 'p003.png' and archive like '%large.cbz' and length > 3")
    assert [(r["name"], r["index"]) for r in df.collect()] == [("p003.png", 3)]
    reader = comics.ArchiveReader({"path": folder})
    kept = list(reader.pushFilters([EqualTo(("archive",), f"file:{folder}/b.tar"), EqualTo(("length",), 3)]))
    assert [f.attribute for f in kept] == [("length",)]
    assert [p[0].rsplit("/", 1)[1] for s in reader.partitions() for p in s.parts] == ["b.tar"]


def test_archives_are_written_and_read(spark, tmp_path):
    rows = [("a.cbz", "2.png", b"two"), ("a.cbz", "1.png", b"one"), ("b.cbz", "é.jpg", b"x" * 9)]
    df = spark.createDataFrame(rows, "archive string, name string, content binary")
    path = str(tmp_path / "out")
    archives.write_archives(df, path, "a comment", level=6)
    with zipfile.ZipFile(tmp_path / "out" / "a.cbz") as z:
        assert z.namelist() == ["1.png", "2.png"] and z.comment == b"a comment" and z.read("2.png") == b"two" and z.testzip() is None
    got = archives.read_archives(spark, path).collect()
    assert sorted((r["archive"].rsplit("/", 1)[1], r["name"], bytes(r["content"])) for r in got) == sorted(rows)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.cbz", "b.cbz"]
    with pytest.raises(Exception, match="there already"):
        archives.write_archives(df, path)
    archives.write_archives(df.limit(1), path, mode="overwrite")
    assert len(list((tmp_path / "out").iterdir())) == 1


@pytest.mark.parametrize("bad", [("c.cbz", "1.png", None), ("../c.cbz", "1.png", b"x"), (None, "1.png", b"x")])
def test_a_failed_task_leaves_no_archive(spark, tmp_path, bad):
    rows = [(f"a{k}.cbz", "1.png", b"one") for k in range(8)] + [bad]
    with pytest.raises(Exception):
        archives.write_archives(spark.createDataFrame(rows, "archive string, name string, content binary"), str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file() and "_temporary" not in str(p)]
    assert archives.read_archives(spark, str(tmp_path)).count() == 0


def test_headers_of_four_formats(spark):
    jpeg = b"\xff\xd8\xff\xe0\0\x10" + bytes(14) + b"\xff\xff\xdb\0\x04ab\xff\x01\xff\xc2\0\x11\x08\x01\x90\x02\x58\x03" + bytes(8)
    lossy = b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 500 | 1 << 14, 400)
    lossless = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 499 | 399 << 14 | 1 << 28)
    extended = b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\x10\0\0\0" + (499).to_bytes(3, "little") + (399).to_bytes(3, "little")
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 500, 400) + b"\x08\x06\0\0\0\0\0\0\0"
    gif = b"GIF87a" + struct.pack("<HH", 500, 400) + b"\0\0\0"
    want = {jpeg: ("JPEG", 600, 400, 3), lossy: ("WEBP", 500, 400, 3), lossless: ("WEBP", 500, 400, 4), extended: ("WEBP", 500, 400, 4), png: ("PNG", 500, 400, 4), gif: ("GIF", 500, 400, 3)}
    none = (None, -1, -1, -1)
    for data, meta in list(want.items()):
        for cut in (0, 3, 12, len(data) // 2):
            want[data[:cut]] = none
        assert archives.header(data) == meta
    want |= {b"\xff\xd8\xff\xda\0\4ab": none, b"\xff\xd8\xff\xc4\0\4ab\xff\xd9": none, jpeg[:2] + b"\xff" * 50: none, b"text": none, jpeg[:-15].replace(b"\xff\xc2", b"\xff\xcc"): none}
    rows = [(k, d) for k, d in enumerate([*want, None])]
    got = {r["k"]: tuple(r["m"]) for r in spark.createDataFrame(rows, "k int, d binary").select("k", archives.image_meta(F.col("d")).alias("m")).collect()}
    assert got == {k: want[d] if d is not None else none for k, d in rows}


def test_a_stream_remembers_what_it_has_seen(spark, tmp_path):
    landing, done, checkpoint = (str(tmp_path / x) for x in ("in", "done", "cp"))
    schema = "book int, name string"
    run = lambda: ingest(spark, landing, schema, done, checkpoint, lambda df: df.withColumn("x", F.length("name"))).awaitTermination()
    land = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
    land([(1, "a"), (1, "b"), (1, "a")])
    run()
    # a restart, a late repeat, and nothing new
    land([(1, "b"), (2, "c")])
    run()
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(done).collect()) == [(1, "a", 1), (1, "b", 1), (2, "c", 1)]
    # what was taken in isn't read again: without it the next run still knows all keys
    for p in (tmp_path / "done").rglob("*.parquet"):
        p.unlink()
    land([(1, "a"), (3, "d")])
    run()
    assert [tuple(r) for r in spark.read.schema("book int, name string, x int").option("ignoreMissingFiles", "true").parquet(done).collect()] == [(3, "d", 1)]


def test_small_ranges_make_a_bounded_number_of_tasks(folder):
    """An archive of 200 kB in ranges of 50 bytes would be 4,000 tasks, each with its directory read anew."""
    reader = comics.ArchiveReader({"path": folder, "split": "50"})
    parts = reader.partitions()
    assert len(parts) <= comics.TASKS + 5 and sum(z - a for p in parts for _, a, z in p.parts) == sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())


def test_rows_come_in_batches_of_bounded_size(folder, monkeypatch):
    monkeypatch.setattr(comics, "BATCH_BYTES", 12_000)
    rows = comics.ArchiveReader({"path": folder})
    batches = comics.Comics({"path": folder}).reader(None)
    got = [b for p in batches.partitions() for b in batches.read(p)]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == [r for p in rows.partitions() for r in rows.read(p)]
    assert len(got) > 10 and all(b.num_rows <= 4 for b in got)


def test_stored_members_are_told_from_damaged_ones(spark, tmp_path):
    df = spark.createDataFrame([("a.cbz", "é1.png", b"one" * 9), ("a.cbz", "2.png", b""), ("b.cbz", "3.png", b"three")], "archive string, name string, content binary")
    archives.write_archives(df, str(tmp_path / "out"))
    at = tmp_path / "out" / "a.cbz"
    with zipfile.ZipFile(at) as z:
        # sizes stand before the contents: no entry ends with a descriptor
        assert z.testzip() is None and all(not i.flag_bits & 8 for i in z.infolist())
    read = lambda: [bytes(r[7]) for r in comics.ArchiveReader({"path": str(at)}).read(comics.Split([(str(at), 0, 10**9)]))]
    assert sorted(read()) == [b"", b"one" * 9]
    at.write_bytes(at.read_bytes().replace(b"oneone", b"onXone", 1))
    with pytest.raises(zipfile.BadZipFile):
        read()
