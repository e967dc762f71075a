"""Page archives and image folders as tables, and back."""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import container_kind, is_image, number_pages
from . import comics

MEMBERS = "archive string, container string, member string, name string, length long, content binary"


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files under a folder, numbered in name order: the files themselves aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    named = files.select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("book"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "path", "length")
    return number_pages(named)


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, kind, content in zip(batch["path"], batch["kind"], batch["content"]):
            if kind == "CBZ":
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
            else:
                with tarfile.open(fileobj=io.BytesIO(content)) as t:
                    found = [(i.name, t.extractfile(i).read()) for i in t.getmembers() if i.isfile()]
            rows = [(path, kind, m, m.rsplit("/", 1)[-1], len(b), b) for m, b in found]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in MEMBERS.split(", ")])


def read_archives(spark: SparkSession, path: str, images: bool = True, content: bool = True, split: int = comics.SPLIT) -> DataFrame:
    """Image members (or all) of the zip and tar archives under a folder, numbered in base name order within each.

    The kind is told by the first bytes, not by the name; other kinds are left
    out.  Archives are read by ranges of ``split`` bytes, a task each, and filters on
    ``archive``, ``member`` and ``name`` keep contents from being read.  Where only Spark's own
    readers reach the path, an archive is held by one task as a whole.
    """
    if not comics.reachable(path):
        return explode_archives(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    spark.dataSource.register(comics.Comics)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    text = lambda x: str(x).lower()
    return spark.read.format("comics").option("images", text(images)).option("content", text(content)).option("split", str(split)).load(path)


def write_archives(pages: DataFrame, path: str, comment: str = "", level: int = 0, mode: str = "append") -> None:
    """A zip of each archive's ``name, content`` rows, in name order, all of them or none; entries are streamed.

    An archive's rows are one task's, as a file has one writer; its memory is that of one page.
    """
    pages.sparkSession.dataSource.register(comics.Comics)
    dealt = pages.select("archive", "name", F.col("content").cast("binary").alias("content")).repartition("archive").sortWithinPartitions("archive", "name")
    dealt.write.format("comics").option("comment", comment).option("level", str(level)).mode(mode).save(path)


def explode_archives(files: DataFrame) -> DataFrame:
    """The same for archives in a table with ``path`` and ``content``."""
    known = files.select("path", container_kind(F.substring("content", 1, 520)).alias("kind"), "content").filter(F.col("kind").isin("CBZ", "TAR"))
    members = known.mapInPandas(_members, MEMBERS).filter(is_image(F.col("name")))
    return number_pages(members, "archive")


def write_packs(pages: DataFrame, path: str) -> None:
    """One folder for each archive name, with its pages' rows in name order."""
    pages.repartition("archive").sortWithinPartitions("archive", "name").write.partitionBy("archive").parquet(path)


def pack_archives(pages: DataFrame, comment: str = "") -> DataFrame:
    """``archive, n_pages, content``: a zip of each archive's ``name, content`` rows.  One archive must fit one task."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.comment = comment.encode()
            for name, content in sorted(zip(pdf["name"], pdf["content"])):
                z.writestr(zipfile.ZipInfo(name), content)
        return pd.DataFrame({"archive": [pdf["archive"].iloc[0]], "n_pages": [len(pdf)], "content": [out.getvalue()]})

    return pages.groupBy("archive").applyInPandas(pack, "archive string, n_pages long, content binary")


def write_manifest(stats: DataFrame, path: str, order: str = "image") -> None:
    stats.orderBy(order).write.json(path)


def read_image_meta(spark: SparkSession, path: str) -> DataFrame:
    """Size and channels of each image; broken ones have height -1."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(path)
    return images.select("image.origin", "image.width", "image.height", "image.nChannels", "image.mode")


def png_meta(content: Column) -> dict[str, Column]:
    """Size and channels from a PNG's header, without decoding; -1 where it is no PNG, as the image source says it."""
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("int")
    ok = (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring(content, 13, 4)) == "49484452") & (F.length(content) >= 33)
    kind = number(26, 1)
    channels = F.when(kind.isin(0, 3), 1).when(kind == 2, 3).when(kind == 4, 2).when(kind == 6, 4)
    return {"width": F.when(ok, number(17, 4)).otherwise(-1), "height": F.when(ok, number(21, 4)).otherwise(-1), "nChannels": F.when(ok, channels).otherwise(-1)}


#: Bytes of a file that its header is looked for in.
HEAD_BYTES = 1 << 18
META = "format string, width int, height int, nChannels int"
_NONE = (None, -1, -1, -1)


def _jpeg(data: bytes) -> tuple | None:
    """From a JPEG's frame header: segments are passed over by their lengths up to it."""
    at = 2
    while at + 9 < len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return "JPEG", width, height, data[at + 9]
        if kind in (0xD9, 0xDA):
            return None
        # more bytes FF may stand before a marker, and some markers have no length
        at += 1 if kind == 0xFF else 2 if kind == 1 or 0xD0 <= kind <= 0xD8 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def _webp(data: bytes) -> tuple | None:
    kind = data[12:16]
    if kind == b"VP8 " and data[23:26] == b"\x9d\x01\x2a" and len(data) >= 30:
        width, height = struct.unpack_from("<HH", data, 26)
        return "WEBP", width & 0x3FFF, height & 0x3FFF, 3
    if kind == b"VP8L" and data[20:21] == b"\x2f" and len(data) >= 25:
        bits = int.from_bytes(data[21:25], "little")
        return "WEBP", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 3 + (bits >> 28 & 1)
    if kind == b"VP8X" and len(data) >= 30:
        return "WEBP", int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1, 3 + (data[20] >> 4 & 1)
    return None


def header(data: bytes | None) -> tuple:
    """Format, width, height and channels of a PNG, JPEG, GIF or WebP by its header; none and -1 where it is none of them, or cut off."""
    data, found = data or b"", None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 33:
        width, height = struct.unpack_from(">II", data, 16)
        found = ("PNG", width, height, {0: 1, 3: 1, 2: 3, 4: 2, 6: 4}.get(data[25], 0))
    elif data[:3] == b"\xff\xd8\xff":
        found = _jpeg(data)
    elif data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 13:
        found = ("GIF", *struct.unpack_from("<HH", data, 6), 3)
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        found = _webp(data)
    return found if found and all(0 < x < 1 << 31 for x in found[1:]) else _NONE


def image_meta(content: Column) -> Column:
    """A struct ``format, width, height, nChannels`` of an image's header, without decoding; only its first bytes go to a worker."""

    def read(heads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header(x) for x in heads], columns=["format", "width", "height", "nChannels"])

    return F.pandas_udf(read, META)(F.substring(content, 1, HEAD_BYTES))


def broken_images(meta: DataFrame) -> DataFrame:
    return meta.filter("height = -1")


def not_gray(meta: DataFrame) -> DataFrame:
    return meta.filter("nChannels <> 1")


